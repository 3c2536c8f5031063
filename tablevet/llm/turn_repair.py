"""Cheapest repair of conversations by weighted interval parsing.

Legal role initials are ``(s?(ua)+)?``.  The repair grammar is in Chomsky normal form: a symbol
``[p>q]`` stands for rows that, repaired, lead from state p to state q (nothing yet, system, user,
assistant); its rules are ``[p>q] -> [p>r] [r>q]`` over spans and, for one row, keep, rerole or delete
between any insertions (the insertion closure).  The cell of a symbol over a span holds its least
(cost, audit).  Spans are combined bottom-up by length.  Since joining cells is associative, one split
of a span gives the same cells as all of them, so spans of 1, 2, 4, ... rows suffice.  Equal costs never leave
one audit the beginning of another (they spend as many edits on rows, and inserting costs), so the
smaller of two audits stays the smaller whatever follows.

Because spans join, no conversation must fit a task: long ones are parsed in blocks of rows, and
Spark joins the blocks' cells in rounds.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablevet.llm.textcodes import crc32_sql, let_go
from tablevet.sources.scratch import staged

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5  # costs
BLOCK_ROWS = 4096  # longer conversations are parsed in blocks
BLOCK_CHARS = 1 << 24  # so are those with more text
FAN_IN = 16  # blocks joined at once
SALTS = 16
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # states: what the last role was
_AFTER = {(NOTHING, "s"): SYSTEM, (USER, "a"): ASSISTANT} | {(p, "u"): USER for p in (NOTHING, SYSTEM, ASSISTANT)}
_LEGAL = {"su", "ua", "au"}
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Cells:
    """The least (cost, audit) from each state to each; compared by identity, so that pairs can be looked up."""

    __slots__ = ("of",)

    def __init__(self, of: tuple):
        self.of = of

    def __getstate__(self):
        return self.of

    def __setstate__(self, of):
        self.of = of


def _joined(x: Cells, y: Cells) -> Cells:
    out = []
    for p in range(4):
        for q in range(4):
            best = None
            for r in range(4):
                a, b = x.of[4 * p + r], y.of[4 * r + q]
                if a is None or b is None:
                    continue
                cost = a[0] + b[0]
                if best is None or cost <= best[0]:
                    found = (cost, a[1] + b[1])
                    if best is None or found < best:
                        best = found
            out.append(best)
    return Cells(tuple(out))


def _cells(steps: Iterable[tuple[int, int, int, str]]) -> Cells:
    out: list = [None] * 16
    for p, q, cost, audit in steps:
        if out[4 * p + q] is None or (cost, audit) < out[4 * p + q]:
            out[4 * p + q] = (cost, audit)
    return Cells(tuple(out))


def _closure() -> Cells:
    """Any number of inserted turns between two rows; more than one of each role never helps."""
    none = [(p, p, 0, "") for p in range(4)]
    one = _cells(none + [(p, _AFTER[p, c], INSERT, "I") for p in range(4) for c in "ua" if (p, c) in _AFTER])
    return _joined(one, one)


_INSERTED = _closure()


@lru_cache(maxsize=256)
def row_cells(initial: str, may_stay: bool, truncated: bool) -> Cells:
    """Cells of one row; ``initial`` is s, u, a, or none of them; rows that may not stay are deleted."""
    steps = [(p, p, DELETE, "D") for p in range(4)]
    if may_stay:
        more = TRUNCATED if truncated else 0
        for p in range(4):
            steps += [(p, _AFTER[p, c], REROLE + more, "R") for c in "ua" if (p, c) in _AFTER]
            if (p, initial) in _AFTER:
                steps.append((p, _AFTER[p, initial], more, "K"))
    return _joined(_joined(_INSERTED, _cells(steps)), _INSERTED)


@lru_cache(maxsize=1)
def _deletions(n: int) -> Cells:
    return _joined(_joined(_INSERTED, _cells([(p, p, DELETE * n, "D" * n) for p in range(4)])), _INSERTED)


_known = lru_cache(maxsize=1 << 12)(_joined)  # of spans of few rows, which recur


class Span(NamedTuple):
    """What is known about consecutive rows of a conversation; spans side by side join into one."""

    rows: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str  # role initials at the ends
    last: str
    low: int | None  # turns; nulls come first and count for nothing
    high: int | None
    turns: int
    cells: Cells

    def join(self, right: Span) -> Span:
        same = self.high is not None and self.high == right.low
        join = _known if self.rows + right.rows <= 8 else _joined
        return Span(
            self.rows + right.rows,
            self.blank + right.blank,
            self.duplicate + right.duplicate,
            self.truncated + right.truncated,
            self.illegal + right.illegal + (self.last + right.first not in _LEGAL),
            self.first,
            right.last,
            right.low if self.low is None else self.low,
            self.high if right.high is None else right.high,
            self.turns + right.turns - same,
            join(self.cells, right.cells),
        )

    def cheapest(self) -> tuple[int, str]:
        return min(x for x in (self.cells.of[NOTHING], self.cells.of[ASSISTANT]) if x is not None)

    def result(self) -> list:
        cost, audit = self.cheapest()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit]


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "?"


def row_spans(turn: int | None, role: str, blank: bool, duplicate: bool, truncated: bool, copies: int) -> list[Span]:
    """A row, and its adjacent copies, which are duplicates (of a blank row: blank)."""
    initial, turns = _initial(role), int(turn is not None)
    duplicate, truncated = duplicate and not blank, truncated and not blank and not duplicate
    cells = row_cells(initial, not blank and not duplicate, truncated)
    out = [Span(1, int(blank), int(duplicate), int(truncated), 0, initial, initial, turn, turn, turns, cells)]
    if more := copies - 1:
        illegal = (more - 1) * (initial * 2 not in _LEGAL)
        out.append(Span(more, more * blank, more * (not blank), 0, illegal, initial, initial, turn, turn, turns, _deletions(more)))
    return out


def parsed(spans: list[Span]) -> Span:
    """One span of all, bottom-up by length."""
    while len(spans) > 1:
        pairs = [a.join(b) for a, b in zip(spans[::2], spans[1::2])]
        spans = pairs + spans[len(pairs) * 2 :]
    return spans[0]


class Repaired:
    """The digest of a repaired conversation, taken row by row along its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.begun = audit, 0, NOTHING, hashlib.sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.state = _AFTER[self.state, role[0]]
        self.digest.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
        self.begun = True

    def _role(self) -> str:
        return "assistant" if self.state == USER else "user"

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._write(self._role(), "")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self._insert()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                self._write(role if edit == "K" else self._role(), text)

    def end(self) -> str:
        self._insert()
        return self.digest.hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: turns with planted faults, equal ones as one row; lazy.

    By crc32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its text, 2 removes ``.!?``, 3
    repeats it and 4 sets its role to user.  Nulls are read as one space, but a null turn stays one,
    and so does a null conv_id.  A conversation that loses all rows keeps a row of 0 copies.
    """
    role, text = "coalesce(role, ' ')", "coalesce(text, ' ')"
    key = "concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' '))"
    kinds = turns.selectExpr("conv_id", "CAST(turn AS BIGINT) AS turn", f"{role} AS role", f"{text} AS text", f"crc32(CAST({key} AS BINARY)) % 20 AS kind")
    rows = kinds.selectExpr(
        "conv_id", "IF(kind = 0, NULL, turn) AS turn", "CASE kind WHEN 0 THEN '' WHEN 4 THEN 'user' ELSE role END AS role",
        "CASE kind WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '') ELSE text END AS text",
        "CASE kind WHEN 0 THEN 0L WHEN 3 THEN 2L ELSE 1L END AS copies",
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def _flags(rows: DataFrame) -> DataFrame:
    inked = r"[^\x20\x09-\x0D]"
    return rows.selectExpr(
        "conv_id", "turn", "role", "text", "copies",
        f"NOT text RLIKE r'{inked}' AS blank", r"NOT text RLIKE r'[.!?][\x20\x09-\x0D]*\z' AS truncated",
    )


_ORDER = ("turn", "role", "text")  # nulls first; ties of turn by role and text


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs the conversations of a sorted partition, one after the other."""
    let_go()
    schema = None
    done: list[list] = []
    rows: list[tuple] = []

    def finish():
        spans, seen = [], set()
        present = [r for r in rows if r[4]]
        for _, turn, role, text, copies, blank, truncated in present:
            spans += row_spans(turn, role, blank, (role, text) in seen, truncated, copies)
            seen.add((role, text))
        if not spans:
            return [rows[0][0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()]
        result = parsed(spans).result()
        repaired = Repaired(result[-1])
        for _, _, role, text, copies, _, _ in present:
            repaired.row(role, text, copies)
        return [rows[0][0], *result, repaired.end()]

    for batch in batches:
        schema = schema or pa.schema([batch.schema.field("conv_id"), *_RESULT_FIELDS])
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != rows[0][0]:
                done.append(finish())
                rows.clear()
            rows.append(row)
        yield _batch(done, schema)
        done.clear()
    if rows:
        done.append(finish())
        yield _batch(done, schema)


_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT_FIELDS = [*(pa.field(n, pa.int64()) for n in _LONGS), pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())]


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv_id, part, seq, span`` of the blocks in one range of the sorted rows."""
    let_go()
    part, seq, schema = TaskContext.get().partitionId(), 0, None
    spans: list[Span] = []
    conv: object = None
    done: list[list] = []
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field("conv_id"), ("part", pa.int64()), ("seq", pa.int64()), ("span", pa.binary())])
        for own, turn, role, copies, blank, duplicate, truncated in zip(*(c.to_pylist() for c in batch.columns)):
            if spans and (own != conv or len(spans) >= BLOCK_ROWS):
                done.append([conv, part, seq, pickle.dumps(parsed(spans))])
                seq, spans = seq + 1, []
            conv = own
            spans += row_spans(turn, role, blank, duplicate, truncated, copies)
        yield _batch(done, schema)
        done.clear()
    if spans:
        yield _batch([[conv, part, seq, pickle.dumps(parsed(spans))]], schema)


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("block")
    out = group.head(1).copy()
    out["block"] = out["block"] // FAN_IN
    out["span"] = pickle.dumps(parsed([pickle.loads(s) for s in group["span"]]))
    return out


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [pickle.loads(s.as_py()).result() for s in batch.column("span")]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * 7, _RESULT_FIELDS)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", *_LONGS, "audit"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's row of results, which comes first, with the digest of its rows."""
    let_go()
    result, repaired, schema = None, None, None
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field("conv_id"), *_RESULT_FIELDS])
        done = []
        for conv, is_row, _, role, text, copies, *own in zip(*(c.to_pylist() for c in batch.columns)):
            if not is_row:
                if result is not None:
                    done.append([*result, repaired.end()])
                result, repaired = [conv, *own], Repaired(own[-1])
            else:
                repaired.row(role, text, copies)
        yield _batch(done, schema)
    if result is not None:
        yield _batch([[*result, repaired.end()]], schema)


def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    on = left["conv_id"].eqNullSafe(right["conv_id"])
    for n in names:
        on &= left[n] == right[n]
    return on


def _long(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations of any length, in blocks: ranges of the sorted rows, so one conversation is in many tasks."""
    rows = staged(rows.filter("copies > 0").withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS))))
    told = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    again = rows.groupBy("conv_id", "role", "text").agg(F.min(told).alias("at"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = staged(again).withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    marked = rows.join(again, _same(rows, again, "role", "text", "salt"), "left")
    marked = marked.select(*(rows[c] for c in rows.columns), F.coalesce(~rows["turn"].eqNullSafe(F.col("at.turn")) & F.col("at").isNotNull(), F.lit(False)).alias("duplicate"))
    ranged = staged(marked).repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)
    blocks = ranged.select("conv_id", "turn", "role", "copies", "blank", "duplicate", "truncated")
    blocks = staged(blocks.mapInArrow(_blocks, f"conv_id {kind}, part bigint, seq bigint, span binary"))
    place = Window.partitionBy("conv_id").orderBy("part", "seq")
    blocks = staged(blocks.select("conv_id", (F.row_number().over(place) - 1).cast("bigint").alias("block"), "span"))
    while not blocks.filter("block > 0").isEmpty():
        near = blocks.groupBy("conv_id", (F.col("block") / FAN_IN).cast("bigint").alias("of"))
        blocks = staged(near.applyInPandas(_merged, f"conv_id {kind}, block bigint, span binary"))
    longs = ", ".join(f"{n} bigint" for n in _LONGS)
    found = staged(blocks.mapInArrow(_results, f"conv_id {kind}, {longs}, audit string"))

    heads = found.selectExpr("conv_id", "0 AS is_row", "CAST(NULL AS BIGINT) AS turn", "'' AS role", "'' AS text", "0L AS copies", *_LONGS, "audit")
    nulls = [f"CAST(NULL AS BIGINT) AS {n}" for n in _LONGS]
    every = heads.unionByName(rows.selectExpr("conv_id", "1 AS is_row", "turn", "role", "text", "copies", *nulls, "CAST(NULL AS STRING) AS audit"))
    ordered = every.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *_ORDER)
    return ordered.mapInArrow(_hashed, f"conv_id {kind}, {RESULT}")


def repaired_conversations(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each conv_id: what is wrong with its turns, the cheapest repair, and its digest.

    ``rows`` has ``conv_id, turn, role, text, copies`` (see :func:`damaged`); a conversation's rows are
    taken by turn, nulls first, ties by role and text, ``copies`` side by side.  ``gaps``: turn
    numbers missing between the least and the largest; ``blank``, ``duplicate`` (role and text seen
    earlier), ``truncated`` (the last inked character is none of ``.!?``): rows by their first fault;
    ``illegal``: neighbours whose initials are not su, ua or au; ``cost``, ``audit``: the cheapest
    edits, Keep, Rerole (1), Delete (2), Insert (5), a truncated row that stays adding 5, of equal cost the
    smallest in ASCII; ``repaired_sha256``: of the repaired ``role:text`` lines.  Blank and duplicate
    rows must go.  A role that begins with none of s, u, a (the empty one too) cannot be kept.  A null
    conv_id is a conversation; one with no rows left has zeros, an empty audit and the digest of nothing.

    Conversations of up to ``block_rows`` rows are repaired whole inside a task.  Longer ones are
    parsed in blocks in many tasks and joined in rounds; only their digest, which SHA-256 defines
    over the text in order, is taken by one task, as a stream that holds the audit and a batch of rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = staged(_flags(rows))
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = staged(sizes.filter((F.col("n") > block_rows) | (F.col("chars") > BLOCK_CHARS)).select("conv_id"))
    short, rest = rows, None
    if not long.isEmpty():
        short = rows.join(long, _same(rows, long), "left_anti")
        rest = _long(rows.join(long, _same(rows, long), "left_semi"), kind)
    ordered = short.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    found = ordered.mapInArrow(_short, f"conv_id {kind}, {RESULT}")
    return found if rest is None else found.unionByName(rest)


def repaired_sql() -> str:
    """The same over damaged ``conversations`` in DuckDB's SQL: states row by row, then the lines of each audit."""
    crc = crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    space = r"\x20\x09-\x0D"
    return rf"""
WITH RECURSIVE kinds AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind
    FROM conversations),
rows_left AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM kinds, range(2) AS t(c) WHERE kind != 0 AND (c = 0 OR kind = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_left),
flagged AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS initial,
        CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 'blank'
             WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
             WHEN NOT regexp_matches(text, '[.!?][{space}]*$') THEN 'truncated' ELSE '' END AS fault
    FROM numbered),
steps(p, c, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
inserted(p, q, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, {INSERT}, 'I'), (1, 2, {INSERT}, 'I'),
    (3, 2, {INSERT}, 'I'), (2, 3, {INSERT}, 'I'), (0, 3, {2 * INSERT}, 'II'), (1, 3, {2 * INSERT}, 'II')),
edits AS (SELECT conv_id, i, s.p, s.p AS q, {DELETE} AS cost, 'D' AS audit FROM flagged, (SELECT DISTINCT p FROM inserted) s
    UNION ALL SELECT conv_id, i, p, q, CASE fault WHEN '' THEN 0 ELSE {TRUNCATED} END, 'K' FROM flagged JOIN steps ON c = initial WHERE fault IN ('', 'truncated')
    UNION ALL SELECT conv_id, i, p, q, {REROLE} + CASE fault WHEN '' THEN 0 ELSE {TRUNCATED} END, 'R' FROM flagged JOIN steps ON c != 's'
        WHERE fault IN ('', 'truncated')),
sizes AS (SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
    FROM flagged GROUP BY conv_id),
best AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, q, {{'cost': cost, 'audit': audit}} AS least FROM sizes, inserted WHERE p = 0
    UNION ALL SELECT b.conv_id, e.i, t.q, min({{'cost': b.least.cost + e.cost + t.cost, 'audit': b.least.audit || e.audit || t.audit}})
    FROM best b JOIN edits e ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = b.i + 1 AND e.p = b.q JOIN inserted t ON t.p = e.q
    GROUP BY b.conv_id, e.i, t.q),
chosen AS (SELECT b.conv_id, min(least) AS least FROM best b JOIN sizes z ON b.conv_id IS NOT DISTINCT FROM z.conv_id AND b.i = z.n WHERE q IN (0, 3) GROUP BY b.conv_id),
edited AS (SELECT conv_id, k, edit, count(*) FILTER (edit != 'I') OVER own AS i, count(*) FILTER (edit != 'D') OVER own AS line_no
    FROM (SELECT conv_id, k, substr(least.audit, k, 1) AS edit FROM (SELECT *, unnest(range(1, length(least.audit) + 1)) AS k FROM chosen))
    WINDOW own AS (PARTITION BY conv_id ORDER BY k)),
lines AS (SELECT e.*, f.role, f.text, max(CASE WHEN e.line_no = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS shift
    FROM edited e LEFT JOIN flagged f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.i = f.i WHERE edit != 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (line_no - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS text FROM lines GROUP BY conv_id),
pairs AS (SELECT conv_id, count(*) AS n FROM
    (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM flagged) WHERE two NOT IN ('su', 'ua', 'au') GROUP BY conv_id)
SELECT o.conv_id, coalesce(z.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(pairs.n, 0) AS illegal, CAST(coalesce(least.cost, 0) AS BIGINT) AS cost, coalesce(least.audit, '') AS audit, sha256(coalesce(repaired.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sizes z ON o.conv_id IS NOT DISTINCT FROM z.conv_id
LEFT JOIN chosen ON o.conv_id IS NOT DISTINCT FROM chosen.conv_id LEFT JOIN repaired ON o.conv_id IS NOT DISTINCT FROM repaired.conv_id
LEFT JOIN pairs ON o.conv_id IS NOT DISTINCT FROM pairs.conv_id
"""
