"""Quality rules whose thresholds come from the corpus: one for each rule, language and source.

One pass over the texts measures every document.  The measures of a rule are whole numbers (shares
in units of 1 / ``UNITS``) and go into a quantile sketch of each language and source: counts of
log-linear buckets, ``BUCKETS_AN_OCTAVE`` to a power of two, so a quantile is off by less than one
part in that many.  Sketches merge by adding counts, whatever the order: those of partitions or
days to one of the source, those of sources to one of the language.  Thresholds are read off the
sketches and joined with the measures.  Everything is built of DataFrame and SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablevet.sources.scratch import staged

UNITS = 10_000
BUCKETS_AN_OCTAVE = 64
LEAST_DOCUMENTS = 100  # smaller groups take the thresholds of the language, then of all
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
BROADCAST_GROUPS = 20_000  # thresholds of so many groups (under 3 MB) are sent to the tasks
SALTS = 64  # of the join beyond it
_SPACE = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must stay within fences around the quartiles of its group.

    A fence lies ``reach`` times the distance from median to quartile beyond the quartile, and at
    least ``slack`` (in units) beyond it: a group whose documents are all alike is not cut to the
    bone.  ``low`` adds a fence below.
    """

    name: str
    numerator: str
    denominator: str
    reach: int
    slack: int
    low: bool = False

    def measure(self) -> str:
        return f"coalesce(({self.numerator} * {UNITS}L) DIV nullif({self.denominator}, 0), 0L)"


RULES = (
    Rule("word_length", "word_chars", "n_words", reach=4, slack=12_000, low=True),
    Rule("symbol_share", "n_symbols", "word_chars", reach=4, slack=300),
    Rule("dup_line_share", "n_dup_lines", "n_lines", reach=4, slack=5_000),
    Rule("repeat_share", "n_repeat_words", "n_words", reach=4, slack=4_000),
)


def _repeated_words(words: str) -> str:
    """How many words lie in a run of three that occurs twice or more; SQL over an array of words.

    Runs are sorted with their places, so equal ones stand side by side.  Each array is bound to a
    name once (``transform`` over an array of one) rather than written out where it is used.
    """
    runs = "transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> struct(x AS a, w[i + 1] AS b, w[i + 2] AS c, i AS i))"
    twice = (
        "zip_with(r, slice(r, 2, size(r)), (x, y) ->"
        " IF(x.c = y.c AND x.b = y.b AND x.a = y.a, array(x.i, x.i + 1, x.i + 2, y.i, y.i + 1, y.i + 2), CAST(NULL AS array<int>)))"
    )
    return f"transform(array({words}), w -> transform(array(sort_array({runs})), r -> size(array_distinct(flatten(array_compact({twice}))))))[0][0]"


def text_measures(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the whole-number measures of each text; lazy, one scan.

    Words are runs of characters other than ASCII white space.  ``word_chars``: their code points;
    ``n_symbols``: characters of ``#*$%&|<>``; ``n_lines``: lines (cut at line feeds) with a word, of
    which ``n_dup_lines`` equal an earlier one; ``n_repeat_words``: words inside a run of three
    that the text holds twice or more.  A null text has no words.
    """
    text = "coalesce(text, '')"
    inked = f"regexp_replace({text}, r'[{_SPACE}]+', ' ')"
    # one leading space at most and one at the end are left: cut, then an empty text has no word
    words = f"filter(split({inked}, ' '), x -> x != '')"
    lines = rf"filter(split({text}, '\n'), x -> x RLIKE r'[^{_SPACE}]')"
    shaped = docs.selectExpr(
        "doc_id", "lang", "source",
        f"transform(array({words}), w -> struct(size(w) AS n, CAST(aggregate(w, 0L, (s, x) -> s + length(x)) AS BIGINT) AS chars,"
        f" {_repeated_words('w')} AS repeated))[0] AS w",
        f"transform(array({lines}), l -> struct(size(l) AS n, size(array_distinct(l)) AS kinds))[0] AS l",
        f"length({text}) - length(translate({text}, '#*$%&|<>', '')) AS n_symbols",
    )
    return shaped.selectExpr(
        "doc_id", "lang", "source", "CAST(w.n AS BIGINT) AS n_words", "w.chars AS word_chars", "CAST(n_symbols AS BIGINT) AS n_symbols",
        "CAST(l.n AS BIGINT) AS n_lines", "CAST(l.n - l.kinds AS BIGINT) AS n_dup_lines", "CAST(w.repeated AS BIGINT) AS n_repeat_words",
    )


def _bucket(x: str) -> str:
    """Number of the log-linear bucket of a whole number from 0: the lowest value that it holds."""
    shift = f"greatest(length(bin({x})) - {BUCKETS_AN_OCTAVE.bit_length()}, 0)"
    return f"shiftleft(shiftright({x}, {shift}), {shift})"


def sketches(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``lang, source, rule, bucket, n``: the quantile sketches of all rules by language and source.

    A document adds one count a rule, combined inside each task before the shuffle.  Sketches of several
    inputs merge by :func:`merged`.
    """
    cells = ", ".join(f"struct('{r.name}' AS rule, {_bucket(r.measure())} AS bucket)" for r in rules)
    return measured.selectExpr("lang", "source", f"inline(array({cells}))").groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))


def merged(counts: DataFrame, *keys: str) -> DataFrame:
    """Sketches merged over all but ``keys``."""
    return counts.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def _quartiles(counts: DataFrame, rules: tuple[Rule, ...], *keys: str) -> DataFrame:
    """``keys, docs, <rule>_q1, _q2, _q3``: the values of ranks ceil(n/4), ceil(n/2), ceil(3n/4) of each rule."""
    own = Window.partitionBy(*keys, "rule")
    up_to = counts.withColumn("docs", F.sum("n").over(own)).withColumn("upto", F.sum("n").over(own.orderBy("bucket")))
    ranked = up_to.groupBy(*keys, "rule").agg(
        F.max("docs").alias("docs"), *[F.expr(f"min(CASE WHEN upto * 4 >= docs * {q} THEN bucket END) AS q{q}") for q in (1, 2, 3)]
    )
    wide = [F.max(F.when(F.col("rule") == r.name, F.col(f"q{q}"))).alias(f"{r.name}_q{q}") for r in rules for q in (1, 2, 3)]
    return ranked.groupBy(*keys).agg(F.max("docs").alias("docs"), *wide)


def thresholds(counts: DataFrame, rules: tuple[Rule, ...] = RULES, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, source`` and the fences ``<rule>_low, <rule>_high`` of every group of the sketches.

    Groups of fewer than ``least_documents`` documents take the quartiles of their language, and
    languages with fewer those of all documents.  A null language or source is a group like others.
    """
    by_source = staged(_quartiles(counts, rules, "lang", "source"))
    by_lang = staged(_quartiles(merged(counts, "lang"), rules, "lang"))
    overall = _quartiles(merged(counts), rules)
    cells = [f"{r.name}_q{q}" for r in rules for q in (1, 2, 3)]

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])

    both = by_source.join(named(by_lang, "l_"), F.col("lang").eqNullSafe(F.col("l_lang"))).crossJoin(F.broadcast(named(overall, "o_")))  # one row
    level = f"CASE WHEN docs >= {least_documents} THEN {{0}} WHEN l_docs >= {least_documents} THEN l_{{0}} ELSE o_{{0}} END AS {{0}}"
    chosen = both.selectExpr("lang", "source", *[level.format(c) for c in cells])
    fences = []
    for r in rules:
        q1, q2, q3 = (f"{r.name}_q{q}" for q in (1, 2, 3))
        fences.append(f"{q3} + greatest({r.reach} * ({q3} - {q2}), {r.slack}) AS {r.name}_high")
        fences.append(f"{q1} - greatest({r.reach} * ({q2} - {q1}), {r.slack}) AS {r.name}_low" if r.low else f"0L AS {r.name}_low")
    return chosen.selectExpr("lang", "source", *fences)


def base_failed() -> str:
    return f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``doc_id, lang, source``, the measures, ``base_failed, failed_rules`` and ``kept`` of every document.

    Thresholds are learned from all documents that pass the base rule, by language and source.  A
    document is kept if it passes the base rule and lies within all fences of its group.  Null and empty
    texts fail the base rule; a null language or source is a group of its own; repeated rows are
    judged alike and all stay; without any document that passes there are no fences to meet.
    Columns of the input other than ``doc_id, text, lang, source`` are left out.

    The measures are written once, so texts are read once.  Fences meet them by a join: sent to
    the tasks where :data:`BROADCAST_GROUPS` bounds them, else joined with each group cut by salt.
    """
    measured = staged(text_measures(docs.select("doc_id", "text", "lang", "source")).withColumn("base_failed", F.expr(base_failed())))
    counts = staged(sketches(measured.filter("NOT base_failed"), rules))
    fences = staged(thresholds(counts, rules, least_documents))
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    found = fences.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    if fences.count() <= BROADCAST_GROUPS:
        met = measured.join(F.broadcast(found), same, "left")
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        found = found.withColumn("t_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        met = measured.withColumn("salt", salt).join(found, same & (F.col("salt") == F.col("t_salt")), "left")
    failed = [_outside(r) for r in rules]
    met = met.withColumn("failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*failed))))
    return met.select(*measured.columns, "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def _outside(rule: Rule) -> Column:
    return F.expr(f"IF({rule.measure()} NOT BETWEEN {rule.name}_low AND {rule.name}_high, '{rule.name}', NULL)")


# ------------------------------------------------------------------ the same in plain SQL


def judged_sql(rules: tuple[Rule, ...] = RULES, least_documents: int = LEAST_DOCUMENTS) -> str:
    """The query over ``documents`` whose rows :func:`judged` gives, in DuckDB's SQL."""
    octave = BUCKETS_AN_OCTAVE.bit_length()

    def measure(r: Rule) -> str:
        return f"coalesce(({r.numerator} * {UNITS}) // nullif({r.denominator}, 0), 0)"

    def quartiles(keys: str, source: str) -> str:
        cells = ", ".join(
            f"max(CASE WHEN rule = '{r.name}' THEN q{q} END) AS {r.name}_q{q}" for r in rules for q in (1, 2, 3)
        )
        parts = ", ".join([*filter(None, [keys]), "rule"])
        group = f"GROUP BY {keys}" if keys else ""
        head = f"{keys}, " if keys else ""
        return (
            f"SELECT {head}max(docs) AS docs, {cells} FROM (SELECT {parts}, max(docs) AS docs, "
            + ", ".join(f"min(CASE WHEN upto * 4 >= docs * {q} THEN bucket END) AS q{q}" for q in (1, 2, 3))
            + f" FROM (SELECT *, sum(n) OVER (PARTITION BY {parts}) AS docs, sum(n) OVER (PARTITION BY {parts} ORDER BY bucket) AS upto"
            f" FROM (SELECT {parts}, bucket, count(*) AS n FROM {source} GROUP BY {parts}, bucket)) GROUP BY {parts}) {group}"
        )

    cells = "\nUNION ALL ".join(f"SELECT lang, source, '{r.name}' AS rule, {measure(r)} AS x FROM measured WHERE NOT base_failed" for r in rules)
    level = f"CASE WHEN s.docs >= {least_documents} THEN s.{{0}} WHEN l.docs >= {least_documents} THEN l.{{0}} ELSE o.{{0}} END"
    fences = []
    for r in rules:
        q1, q2, q3 = (level.format(f"{r.name}_q{q}") for q in (1, 2, 3))
        low = f"{q1} - greatest({r.reach} * ({q2} - {q1}), {r.slack})" if r.low else "0"
        fences.append(f"{low} AS {r.name}_low, {q3} + greatest({r.reach} * ({q3} - {q2}), {r.slack}) AS {r.name}_high")
    inside = " AND ".join(f"coalesce({measure(r)} BETWEEN {r.name}_low AND {r.name}_high, true)" for r in rules)
    space = r"\x20\x09-\x0D"
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row_no, text, regexp_extract_all(text, '[^{space}]+') AS w FROM texts),
runs AS (SELECT row_no, i, [w[i], w[i + 1], w[i + 2]] AS run
    FROM (SELECT row_no, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM words)),
repeats AS (SELECT row_no, count(DISTINCT i + d) AS n FROM
    (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, run) AS times FROM runs), range(3) AS t(d) WHERE times > 1 GROUP BY row_no),
lines AS (SELECT row_no, count(*) AS n, count(*) - count(DISTINCT line) AS dups
    FROM (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^{space}]') GROUP BY row_no),
measured AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM (
    SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(words.text, '[{space}]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(words.text) - length(regexp_replace(words.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(lines.n, 0) AS n_lines, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
    FROM texts JOIN words USING (row_no) LEFT JOIN repeats USING (row_no) LEFT JOIN lines USING (row_no))),
cells AS (SELECT lang, source, rule, (x >> greatest(length(bin(x)) - {octave}, 0)) << greatest(length(bin(x)) - {octave}, 0) AS bucket FROM ({cells})),
by_source AS ({quartiles("lang, source", "cells")}),
by_lang AS ({quartiles("lang", "cells")}),
overall AS ({quartiles("", "cells")}),
fences AS (SELECT s.lang, s.source, {", ".join(fences)}
    FROM by_source s JOIN by_lang l ON s.lang IS NOT DISTINCT FROM l.lang, overall o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept
FROM measured LEFT JOIN fences ON measured.lang IS NOT DISTINCT FROM fences.lang AND measured.source IS NOT DISTINCT FROM fences.source
"""
