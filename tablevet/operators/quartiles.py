"""Quartiles with linear interpolation, exact at any table size."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row

from tablevet.functions.values import sql_double
from tablevet.operators.fused import MAX_AGGREGATES, FusedScan

QUARTILES = (0.25, 0.75)
# Interval size up to which one aggregate buffer may hold its values.
PICK_LIMIT = 200_000
# Values that all buffers of one aggregate may hold together.
_BUFFER_BUDGET = 8_000_000
_SAMPLE_SIZE = 100_000
# Guide points around a wanted rank, in standard errors of the sample.
_SPREAD = (-4.0, 4.0)
# Size of the first sketch, and how far in rank its guides lie from a quartile: twice its error.
_SKETCH_K = 1024
_SKETCH_MARGIN = 0.008
# A bracket is read whole when so many times the values expected in it fit the limit.
_SLACK = 1.5
_DRAW = "__draw"
# Each round shrinks an interval by orders of magnitude; this many cannot be needed.
_MAX_ROUNDS = 50


def approximate_quartiles(x: str) -> str:
    """Aggregate: [q1, q3] with relative rank error 0.01."""
    return f"percentile_approx({x}, array{QUARTILES}, 100)"


@dataclass
class _Search:
    """The open value interval known to hold one order statistic of one column."""

    name: str
    x: str  # double expression
    rank: int  # zero-based, among all non-null values
    size: int  # values strictly inside (low, high)
    low: float | None = None
    high: float | None = None
    below: int = 0  # values <= low
    guides: tuple[float, float] | None = None  # values inside that should enclose it
    span: float = 1.0  # share of the values inside expected between the guides
    value: float | None = None

    def move(self, bracket: tuple[float, float], found: Row) -> bool:
        """Shrink to what the counts at the guides leave; true if that lies between them."""
        (a, b), above = bracket, self.below + self.size
        self.guides = None
        if found["a_lt"] <= self.rank < found["a_le"]:
            self.value = a
        elif found["b_lt"] <= self.rank < found["b_le"]:
            self.value = b
        elif self.rank < found["a_lt"]:
            self.high, above = a, found["a_lt"]
        elif self.rank >= found["b_le"]:
            self.low, self.below = b, found["b_le"]
        else:
            self.low, self.below, self.high, above = a, found["a_le"], b, found["b_lt"]
            self.size = above - self.below
            return True
        self.size = above - self.below
        return False


def quartiles(
    df: DataFrame,
    columns: Mapping[str, tuple[str, int]],
    pick_limit: int = PICK_LIMIT,
    guides: Mapping[str, list[float]] | None = None,
) -> dict[str, tuple[float, float]]:
    """Exact (q1, q3) per entry; ``columns`` gives a double expression and its non-null count.

    Spark's ``percentile`` keeps every distinct value of a column in one task.  Here a quantile
    sketch proposes values on both sides of the wanted ranks, and each scan over all rows counts how many
    values lie below them while it takes the values in between: all of them if they fit one buffer,
    else a sample that proposes the next ones.  So n rounds take n + 1 scans, that of the sketch included, which
    ``guides`` (of :func:`guide_scan`) saves where it was made before.  Sketch and samples only guide
    the search: every decision rests on a count over all rows.  Nothing is shuffled but one row a task.
    """
    present = {name: (x, n) for name, (x, n) in columns.items() if n > 0}
    large = {name: x for name, (x, n) in present.items() if n > pick_limit}
    if guides is None:
        guides = guide_scan(df, large) if large else {}
    wanted = {}
    for name, (x, n) in present.items():
        for i, q in enumerate(QUARTILES):
            for rank in _neighbours(q, n):
                s = wanted[name, rank] = _Search(name, x, rank, n)
                if name in guides:
                    a, b = guides[name][2 * i : 2 * i + 2]
                    s.guides, s.span = (a, b), 2 * _SKETCH_MARGIN
    _resolve(df, list(wanted.values()), pick_limit)
    return {
        name: tuple(
            _interpolate(q, n, [wanted[name, r].value for r in _neighbours(q, n)])
            for q in QUARTILES
        )
        for name, (_, n) in present.items()
    }


def _neighbours(q: float, n: int) -> tuple[int, int]:
    lower = math.floor(q * (n - 1))
    return lower, min(lower + 1, n - 1)


def _interpolate(q: float, n: int, values: list[float]) -> float:
    position = q * (n - 1)
    fraction = position - math.floor(position)
    if fraction == 0:
        return values[0]
    return (1 - fraction) * values[0] + fraction * values[1]


# ------------------------------------------------------------------ guides from a sketch


def sketched_guides(x: str) -> str:
    """Aggregate: values a little below and above each quartile, from a mergeable quantile sketch."""
    shares = ", ".join(f"{q + side * _SKETCH_MARGIN}e0" for q in QUARTILES for side in (-1, 1))
    return f"kll_sketch_get_quantile_double(kll_sketch_agg_double({x}, {_SKETCH_K}), array({shares}))"


def guide_scan(df: DataFrame, columns: Mapping[str, str]) -> dict[str, list[float]]:
    """:func:`sketched_guides` of every double expression, from one scan; columns without a value have none."""
    scan = FusedScan()
    for name, x in columns.items():
        scan.want(name, f"IF(count({x}) > 0, {sketched_guides(x)}, NULL)", group=name)
    return {name: guides for name, guides in scan.run(df).items() if guides}


# ------------------------------------------------------------------ rounds


def _resolve(df: DataFrame, searches: list[_Search], pick_limit: int) -> None:
    open_ = searches
    for round_ in range(_MAX_ROUNDS):
        if not open_:
            return
        for batch in _batches([_Draw.of(same, pick_limit) for same in _by_bracket(open_, pick_limit)]):
            _scan(df, batch, seed=round_)
        open_ = [s for s in open_ if s.value is None]
    raise RuntimeError("quartile search does not settle: the source changes between scans")


def _by_bracket(searches: list[_Search], pick_limit: int) -> list[list[_Search]]:
    """Searches of one column that look into the same bracket share their scan work."""
    groups: dict[tuple, list[_Search]] = {}
    for s in searches:
        groups.setdefault((s.name, s.low, s.high, s.guides if s.size > pick_limit else None), []).append(s)
    return list(groups.values())


@dataclass
class _Draw:
    """What one scan takes from one column: values inside a bracket, and counts at bounds that are new."""

    same: list[_Search]
    bracket: tuple[float | None, float | None]
    counted: bool  # the bracket's bounds are guides, whose ranks this scan counts
    share: float  # of the values inside that are taken; 1 takes all
    expected: int

    @classmethod
    def of(cls, same: list[_Search], pick_limit: int) -> _Draw:
        s = same[0]
        if s.size > pick_limit and s.guides:
            inside = max(1, math.ceil(s.size * s.span))
            share = 1.0 if inside * _SLACK <= pick_limit else min(1.0, _SAMPLE_SIZE / inside)
            return cls(same, s.guides, True, share, math.ceil(inside * share))
        share = 1.0 if s.size <= pick_limit else _SAMPLE_SIZE / s.size
        return cls(same, (s.low, s.high), False, share, math.ceil(s.size * share))

    def inside(self) -> str:
        x, (a, b) = self.same[0].x, self.bracket
        bounds = [f"{x} IS NOT NULL"]
        bounds += [f"{x} > {sql_double(a)}"] if a is not None else []
        bounds += [f"{x} < {sql_double(b)}"] if b is not None else []
        return " AND ".join(bounds)

    def aggregates(self, i: int) -> list[str]:
        x, chosen = self.same[0].x, self.inside()
        if self.share < 1:
            chosen += f" AND {_DRAW} < {sql_double(self.share)}"
        out = [f"sort_array(collect_list(CASE WHEN {chosen} THEN {x} END)) AS v{i}"]
        if self.counted:
            for name, bound in zip("ab", self.bracket):
                out += [f"count_if({x} < {sql_double(bound)}) AS {name}{i}_lt", f"count_if({x} <= {sql_double(bound)}) AS {name}{i}_le"]
        return out

    def finish(self, i: int) -> str:
        """One struct: the counts, and for each search its value (all were taken) or its next guides."""
        s = self.same[0]
        below, above = (f"a{i}_le", f"b{i}_lt") if self.counted else (f"{s.below}L", f"{s.below + s.size}L")
        fields = [f"CAST(size(v{i}) AS BIGINT) AS taken"]
        fields += [f"{c}{i}_{k} AS {c}_{k}" for c in "ab" for k in ("lt", "le")] if self.counted else []
        for j, s in enumerate(self.same):
            if self.share == 1:
                fields.append(f"get(v{i}, CAST({s.rank}L - {below} AS INT)) AS at{j}")
            else:
                centre = f"(({s.rank}L - {below} + 0.5e0) / greatest({above} - {below}, 1L))"
                error = f"sqrt(greatest({centre} * (1 - {centre}), 1e0 / greatest(size(v{i}), 1)) / greatest(size(v{i}), 1))"
                points = [
                    f"get(v{i}, CAST(floor((size(v{i}) - 1) * least(1e0, greatest(0e0, {centre} + {k} * {error}))) AS INT))" for k in _SPREAD
                ]
                fields += [f"array({', '.join(points)}) AS at{j}", f"2 * {_SPREAD[1]} * {error} AS span{j}"]
        return f"struct({', '.join(fields)}) AS d{i}"

    def learn(self, found: Row) -> None:
        for j, s in enumerate(self.same):
            if self.counted and not s.move(self.bracket, found):
                continue
            if self.share == 1:
                s.value = found[f"at{j}"]
            else:
                low, high = found[f"at{j}"]
                s.guides = (low, high) if low is not None and (s.low is None or low > s.low) and (s.high is None or high < s.high) else None
                s.span = min(1.0, found[f"span{j}"] or 1.0)


def _batches(draws: list[_Draw]) -> list[list[_Draw]]:
    """Consecutive runs of draws whose values fit the buffer budget together."""
    out: list[list[_Draw]] = []
    room = 0
    for draw in draws:
        if not out or draw.expected > room or len(out[-1]) * 5 >= MAX_AGGREGATES:
            out.append([])
            room = _BUFFER_BUDGET
        out[-1].append(draw)
        room -= draw.expected
    return out


def _scan(df: DataFrame, draws: list[_Draw], seed: int) -> None:
    """Counts and draws of one round, from one scan of the table."""
    if not any(d.counted for d in draws):
        # rows outside every bracket are dropped before the aggregate
        df = df.filter(" OR ".join(f"({d.inside()})" for d in draws))
    if any(d.share < 1 for d in draws):
        df = df.selectExpr("*", f"rand({seed}) AS {_DRAW}")
    measured = df.selectExpr(*[agg for i, d in enumerate(draws) for agg in d.aggregates(i)])
    row = measured.selectExpr(*[d.finish(i) for i, d in enumerate(draws)]).collect()[0]
    for i, d in enumerate(draws):
        d.learn(row[i])
