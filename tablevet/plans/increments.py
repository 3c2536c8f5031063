"""Scores of a table that grows by parts: each part is measured once, and its measures merge.

What is kept of a part is a few rows for each column: counts that add up, least and largest values,
latest times, and sketches of distinct values, rows and quantiles that unite.  A table that got a new
partition is scored by reading that partition and the small states of the others; a part that was
written again replaces its old state.  States merge in any order, and a merged state is one itself, so days
can be kept as months.

    profile = Profile(detect_roles(first_day), rules)
    append_part(path, new_day, "2024-03-01", profile)
    result = score_states(spark.read.parquet(path), new_day.schema, profile, "orders")
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from itertools import product

from pyspark.sql import DataFrame, functions as F, types as T

from tablevet.functions.text import folded
from tablevet.functions.values import (
    as_wall_time,
    digest,
    is_string,
    is_temporal,
    normalize,
    quote_name,
    sql_double,
    sql_text,
    with_written_times,
)
from tablevet.operators.checks import (
    email_checks,
    fake_null_checks,
    negative_checks,
    numeric_columns,
    outlier_checks,
    padding_checks,
    pair_checks,
    phone_checks,
    string_columns,
)
from tablevet.operators.distinct import ROW, ROW_SKETCH_BITS, row_key
from tablevet.operators.fused import MAX_AGGREGATES, Check
from tablevet.operators.roles import ColumnRoles
from tablevet.operators.rules import Rule, compile_rules
from tablevet.plans.score import MAX_SPELLINGS, MIN_VALUES_FOR_OUTLIERS, Measured, ScoreResult, scored

VALUE_SKETCH_BITS = 14  # standard error of a column's distinct values: 0.8 %
QUANTILE_SKETCH_K = 4096  # error in rank: about 0.1 %
REACH = 3.0
STATE = "part string, measure string, kind string, number bigint, value double, time timestamp_ntz, sketch binary"


@dataclass(frozen=True)
class Profile:
    """What is measured of every part alike; roles are found once, on the first part or a sample."""

    roles: ColumnRoles
    rules: tuple[Rule, ...] = ()
    null_policy: str = "violation"


@dataclass(frozen=True)
class _Measure:
    key: tuple
    kind: str  # sum, low, high, latest, distinct or quantiles
    aggregate: str

    @property
    def name(self) -> str:
        return repr(self.key)

    def record(self, place: str) -> str:
        own = {"sum": "number", "low": "value", "high": "value", "latest": "time", "distinct": "sketch", "quantiles": "sketch"}[self.kind]
        cells = [f"{place} AS {f}" if f == own else f"CAST(NULL AS {t}) AS {f}" for f, t in _CELLS.items()]
        return f"struct({sql_text(self.name)} AS measure, {sql_text(self.kind)} AS kind, {', '.join(cells)})"


_CELLS = {"number": "bigint", "value": "double", "time": "timestamp_ntz", "sketch": "binary"}


def _pairs_by_order(df: DataFrame, roles: ColumnRoles, written: dict[str, str]) -> Iterator[tuple[tuple[int, tuple[str, ...]], Check]]:
    """Each pair's check under every order of day and month that its text columns may have."""
    for i, pair in enumerate(roles.pairs):
        texts = [c for c in dict.fromkeys((pair.col_a, pair.col_b)) if c in written]
        for chosen in product((False, True), repeat=len(texts)):
            first = tuple(c for c, day in zip(texts, chosen) if day)
            for check in pair_checks(df, [pair], first, written):
                yield (i, first), check


def _row_checks(df: DataFrame, compiled, roles: ColumnRoles) -> list[Check]:
    return [
        *negative_checks(df), *email_checks(df, roles), *phone_checks(df, roles),
        *padding_checks(df), *fake_null_checks(df), *compiled.checks,
    ]


def _dates(df: DataFrame, roles: ColumnRoles) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name in roles.dates and (is_string(f.dataType) or is_temporal(f.dataType))]


def _counts(df: DataFrame, compiled, roles: ColumnRoles, written: dict[str, str]) -> list[_Measure]:
    out = [_Measure(("rows",), "sum", "count(1)")]
    for c in df.columns:
        out.append(_Measure((c, "nulls"), "sum", f"count_if({quote_name(c)} IS NULL)"))
    for c in numeric_columns(df):
        x = f"CAST({quote_name(c)} AS DOUBLE)"
        out += [_Measure((c, "least"), "low", f"min({x})"), _Measure((c, "largest"), "high", f"max({x})")]
    for f in _dates(df, roles):
        if f.name not in written:
            out.append(_Measure((f.name, "latest"), "latest", f"max({as_wall_time(quote_name(f.name), f.dataType)})"))
            continue
        day, month = (f"{written[f.name]}.{order}" for order in ("day_first", "month_first"))
        out += [
            _Measure((f.name, "latest", True), "latest", f"max({day})"),
            _Measure((f.name, "latest", False), "latest", f"max({month})"),
            _Measure((f.name, "day only"), "sum", f"count_if({month} IS NULL AND {day} IS NOT NULL)"),
            _Measure((f.name, "month only"), "sum", f"count_if({day} IS NULL AND {month} IS NOT NULL)"),
        ]
    checks = [((), c) for c in _row_checks(df, compiled, roles)] + list(_pairs_by_order(df, roles, written))
    for label, check in checks:
        out.append(_Measure((*label, *check.key, "violations"), "sum", check.violations_agg))
        out.append(_Measure((*label, *check.key, "checked"), "sum", check.checked_agg))
    return list({m.name: m for m in out}.values())


def _sketches(df: DataFrame) -> list[_Measure]:
    out = [_Measure((str(ROW), "row keys"), "distinct", f"hll_sketch_agg({row_key(df)}, {ROW_SKETCH_BITS})")]
    for f in df.schema.fields:
        c = quote_name(f.name)
        key = f"IF({c} IS NOT NULL, xxhash64({', '.join(digest(c, f.dataType))}), NULL)"
        out.append(_Measure((f.name, "values"), "distinct", f"hll_sketch_agg({key}, {VALUE_SKETCH_BITS})"))
        if is_string(f.dataType):
            out.append(_Measure((f.name, "folded"), "distinct", f"hll_sketch_agg(IF({c} IS NOT NULL, xxhash64({folded(c)}), NULL), {VALUE_SKETCH_BITS})"))
    for c in numeric_columns(df):
        x = f"CAST({quote_name(c)} AS DOUBLE)"
        sketch = f"IF(count({x}) > 0, kll_sketch_agg_double({x}, {QUANTILE_SKETCH_K}), NULL)"
        out.append(_Measure((c, "quantiles"), "quantiles", sketch))
    return out


def measure_part(df: DataFrame, part: str, profile: Profile) -> DataFrame:
    """The state of one part (columns :data:`STATE`); lazy, two scans: counts and sketches.

    An empty part has a state like others: counts of 0, nulls, and sketches of nothing.
    """
    df = normalize(df)
    compiled = compile_rules(df, list(profile.rules), profile.null_policy)
    timed, written = with_written_times(compiled.df, [*profile.roles.dates, *(c for p in profile.roles.pairs for c in (p.col_a, p.col_b))])
    measures = [(timed, _counts(df, compiled, profile.roles, written)), (df, _sketches(df))]
    out = None
    for source, own in measures:
        for start in range(0, len(own), MAX_AGGREGATES):
            few = own[start : start + MAX_AGGREGATES]
            found = source.selectExpr(*[f"{m.aggregate} AS m{i}" for i, m in enumerate(few)])
            rows = found.selectExpr(f"inline(array({', '.join(m.record(f'm{i}') for i, m in enumerate(few))}))")
            out = rows if out is None else out.unionByName(rows)
    return out.select(F.lit(part).alias("part"), "*")


def append_part(path: str, df: DataFrame, part: str, profile: Profile) -> None:
    """Measure a part and keep its state under ``path``; a part of that name is replaced."""
    state = measure_part(df, part, profile)
    state.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def merged(states: DataFrame, part: str = "all") -> DataFrame:
    """One state of several."""
    by = ["measure", "kind"]
    plain = (
        states.filter("kind NOT IN ('distinct', 'quantiles')").groupBy(*by)
        .agg(F.sum("number").alias("number"), F.min("value").alias("low"), F.max("value").alias("high"), F.max("time").alias("time"))
        .selectExpr(*by, "number", "IF(kind = 'low', low, high) AS value", "time", "CAST(NULL AS BINARY) AS sketch")
    )
    none = ["CAST(NULL AS BIGINT) AS number", "CAST(NULL AS DOUBLE) AS value", "CAST(NULL AS TIMESTAMP_NTZ) AS time"]
    unions = {"distinct": "hll_union_agg(sketch)", "quantiles": "kll_merge_agg_double(sketch)"}
    for kind, union in unions.items():
        own = states.filter((F.col("kind") == kind) & F.col("sketch").isNotNull()).groupBy(*by).agg(F.expr(union).alias("sketch"))
        plain = plain.unionByName(own.selectExpr(*by, *none, "sketch"))
    return plain.select(F.lit(part).alias("part"), *by, "number", "value", "time", "sketch")


def score_states(
    states: DataFrame,
    schema: T.StructType,
    profile: Profile,
    table_name: str = "dataset",
    freshness_threshold_hours: float = 24,
    as_of: datetime | None = None,
) -> ScoreResult:
    """The score of all parts together, from their states alone.

    Counts, latest times, formats, rules and pairs are exact.  Estimated are distinct rows (standard error
    0.4 %) and values (0.8 %; up to a few hundred they are as good as exact), quartiles, and the
    numbers of outliers (each within about 0.1 % of the rows; none where the least and largest
    value lie within the fences).
    """
    spark = states.sparkSession
    df = normalize(spark.createDataFrame([], schema))
    compiled = compile_rules(df, list(profile.rules), profile.null_policy)
    quartile = "kll_sketch_get_quantile_double(sketch, array(0.25e0, 0.75e0))"
    read = merged(states).selectExpr(
        "measure", "CASE WHEN kind = 'distinct' THEN hll_sketch_estimate(sketch) ELSE number END AS n", "value", "time",
        f"CASE WHEN kind = 'quantiles' THEN {quartile} END AS q", "localtimestamp() AS now",
    )
    by_name = {r.measure: r for r in read.collect()}

    timed, written = with_written_times(df, [*profile.roles.dates, *(c for p in profile.roles.pairs for c in (p.col_a, p.col_b))])
    known = {m.key: by_name[m.name] for m in [*_counts(df, compiled, profile.roles, written), *_sketches(df)] if m.name in by_name}
    found = {key if len(key) > 1 else key[0]: r.n for key, r in known.items()}
    rows = found["rows"]
    day_first = {c for c in written if (c, "day only") in found and found[c, "day only"] > found[c, "month only"]}
    for f in _dates(df, profile.roles):
        key = (f.name, "latest", f.name in day_first) if f.name in written else (f.name, "latest")
        found[f.name, "latest"] = known[key].time
    for (i, first), check in _pairs_by_order(df, profile.roles, written):
        pair = profile.roles.pairs[i]
        if set(first) == day_first & {pair.col_a, pair.col_b}:
            for part in ("violations", "checked"):
                found[(*check.key, part)] = found[(i, first, *check.key, part)]

    quartiles = {}
    for c in numeric_columns(df):
        filled = rows - found[c, "nulls"]
        if filled >= MIN_VALUES_FOR_OUTLIERS and (c, "quantiles") in known:
            quartiles[c] = tuple(known[c, "quantiles"].q)
    outliers = outlier_checks(df, quartiles, REACH)
    fences = {}
    for check in outliers:
        c, (q1, q3) = check.column, quartiles[check.column]
        low, high = q1 - REACH * (q3 - q1), q3 + REACH * (q3 - q1)
        if known[c, "least"].value < low or known[c, "largest"].value > high:
            fences[c] = (low, high)
    inside = _inside(states, fences)
    for check in outliers:
        filled = rows - found[check.column, "nulls"]
        found[(*check.key, "violations")], found[(*check.key, "checked")] = round((1 - inside.get(check.column, 1.0)) * filled), filled
    distinct = {c: min(found[c, "values"], rows - found[c, "nulls"]) for c in df.columns}
    distinct[ROW] = min(rows, found[str(ROW), "row keys"])
    for c in string_columns(df):
        if 2 <= distinct[c] <= MAX_SPELLINGS:
            found[c, "values"] = found[c, "folded"]
        else:
            found.pop((c, "values"), None)
    now = as_of or next(iter(by_name.values())).now
    measured = Measured(rows, found, profile.roles, distinct, compiled.checks, compiled.rejected, outliers, day_first, written, now)
    return scored(df, measured, table_name, list(profile.rules), freshness_threshold_hours)


def _inside(states: DataFrame, fences: dict[str, tuple[float, float]]) -> dict[str, float]:
    """The share of each column's values between its fences, by the merged sketches."""
    if not fences:
        return {}
    names = {repr((c, "quantiles")): c for c in fences}
    sides = []
    for side in (0, 1):
        whens = " ".join(
            f"WHEN {sql_text(m)} THEN kll_sketch_get_rank_double(sketch, {sql_double(fences[c][side])})" for m, c in names.items()
        )
        sides.append(f"CASE measure {whens} END AS rank_{side}")
    own = merged(states.filter(F.col("measure").isin(list(names)))).selectExpr("measure", *sides)
    return {names[r.measure]: r.rank_1 - r.rank_0 for r in own.collect()}
