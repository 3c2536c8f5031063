"""Profiles of plain Parquet tables from the statistics in the files' footers.

Row counts, null counts, least and largest values are written in every Parquet footer.  Spark's DataSource V2
reader answers such aggregates from there (``spark.sql.parquet.aggregatePushdown``) without reading a data
page, so profiling a table costs one small read for each file.  Columns for which a footer cannot tell are
scanned, and only they: floating-point ones, whose NaN counts as missing here but not there,
and nested ones.  Answers are those of the plain profiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, types as T

from tablevet.functions.settings import held_setting
from tablevet.functions.values import is_numeric, normalize, quote_name, round1
from tablevet.operators.fused import MAX_AGGREGATES

_COUNTED = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.StringType,
    T.BinaryType, T.TimestampType, T.TimestampNTZType, T.DecimalType,
)
_RANGED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@contextmanager
def pushed_aggregates(spark: SparkSession) -> Iterator[None]:
    """Parquet tables opened and queried inside are read by the V2 reader, aggregates by footers."""
    sources = "spark.sql.sources.useV1SourceList"
    others = ",".join(s for s in spark.conf.get(sources).split(",") if s.strip().lower() != "parquet")
    with held_setting(spark, sources, others), held_setting(spark, "spark.sql.parquet.aggregatePushdown", "true"):
        yield


def footer_frame(spark: SparkSession, path: str, aggregates: Sequence[str]) -> DataFrame:
    """The aggregates as one row; to be made and read inside :func:`pushed_aggregates`."""
    return spark.read.parquet(path).selectExpr(*[f"{agg} AS m{i}" for i, agg in enumerate(aggregates)])


def _measured(spark: SparkSession, path: str, aggregates: list[str]) -> Row:
    """Read off footers, or by a scan where a file's footer has no statistics."""
    try:
        with pushed_aggregates(spark):
            return footer_frame(spark, path, aggregates).collect()[0]
    except Exception as e:  # a failed job is raised as what the JVM threw
        if "spark.sql.parquet.aggregatePushdown" not in str(e):  # Spark's advice where statistics are missing
            raise
        return footer_frame(spark, path, aggregates).collect()[0]


def _by_footer(spark: SparkSession, path: str, wanted: dict[tuple, str]) -> dict[tuple, object]:
    found: dict[tuple, object] = {}
    items = list(wanted.items())
    for start in range(0, len(items), MAX_AGGREGATES):
        part = items[start : start + MAX_AGGREGATES]
        row = _measured(spark, path, [agg for _, agg in part])
        found |= {key: row[i] for i, (key, _) in enumerate(part)}
    return found


def _by_scan(df: DataFrame, wanted: dict[tuple, str]) -> dict[tuple, object]:
    if not wanted:
        return {}
    row = df.selectExpr(*[f"{agg} AS m{i}" for i, agg in enumerate(wanted.values())]).collect()[0]
    return {key: row[i] for i, key in enumerate(wanted)}


def parquet_null_profile(spark: SparkSession, path: str) -> DataFrame:
    """:func:`~tablevet.operators.checks.null_profile` of a Parquet table by its path."""
    df = normalize(spark.read.parquet(path))
    footer: dict[tuple, str] = {("rows",): "count(*)"}
    scan: dict[tuple, str] = {}
    for f in df.schema.fields:
        (footer if isinstance(f.dataType, _COUNTED) else scan)[f.name, "filled"] = f"count({quote_name(f.name)})"
    found = _by_footer(spark, path, footer) | _by_scan(df, scan)
    found = {key: n or 0 for key, n in found.items()}  # files without any row give nulls
    rows = found["rows",]
    out = []
    for c in df.columns:
        nulls = rows - found[c, "filled"]
        out.append((c, nulls, rows, round1((1 - nulls / rows) * 100) if rows else 0.0))
    return spark.createDataFrame(out, "column string, null_count bigint, row_count bigint, completeness double")


def parquet_numeric_profile(spark: SparkSession, path: str) -> DataFrame:
    """:func:`~tablevet.operators.checks.numeric_profile` of a Parquet table by its path.

    The share of negative values needs no scan where the least value is not negative, or the largest is.
    """
    df = normalize(spark.read.parquet(path))
    numbers = [f for f in df.schema.fields if is_numeric(f.dataType)]
    footer: dict[tuple, str] = {}
    scan: dict[tuple, str] = {}
    for f in numbers:
        own, c = (footer if isinstance(f.dataType, _RANGED) else scan), quote_name(f.name)
        own |= {(f.name, "min"): f"min({c})", (f.name, "max"): f"max({c})"}
        if own is scan:
            scan[f.name, "negative"] = _negative(c)
    found = _by_footer(spark, path, footer) if footer else {}
    for f in numbers:
        low, high = found.get((f.name, "min")), found.get((f.name, "max"))
        if low is None and (f.name, "min") in footer:
            found[f.name, "negative"] = None  # no values
        elif low is not None and (low >= 0 or high < 0):
            found[f.name, "negative"] = float(high < 0)
        elif low is not None:
            scan[f.name, "negative"] = _negative(quote_name(f.name))
    found |= _by_scan(df, scan)
    rows = []
    for f in numbers:
        ends = [found[f.name, k] for k in ("min", "max")]
        rows.append((f.name, *[None if x is None else float(x) for x in ends], found[f.name, "negative"]))
    return spark.createDataFrame(rows, "column string, min double, max double, neg_share double")


def _negative(c: str) -> str:
    return f"try_divide(count_if({c} < 0), count({c}))"
