"""Exact distinct counts of rows and of any number of expressions, with one shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablevet.functions.settings import held_setting
from tablevet.functions.values import digest, packed, quote_name, round1_sql, row_digest, sql_text



class _WholeRow:
    """Key of the whole-row count: no column can have it as its name."""

    def __repr__(self) -> str:
        return "*"


ROW = _WholeRow()

Cells = Mapping[str, tuple[str, T.DataType]]  # key -> SQL expression and its type


def typed_columns(df: DataFrame) -> dict[str, tuple[str, T.DataType]]:
    return {f.name: (quote_name(f.name), f.dataType) for f in df.schema.fields}


def distinct_values(df: DataFrame, cells: Cells, whole_rows: bool = False) -> DataFrame:
    """(entry, key, distinct_count): distinct non-null values per entry of ``cells``; lazy.

    Each row becomes one narrow record per cell: entry number, 128-bit key, and bits.  Neighbouring
    numbers share a key and differ in their bit (see ``packed``), all other values have a key of their own.
    Grouping by the key spreads the values of every column over all partitions and the map side keeps
    one record per key and task, so neither a hot value nor a wide row makes a heavy task.  With
    ``whole_rows`` the row itself is one more cell, the last entry, under the key ``*``.
    """
    every = dict(cells)
    if not every and not whole_rows:
        return df.sparkSession.createDataFrame([], "entry int, key string, distinct_count bigint")
    row_cells = typed_columns(df) if whole_rows else {}
    keyed = [*every.values(), *(cell for cell in row_cells.values())]
    numbers = {cell: i for i, cell in enumerate(dict.fromkeys(keyed))}  # shared cells once

    keys = []
    for (expression, data_type), i in numbers.items():
        keys.append(f"{expression} IS NOT NULL AS f{i}")
        if (expression, data_type) in every.values():
            keys += [f"{part} AS {name}{i}" for name, part in zip("hlb", packed(expression, data_type))]
        if (expression, data_type) in row_cells.values():
            keys += [f"{part} AS {name}{i}" for name, part in zip("rs", digest(expression, data_type))]
    digests = df.selectExpr(*keys)

    records = [
        f"struct({n} AS i, IF(f{i}, h{i}, NULL) AS high, l{i} AS low, b{i} AS bits)"
        for n, i in enumerate(numbers[cell] for cell in every.values())
    ]
    if whole_rows:
        at = [numbers[cell] for cell in row_cells.values()]
        parts = [(f"IF(f{i}, 1, NULL)", f"r{i}", f"s{i}") for i in at]
        high, low = row_digest(parts)
        digests = digests.selectExpr("*", f"{high} AS hr", f"{low} AS lr")
        records.append(f"struct({len(records)} AS i, hr AS high, lr AS low, 1L AS bits)")
    names = [*every, *([ROW] if whole_rows else [])]

    counted = (
        digests.selectExpr(f"inline(array({', '.join(records)}))")
        .filter("high IS NOT NULL")
        .groupBy("i", "high", "low")
        .agg(F.bit_or("bits").alias("bits"))
        .groupBy("i")
        .agg(F.sum(F.bit_count("bits")).alias("count"))
    )
    # Entries without any value have no group: they get 0.
    rows = ", ".join(
        f"named_struct('entry', {n}, 'key', {sql_text(str(name))},"
        f" 'distinct_count', coalesce(try_element_at(found, {n}), 0L))"
        for n, name in enumerate(names)
    )
    return counted.selectExpr(
        "map_from_entries(collect_list(struct(i, count))) AS found"
    ).selectExpr(f"inline(array({rows}))")


def distinct_counts(
    df: DataFrame, cells: Cells, whole_rows: bool = False, rows: int | None = None
) -> dict[str, int]:
    """:func:`distinct_values` on the driver; ``rows`` lets the shuffle be sized first."""
    counted = distinct_values(df, cells, whole_rows)
    keys = [*cells, *([ROW] if whole_rows else [])]
    records = (rows or 0) * (len(cells) + whole_rows)
    with _enough_partitions(df.sparkSession, records):
        return {keys[r["entry"]]: r["distinct_count"] for r in counted.collect()}


# Buckets of the row sketch, as a power of two: its standard error is 1.04 / sqrt(2**16) = 0.4 %.
ROW_SKETCH_BITS = 16


def row_key(df: DataFrame) -> str:
    """SQL of one 64-bit hash of the whole row."""
    parts = []
    for name, (cell, data_type) in typed_columns(df).items():
        high, low = digest(cell, data_type)
        parts.append((f"IF({cell} IS NULL, NULL, 1)", f"IF({cell} IS NULL, NULL, {high})", f"IF({cell} IS NULL, NULL, {low})"))
    return row_digest(parts)[0]


def sketched_rows(df: DataFrame) -> str:
    """Aggregate: the number of distinct rows, by a mergeable sketch of their hashes; no row is shuffled."""
    return f"hll_sketch_estimate(hll_sketch_agg({row_key(df)}, {ROW_SKETCH_BITS}))"


def duplicate_rows_approx(df: DataFrame) -> DataFrame:
    """:func:`duplicate_rows` with the number of distinct rows from a sketch; lazy, one scan.

    The standard error of ``distinct_rows`` is 0.4 %; it is never above the number of rows.
    """
    counted = df.selectExpr("count(1) AS row_count", f"least({sketched_rows(df)}, count(1)) AS distinct_rows")
    return _with_score(counted)


_RECORD_BYTES = 40
_PARTITION_BYTES = 512 * 1024 * 1024


@contextmanager
def _enough_partitions(spark: SparkSession, records: int) -> Iterator[None]:
    """Raise ``spark.sql.shuffle.partitions`` while a shuffle of many records is planned.

    The default suits gigabytes; adaptive execution merges partitions but cannot add any.
    """
    key = "spark.sql.shuffle.partitions"
    before = int(spark.conf.get(key))
    wanted = math.ceil(records * _RECORD_BYTES / _PARTITION_BYTES)
    if wanted <= before:
        yield
        return
    with held_setting(spark, key, str(wanted)):
        yield


def short_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, v): the distinct values of string columns known to hold few; ``i`` is the place
    of the column in the list.  Lazy.

    Values are combined on the map side and shuffled by value, so that even long ones never
    meet in one buffer as ``collect_set`` over all tasks would make them.
    """
    records = [f"struct({i} AS i, {quote_name(c)} AS v)" for i, c in enumerate(columns)]
    if not records:
        return df.sparkSession.createDataFrame([], "i int, v string")
    pairs = df.selectExpr(f"inline(array({', '.join(records)}))")
    return pairs.filter("v IS NOT NULL").distinct()


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(row_count, distinct_rows, dup_rows, score); lazy.

    A table of fewer than two rows has no duplicates and scores 100.
    """
    fields = df.schema.fields
    keys, parts = [], []
    for i, f in enumerate(fields):
        c = quote_name(f.name)
        high, low = digest(c, f.dataType)
        keys += [f"{c} IS NULL AS f{i}", f"{high} AS h{i}", f"{low} AS l{i}"]
        parts.append((f"IF(f{i}, NULL, 1)", f"h{i}", f"l{i}"))
    high, low = row_digest(parts)
    copies = df.selectExpr(*keys).selectExpr(f"{high} AS high", f"{low} AS low")
    # Counting copies per key needs no second scan for the number of rows.
    totals = (
        copies.groupBy("high", "low")
        .count()
        .selectExpr("coalesce(sum(count), 0) AS row_count", "count(1) AS distinct_rows")
    )
    return _with_score(totals)


def _with_score(totals: DataFrame) -> DataFrame:
    score = round1_sql("greatest(0e0, 100 - (row_count - distinct_rows) / row_count * 100 * 2)")
    return totals.selectExpr(
        "row_count",
        "distinct_rows",
        "row_count - distinct_rows AS dup_rows",
        f"CASE WHEN row_count < 2 THEN 100e0 ELSE {score} END AS score",
    )
