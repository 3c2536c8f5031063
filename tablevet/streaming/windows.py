"""The fused counts of a score over tumbling windows of a stream.

A stream of rows with an event time is counted by window: rows, nulls of each column, and the
violations of row checks, all in one stateful aggregate.  Rows may come late: a window stays open for the
watermark's delay and its counts are written again whenever they change, so the last version of a
window holds all rows that came in time.  State is one row of counts for each open window.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tablevet.functions.values import is_temporal, quote_name
from tablevet.operators.fused import Check


def windowed_counts(rows: DataFrame, time: str, checks: Iterable[Check] = (), width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """``window_start, n_rows, <column>_nulls, …`` and ``check_<i>_violations, check_<i>_checked`` for each window.

    ``rows`` is a stream or a plain table; on a stream, rows more than ``delay`` behind the latest event
    time are left out by Spark.  A row without an event time is in no window.
    """
    kind = rows.schema[time].dataType
    if not is_temporal(kind):
        raise ValueError(f"{time} is no time column")
    names = rows.columns
    at = "__event_time"
    while at in names:
        at += "_"
    timed = rows.withColumn(at, F.expr(f"CAST({quote_name(time)} AS TIMESTAMP)")).withWatermark(at, delay)
    counts = [F.count(F.lit(1)).alias("n_rows")]
    counts += [F.expr(f"count_if({quote_name(c)} IS NULL)").alias(f"{c}_nulls") for c in names]
    for i, check in enumerate(checks):
        counts += [F.expr(check.violations_agg).alias(f"check_{i}_violations"), F.expr(check.checked_agg).alias(f"check_{i}_checked")]
    found = timed.groupBy(F.window(at, width).alias("__window")).agg(*counts)
    return found.select(F.expr("CAST(__window.start AS TIMESTAMP_NTZ)").alias("window_start"), *found.columns[1:])


def keep_windows(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every change of a window under ``path``, one folder a batch; ends when the input is used up.

    A batch that runs again after a failure replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    """The last version of every window kept under ``path``."""
    kept = spark.read.parquet(path)
    last = Window.partitionBy("window_start").orderBy(F.desc("batch"))
    return kept.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "batch")
