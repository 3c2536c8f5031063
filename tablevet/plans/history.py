"""Volumetry from history: is a table as large as its earlier runs lead one to expect?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tablevet.functions.values import round1_sql
from tablevet.plans.score import HISTORY_RUNS, LEAST_HISTORY, VOLUMETRY


def volumetry(history: DataFrame, runs: int = HISTORY_RUNS, least_runs: int = LEAST_HISTORY) -> DataFrame:
    """``history`` (``table_name, run, row_count``) with ``expected_rows, deviation, score``; lazy.

    Expected is the mean of the ``runs`` runs before; the score is 100 less the deviation from it in
    percent, at least 0.  With fewer than ``least_runs`` earlier runs nothing is expected and the score is the
    neutral constant.  Where no rows are expected, none is a deviation of 0 and any of 1.
    """
    before = Window.partitionBy("table_name").orderBy("run").rowsBetween(-runs, -1)
    mean = F.when(F.count("row_count").over(before) >= least_runs, F.avg("row_count").over(before))
    deviation = "CASE WHEN expected_rows = 0 THEN IF(row_count = 0, 0e0, 1e0) ELSE abs(row_count - expected_rows) / expected_rows END"
    found = history.withColumn("expected_rows", mean).withColumn("deviation", F.expr(deviation))
    score = f"CASE WHEN expected_rows IS NULL THEN {VOLUMETRY}e0 ELSE {round1_sql('greatest(0e0, 100 - deviation * 100)')} END"
    return found.withColumn("score", F.expr(score))


def earlier_runs(history: DataFrame, runs: int = HISTORY_RUNS) -> list[int]:
    """The row counts of the last runs of a history of one table, oldest first."""
    last = history.orderBy(F.desc("run")).limit(runs).select("row_count").collect()
    return [r.row_count for r in reversed(last)]
