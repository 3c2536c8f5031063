"""Write the result tables of a score."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tablevet.plans import views
from tablevet.plans.score import ScoreResult


def report_tables(result: ScoreResult) -> dict[str, DataFrame]:
    return {
        "summary": views.run_summary(result),
        "dimensions": views.dimension_scores(result),
        "issues": views.issues(result),
        "rules": views.rules(result),
        "column_scores": views.column_scores(result),
        "worst_columns": views.worst_columns(result),
    }


def report_name(table_name: str, at: datetime) -> str:
    """``<table>_<yyyymmdd>_<HHMMSS>`` with dots of the table name as underscores."""
    return f"{table_name.replace('.', '_')}_{at:%Y%m%d_%H%M%S}"


def write_report(
    result: ScoreResult, base: str, at: datetime, fmt: str = "parquet"
) -> dict[str, str]:
    """Write every result table under ``base/<part>``, partitioned by table and run."""
    table = result.table_name.replace(".", "_")
    written = {}
    for part, df in report_tables(result).items():
        path = f"{base.rstrip('/')}/{part}"
        tagged = df.drop("table_name").select(
            "*", F.lit(table).alias("table_name"), F.lit(f"{at:%Y%m%d_%H%M%S}").alias("run")
        )
        # A score has one row per column at most: one file each.
        tagged.coalesce(1).write.mode("append").partitionBy("table_name", "run").format(fmt).save(
            path
        )
        written[part] = path
    return written
