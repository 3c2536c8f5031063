"""Result tables of a score, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablevet.operators.rules import Rule
from tablevet.plans.score import WEIGHTS, ScoreResult

GOOD, MEDIUM = 80.0, 60.0
WORST_COLUMNS = 14


def grade(score: Column) -> Column:
    return (
        F.when(score >= GOOD, "good").when(score >= MEDIUM, "medium").otherwise("critical")
    )


def alert(score: Column, threshold: float = 70) -> Column:
    """``ok`` from 80 on whatever the threshold, then ``warn`` down to it."""
    if not 0 <= threshold <= 100:
        raise ValueError("the alert threshold must lie between 0 and 100")
    return (
        F.when(score >= GOOD, "ok").when(score >= F.lit(threshold), "warn").otherwise("error")
    )


def dimension_scores(result: ScoreResult) -> DataFrame:
    """(ordinal, dimension, weight, score, grade) in the fixed order of the weights."""
    rows = [
        (i, d, WEIGHTS[d], float(s)) for i, (d, s) in enumerate(result.scores.items(), start=1)
    ]
    schema = "ordinal int, dimension string, weight double, score double"
    table = result.spark.createDataFrame(rows, schema)
    return table.withColumn("grade", grade(F.col("score")))


def global_score(result: ScoreResult, alert_threshold: float = 70) -> DataFrame:
    """(score, grade, alert)"""
    table = result.spark.createDataFrame([(result.global_score,)], "score double")
    return table.select(
        "score",
        grade(F.col("score")).alias("grade"),
        alert(F.col("score"), alert_threshold).alias("alert"),
    )


def issues(result: ScoreResult) -> DataFrame:
    """One row per issue, in dimension order."""
    rows = [
        (
            result.table_name, i.dimension, i.severity, i.column, i.check,
            int(i.violations), int(i.checked), float(i.pct), i.message,
        )
        for i in result.issues
    ]
    return result.spark.createDataFrame(
        rows,
        "table_name string, dimension string, severity string, column string, check string, "
        "violations bigint, checked bigint, pct double, message string",
    )


def issues_of(result: ScoreResult, severity: str) -> DataFrame:
    return issues(result).filter(F.col("severity") == severity)


def issue_severity_counts(result: ScoreResult) -> DataFrame:
    """(severity, n)"""
    return issues(result).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def column_scores(result: ScoreResult) -> DataFrame:
    """(column, completeness, uniqueness, overall), worst first."""
    rows = [(c.name, c.completeness, c.uniqueness, c.overall) for c in result.columns]
    schema = "column string, completeness double, uniqueness double, overall double"
    return result.spark.createDataFrame(rows, schema).orderBy("overall", "column")


def worst_columns(result: ScoreResult, n: int = WORST_COLUMNS) -> DataFrame:
    return column_scores(result).limit(n)


def rules(result: ScoreResult) -> DataFrame:
    return rules_frame(result.spark, result.rules)


def rules_frame(spark, active: list[Rule]) -> DataFrame:
    rows = [(r.name, r.condition, r.column, r.severity, r.operator, r.value) for r in active]
    return spark.createDataFrame(
        rows,
        "name string, condition string, column string, severity string, operator string, "
        "value string",
    )


def run_summary(result: ScoreResult) -> DataFrame:
    """One row: sizes, issue and rule counts, global score."""
    high = sum(i.severity == "high" for i in result.issues)
    medium = sum(i.severity == "medium" for i in result.issues)
    row = (
        result.table_name, result.row_count, result.col_count, len(result.issues),
        high, medium, len(result.rules), result.global_score,
    )
    return result.spark.createDataFrame(
        [row],
        "table_name string, row_count bigint, col_count int, issue_count int, high_count int, "
        "medium_count int, rule_count int, score double",
    ).withColumn("grade", grade(F.col("score")))


def freshness(result: ScoreResult) -> DataFrame:
    """(column, max_ts, lag_hours, score) of every date column with a readable value."""
    rows = [(c, ts, lag, float(s)) for c, (ts, lag, s) in result.freshness.items()]
    schema = "column string, max_ts timestamp_ntz, lag_hours double, score double"
    return result.spark.createDataFrame(rows, schema)
