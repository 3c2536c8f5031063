"""A small table with known flaws, for trying things out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def demo_table(spark: SparkSession, n: int = 600, copies: int = 25) -> DataFrame:
    """``n`` customer rows with planted flaws, then ``copies`` of them again."""
    base = spark.range(n).selectExpr(
        "id + 1 AS id",
        "IF(id % 8 = 0, 'invalid', concat('user', id, '@mail.com')) AS email",
        "IF(id % 10 = 0, 'abc', concat('+336', lpad(CAST(id AS STRING), 8, '0'))) AS phone",
        "IF(id % 15 = 0, -5L, 18 + (id * 7) % 62) AS age",
        "round(-100 * ln((id * 37 % 997 + 1) / 998e0), 2) AS price",
        "CASE WHEN id % 20 < 6 THEN 'active' WHEN id % 20 < 10 THEN 'ACTIVE'"
        " WHEN id % 20 < 12 THEN 'Active' WHEN id % 20 < 19 THEN 'inactive' END AS status",
        "CASE WHEN id % 20 < 6 THEN 'France' WHEN id % 20 < 9 THEN 'FRANCE'"
        " WHEN id % 20 < 11 THEN 'france' WHEN id % 20 < 19 THEN 'Germany' ELSE 'N/A' END AS country",
        "CAST(TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, id) AS STRING) AS created_at",
    )
    again = base.filter(f"(id * 7) % {n} < {copies}")
    return base.unionByName(again)
