"""Catalog tables, previews and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablevet.functions.values import quote_name

PREVIEW_ROWS = 50


def read_table(
    spark: SparkSession, table: str, schema: str = "default", catalog: str | None = None
) -> DataFrame:
    """A catalog table of any format the session knows."""
    return spark.read.table(".".join(quote_name(p) for p in (catalog, schema, table) if p))


def table_size(df: DataFrame) -> DataFrame:
    """(row_count, col_count); lazy."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("col_count")
    )


def list_tables(
    spark: SparkSession,
    schema: str = "default",
    catalog: str | None = None,
    most: int | None = None,
) -> DataFrame:
    """(table_name) of all tables of a schema in order, or of the first ``most``."""
    where = ".".join(quote_name(p) for p in (catalog, schema) if p)
    shown = spark.sql(f"SHOW TABLES IN {where}")
    names = shown.selectExpr("tableName AS table_name").orderBy("table_name")
    return names if most is None else names.limit(most)


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """Any ``n`` rows."""
    return df.limit(n)
