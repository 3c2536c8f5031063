"""Database queries over JDBC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Driver class and default port per database.
DRIVERS = {
    "postgresql": ("org.postgresql.Driver", 5432),
    "mysql": ("com.mysql.cj.jdbc.Driver", 3306),
}


@dataclass(frozen=True)
class ReadSplit:
    """Read ``partitions`` ranges of a number, date or timestamp column side by side."""

    column: str
    lower: str
    upper: str
    partitions: int


def jdbc_options(
    kind: str,
    host: str,
    db: str,
    user: str,
    password: str,
    query: str,
    port: int | None = None,
    split: ReadSplit | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of Spark's JDBC reader.

    A plain query is read over one connection.  With ``split`` it becomes a derived table, the
    form Spark can read in parallel; rows outside the bounds are read too.
    """
    if kind not in DRIVERS:
        raise ValueError(f"database must be one of {tuple(DRIVERS)}: {kind!r}")
    driver, default_port = DRIVERS[kind]
    options = {
        "url": f"jdbc:{kind}://{host}:{port or default_port}/{db}",
        "driver": driver,
        "user": user,
        "password": password,
        "fetchsize": str(fetch_size),
    }
    statement = query.strip().rstrip(";")
    if split is None:
        return options | {"query": statement}
    return options | {
        "dbtable": f"({statement}) t",
        "partitionColumn": split.column,
        "lowerBound": split.lower,
        "upperBound": split.upper,
        "numPartitions": str(split.partitions),
    }


def read_postgres(spark: SparkSession, **connection: object) -> DataFrame:
    return read_jdbc(spark, jdbc_options("postgresql", **connection))


def read_mysql(spark: SparkSession, **connection: object) -> DataFrame:
    return read_jdbc(spark, jdbc_options("mysql", **connection))


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()
