"""Queries on what a score takes and gives besides its numbers: names, rules, thresholds, whole reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablevet.functions.text import occurrences
from tablevet.functions.values import quote_name, sql_text
from tablevet.operators import distinct, rules
from tablevet.operators.checks import null_profile
from tablevet.operators.freshness import freshness
from tablevet.operators.fused import rows_of
from tablevet.plans import views
from tablevet.registry import oracles
from tablevet.registry.queries import ACTIVE_RULES, EVENTS_AS_OF, dirty_orders, dirty_score, table
from tablevet.registry.queries import _rule_counts as rule_counts
from tablevet.sources.reports import write_report
from tablevet.sources.scratch import scratch_dir

# A name that needs quoting for each column of the orders.
ODD_NAMES = {
    "o_orderkey": "order.key", "o_custkey": "customer `key`", "o_orderstatus": "état (status)", "o_totalprice": "total price, €",
    "o_orderdate": "select", "o_orderpriority": 'the "priority"',
}


def odd_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls and distinct values of columns whose names are no identifiers."""
    df = table(spark, sf_dir, "orders").withColumnsRenamed(ODD_NAMES)
    nulls = null_profile(df).select("column", "null_count", "row_count")
    values = distinct.distinct_values(df, distinct.typed_columns(df)).withColumnRenamed("key", "column")
    return nulls.join(values, "column").select("column", "null_count", "row_count", "distinct_count")


def rules_added_and_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of rules that got one, lost one, and lost one that it never had."""
    active = rules.add_rule(ACTIVE_RULES, rules.build_rule("mail has a dot", "email", "!=", "invalid", "low"))
    active = rules.remove_rule(rules.remove_rule(active, "age is set"), "no such rule")
    return rule_counts(dirty_orders(spark, sf_dir), active)


THRESHOLDS = (1, 24, 30.5, 168, 720)


def freshness_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    found = [freshness(df, ["ts"], EVENTS_AS_OF, t).select(F.lit(float(t)).alias("threshold"), "max_ts", "score") for t in THRESHOLDS]
    return reduce(DataFrame.unionByName, found)


ALERTS = (0, 60, 70, 79, 100)


def alerts_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each dimension of the flawed orders comes to under other alert thresholds."""
    scores = views.dimension_scores(dirty_score(spark, sf_dir)).select("dimension", "score")
    alerts = [scores.select("dimension", F.lit(t).alias("threshold"), views.alert(F.col("score"), t).alias("alert")) for t in ALERTS]
    return reduce(DataFrame.unionByName, alerts)


def report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a report written under one folder: rows and columns of every part and run."""
    result, base = dirty_score(spark, sf_dir, ACTIVE_RULES), scratch_dir(spark, "reports")
    for at in (EVENTS_AS_OF, EVENTS_AS_OF.replace(day=2)):
        written = write_report(result, base, at)
    found = None
    for part, path in written.items():
        kept = spark.read.parquet(path)
        rows = kept.groupBy("run").agg(F.count("*").alias("n_rows"))
        rows = rows.select(F.lit(part).alias("part"), "run", "n_rows", F.lit(len(kept.columns)).alias("n_columns"))
        found = rows if found is None else found.unionByName(rows)
    return found


def report_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of a report, read back."""
    written = write_report(dirty_score(spark, sf_dir, ACTIVE_RULES), scratch_dir(spark, "report"), EVENTS_AS_OF)
    return spark.read.parquet(written["issues"]).select("dimension", "severity", "column", "check", "violations", "checked")


def characters_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separators in the text columns of two tables, one scan each."""
    found = []
    for name, columns in (("documents", ("text", "source")), ("pages", ("url", "html"))):
        records = [
            {"table_name": sql_text(name), "column": sql_text(c), "commas": f"sum({occurrences(quote_name(c), ',')})", "bars": f"sum({occurrences(quote_name(c), '|')})"}
            for c in columns
        ]
        found.append(rows_of(table(spark, sf_dir, name), records, "table_name:string, column:string, commas:bigint, bars:bigint"))
    return found[0].unionByName(found[1])


def detail_queries() -> dict:
    return {
        "odd_names": odd_names,
        "rules_added_and_removed": rules_added_and_removed,
        "freshness_by_threshold": freshness_by_threshold,
        "alerts_by_threshold": alerts_by_threshold,
        "report_parts": report_parts,
        "report_issues": report_issues,
        "characters_by_column": characters_by_column,
    }


# ------------------------------------------------------------------ SQL


def detail_oracles() -> dict[str, str]:
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    names = [
        f"SELECT {text(shown)} AS \"column\", {oracles.count_if(f'{c} IS NULL')} AS null_count, count(*) AS row_count,"
        f" count(DISTINCT {c}) AS distinct_count FROM orders"
        for c, shown in ODD_NAMES.items()
    ]
    kept = [
        ("status is active", "high", "coalesce(status = 'active', false)"), ("status is not inactive", "low", "coalesce(status <> 'inactive', true)"),
        ("gross above net", "medium", "coalesce(price_ht < price_ttc, false)"), ("mail has a dot", "low", "coalesce(email <> 'invalid', true)"),
    ]
    active = [
        f"SELECT {text(n)} AS rule, '{s}' AS severity, {oracles.count_if(f'NOT {test}')} AS violations, count(*) AS checked FROM dirty"
        for n, s, test in kept
    ]
    lag = f"date_diff('microsecond', max(ts), TIMESTAMP '{EVENTS_AS_OF}') / 3.6e9"
    fresh = [
        f"SELECT CAST({t} AS DOUBLE) AS threshold, max(ts) AS max_ts, least(100e0, greatest(0e0, 100 - {lag} / CAST({t} AS DOUBLE) * 100)) AS score FROM events"
        for t in THRESHOLDS
    ]
    dimensions = oracles.all_oracles()["dimension_scores"]
    alerts = " UNION ALL ".join(
        f"SELECT dimension, CAST({t} AS INT) AS threshold, CASE WHEN score >= 80 THEN 'ok' WHEN score >= {t} THEN 'warn' ELSE 'error' END AS alert FROM d"
        for t in ALERTS
    )
    issues = oracles.dirty(oracles.issue_rows())
    counts = {
        "summary": ("1", 10), "dimensions": ("9", 7), "rules": (str(len(ACTIVE_RULES)), 8), "column_scores": (str(len(oracles.DIRTY_TYPES)), 6),
        "worst_columns": (f"least(14, {len(oracles.DIRTY_TYPES)})", 6), "issues": ("(SELECT count(*) FROM i)", 10),
    }
    parts = " UNION ALL ".join(
        f"SELECT '{part}' AS part, '{run}' AS run, CAST({n} AS BIGINT) AS n_rows, CAST({width} AS INT) AS n_columns"
        for part, (n, width) in counts.items()
        for run in ("20240201_000000", "20240202_000000")
    )
    marks = [
        f"SELECT '{t}' AS table_name, '{c}' AS \"column\", CAST(sum(length({c}) - length(replace({c}, ',', ''))) AS BIGINT) AS commas,"
        f" CAST(sum(length({c}) - length(replace({c}, '|', ''))) AS BIGINT) AS bars FROM {t}"
        for t, columns in (("documents", ("text", "source")), ("pages", ("url", "html")))
        for c in columns
    ]
    return {
        "odd_names": oracles.both(names),
        "rules_added_and_removed": oracles.dirty(oracles.both(active)),
        "freshness_by_threshold": oracles.both(fresh),
        "alerts_by_threshold": f"WITH d AS ({dimensions}) {alerts}",
        "report_parts": f"WITH i AS ({issues}) {parts}",
        "report_issues": issues,
        "characters_by_column": oracles.both(marks),
    }
