"""Queries on tables that grow: merged states, volume history, streams, samples; and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablevet.operators.checks import negative_checks
from tablevet.operators.distinct import duplicate_rows, duplicate_rows_approx
from tablevet.operators.fused import Check
from tablevet.operators.roles import detect_roles
from tablevet.operators.sampling import sample_rows
from tablevet.plans import views
from tablevet.plans.history import earlier_runs, volumetry
from tablevet.plans.increments import Profile, append_part, score_states
from tablevet.plans.score import ScoreResult, score
from tablevet.registry import oracles
from tablevet.registry.queries import ACTIVE_RULES, DIRTY_AS_OF, EVENTS_AS_OF, dirty_orders, table
from tablevet.sources.footers import parquet_null_profile, parquet_numeric_profile
from tablevet.sources.scratch import scratch_dir, staged
from tablevet.streaming.windows import keep_windows, latest_windows, windowed_counts

# ------------------------------------------------------------------ merged states


def _merged_score(spark: SparkSession, sf_dir: str, active: list) -> ScoreResult:
    """Flawed orders measured year by year, the last year twice, and scored from what was kept."""
    df = dirty_orders(spark, sf_dir)
    profile = Profile(detect_roles(df), tuple(active))
    path = scratch_dir(spark, "states")
    years = [r.year for r in df.selectExpr("year(created_at) AS year").distinct().collect()]
    for year in [*sorted(years), max(years)]:
        append_part(path, df.filter(F.year("created_at") == year), f"y{year}", profile)
    return score_states(spark.read.parquet(path), df.schema, profile, "dirty_orders", 720, DIRTY_AS_OF)


def merged_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact scores of all rows, and whether those of the merged states agree.

    Estimated are uniqueness and distribution, which may be 2 points off; all others must be the same.
    """
    whole = views.dimension_scores(score(dirty_orders(spark, sf_dir), "dirty_orders", ACTIVE_RULES[:1], 720, DIRTY_AS_OF))
    near = views.dimension_scores(_merged_score(spark, sf_dir, ACTIVE_RULES[:1])).select("dimension", F.col("score").alias("merged"))
    room = F.when(F.col("dimension").isin("uniqueness", "distribution"), 2.0).otherwise(0.0)
    agrees = (F.abs(F.col("score") - F.col("merged")) <= room).alias("agrees")
    return whole.join(near, "dimension").select("dimension", "score", agrees)


def merged_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the merged states find wrong, without the estimated duplicates."""
    found = views.issues(_merged_score(spark, sf_dir, ACTIVE_RULES)).filter("dimension != 'uniqueness'")
    return found.select("dimension", "severity", "column", "check", "violations", "checked")


def duplicates_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sketched numbers of distinct rows are within five standard errors of the exact ones."""
    out = None
    for name, df in (("dirty_orders", dirty_orders(spark, sf_dir)), ("lineitem", table(spark, sf_dir, "lineitem"))):
        near = duplicate_rows_approx(df).select("row_count", F.col("distinct_rows").alias("near"))
        found = duplicate_rows(df).join(near, "row_count")
        close = (F.abs(F.col("near") - F.col("distinct_rows")) <= F.col("distinct_rows") * 0.02).alias("close")
        found = found.select(F.lit(name).alias("table_name"), "row_count", "distinct_rows", close)
        out = found if out is None else out.unionByName(found)
    return out


# ------------------------------------------------------------------ history


def _event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("run")).agg(F.count("*").alias("row_count"))
    return days.select(F.lit("events").alias("table_name"), "run", "row_count")


def volumetry_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of the events against the seven days before."""
    found = volumetry(_event_days(spark, sf_dir))
    return found.select("run", "row_count", F.round("expected_rows", 6).alias("expected_rows"), "score")


def score_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of the events, and half of it, scored after all days before."""
    days = staged(_event_days(spark, sf_dir))
    last = days.agg(F.max("run")).first()[0]
    earlier = earlier_runs(days.filter(F.col("run") < last))
    day = table(spark, sf_dir, "events").filter(F.to_date("ts") == last)
    out = None
    for name, df in (("whole", day), ("third", day.filter("event_id % 3 = 0"))):
        result = score(df, "events", None, 168, EVENTS_AS_OF, earlier_row_counts=earlier)
        volume = views.issues(result).filter("check = 'volume'").agg(F.max("severity").alias("severity"))
        found = views.dimension_scores(result).filter("dimension = 'volumetry'").crossJoin(volume)  # one row each
        found = found.select(F.lit(name).alias("part"), "score", "severity")
        out = found if out is None else out.unionByName(found)
    return out


# ------------------------------------------------------------------ streams

_STREAM_CHECKS = [("event type is known", "event_type", "event_type NOT IN ('click', 'view')")]


def _stream_checks(df: DataFrame) -> list[Check]:
    rules = [Check("consistency", "rule", c, test, f"{c} IS NOT NULL", name=n) for n, c, test in _STREAM_CHECKS]
    return [*rules, Check("consistency", "negative", "value", "value < 50", "value IS NOT NULL"), *negative_checks(df)]


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed from files in an order of their own, counted by day as they come.

    The files are cut by a hash, so nearly all rows of the later ones are late.
    """
    events = table(spark, sf_dir, "events").withColumn("props", F.expr("IF(event_id % 7 = 0, NULL, props)"))
    source, kept, marks = (scratch_dir(spark, x) for x in ("stream", "windows", "marks"))
    events.repartition(4, "event_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    keep_windows(windowed_counts(stream, "ts", _stream_checks(events), "1 day", "60 days"), kept, marks).awaitTermination()
    found = latest_windows(spark, kept)
    names = ["n_rows", "props_nulls", "check_0_violations", "check_0_checked", "check_1_violations", "check_1_checked"]
    return found.select("window_start", *names)


# ------------------------------------------------------------------ samples


def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 orders by hash of their keys, from a table in another order and cut."""
    orders = table(spark, sf_dir, "orders").repartition(7, "o_totalprice")
    return sample_rows(orders, 500, by=["o_custkey", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus")


# ------------------------------------------------------------------ footers


def footer_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null counts of four tables, read off their files' footers where those can tell."""
    parts = [
        parquet_null_profile(spark, f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("table_name"), "*") for t in _PROFILED
    ]
    return reduce(DataFrame.unionByName, parts)


def footer_numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of three tables' numbers, read off footers where those can tell."""
    parts = [
        parquet_numeric_profile(spark, f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("table_name"), "*")
        for t in ("lineitem", "part", "customer")
    ]
    return reduce(DataFrame.unionByName, parts)


_PROFILED = ("orders", "customer", "documents", "events")


def growing_queries() -> dict:
    return {
        "footer_null_profile": footer_null_profile,
        "footer_numeric_profile": footer_numeric_profile,
        "merged_dimensions": merged_dimensions,
        "merged_issues": merged_issues,
        "duplicates_approx": duplicates_approx,
        "volumetry_by_day": volumetry_by_day,
        "score_with_history": score_with_history,
        "windowed_events": windowed_events,
        "sampled_rows": sampled_rows,
    }


# ------------------------------------------------------------------ SQL

_DAYS = "SELECT CAST(ts AS DATE) AS run, count(*) AS row_count FROM events GROUP BY CAST(ts AS DATE)"
_EXPECTED = f"""SELECT *, CASE WHEN count(*) OVER w >= 3 THEN avg(row_count) OVER w END AS expected_rows FROM ({_DAYS})
    WINDOW w AS (ORDER BY run ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""


def _volume(count: str) -> str:
    score = oracles.round1(f"greatest(0e0, 100 - abs({count} - expected_rows) / expected_rows * 100)")
    return f"CASE WHEN expected_rows IS NULL THEN 80e0 ELSE {score} END"


def _severity(count: str) -> str:
    return f"CASE WHEN abs({count} - expected_rows) / expected_rows > 1 THEN 'high' WHEN abs({count} - expected_rows) / expected_rows > 0.5 THEN 'medium' END"


def growing_oracles() -> dict[str, str]:
    thirds = "(SELECT count(*) FROM events WHERE CAST(ts AS DATE) = run AND event_id % 3 = 0)"
    last = f"(SELECT *, {thirds} AS thirds FROM ({_EXPECTED}) WHERE run = (SELECT max(CAST(ts AS DATE)) FROM events))"
    issues = oracles.dirty(f"SELECT * FROM ({oracles.issue_rows()}) WHERE dimension != 'uniqueness'")
    nulls = oracles.both(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS \"column\", {oracles.count_if(f'{c} IS NULL')} AS null_count, count(*) AS row_count,"
            f" {oracles.round1(f'(1 - {oracles.count_if(f"{c} IS NULL")} / count(*)) * 100')} AS completeness FROM {t}"
            for t in _PROFILED
            for c in oracles.types_of(t)
        ]
    )
    dirty_with_rule = oracles.all_oracles()["dimension_scores_with_rule"]
    distinct = oracles.dirty("SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS d FROM dirty")
    return {
        "merged_dimensions": f"SELECT dimension, score, true AS agrees FROM ({dirty_with_rule})",
        "footer_null_profile": nulls,
        "footer_numeric_profile": oracles.all_oracles()["numeric_profile"],
        "merged_issues": issues,
        "duplicates_approx": f"SELECT 'dirty_orders' AS table_name, n AS row_count, d AS distinct_rows, true AS close FROM ({distinct})"
        " UNION ALL SELECT 'lineitem', count(*), (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)), true FROM lineitem",
        "volumetry_by_day": f"SELECT run, row_count, round(expected_rows, 6) AS expected_rows, {_volume('row_count')} AS score FROM ({_EXPECTED})",
        "score_with_history": f"SELECT 'whole' AS part, {_volume('row_count')} AS score, {_severity('row_count')} AS severity FROM {last}"
        f" UNION ALL SELECT 'third', {_volume('thirds')}, {_severity('thirds')} FROM {last}",
        "windowed_events": "SELECT date_trunc('day', ts) AS window_start, count(*) AS n_rows, count(*) FILTER (event_id % 7 = 0) AS props_nulls,"
        " count(*) FILTER (event_type NOT IN ('click', 'view')) AS check_0_violations, count(event_type) AS check_0_checked,"
        " count(*) FILTER (value < 50) AS check_1_violations, count(value) AS check_1_checked FROM events GROUP BY date_trunc('day', ts)",
        "sampled_rows": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"
        " ORDER BY md5('v' || o_custkey || chr(31) || 'v' || o_orderkey) LIMIT 500",
    }
