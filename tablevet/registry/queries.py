"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablevet.functions.text import folded
from tablevet.functions.values import normalize, quote_name, round1_sql
from tablevet.operators import checks, distinct, rules, suggest
from tablevet.operators.freshness import freshness
from tablevet.operators.fused import Check, FusedScan, count_checks
from tablevet.operators.quartiles import quartiles
from tablevet.operators.roles import ColumnRoles, detect_roles, role_shares, roles_table
from tablevet.plans import views
from tablevet.plans.score import MIN_VALUES_FOR_OUTLIERS, ScoreResult, score
from tablevet.sources.files import delimiter_counts, read_csv
from tablevet.sources.scratch import scratch_dir
from tablevet.sources.tables import table_size

DIRTY_AS_OF = datetime(2002, 1, 2)
EVENTS_AS_OF = datetime(2024, 2, 1)
SCORED_TABLES = (
    "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return normalize(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a flaw of every kind planted by key, and some rows twice."""
    key = "CAST(o_orderkey AS STRING)"
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        f"IF(o_orderkey % 8 = 0, 'invalid', concat('user', {key}, '@mail.com')) AS email",
        f"IF(o_orderkey % 10 = 0, 'abc', concat('+336', lpad({key}, 8, '0'))) AS phone",
        "CAST(IF(o_orderkey % 15 = 0, -5, 18 + o_custkey % 62) AS INT) AS age",
        "IF(o_orderkey % 97 = 0, 9000000e0, o_totalprice) AS price_ht",
        "IF(o_orderkey % 50 = 0, o_totalprice * 0.5e0, o_totalprice * 1.2e0) AS price_ttc",
        "CASE WHEN o_orderkey % 20 < 6 THEN 'active' WHEN o_orderkey % 20 < 10 THEN 'ACTIVE'"
        " WHEN o_orderkey % 20 < 12 THEN 'Active' WHEN o_orderkey % 20 < 19 THEN 'inactive'"
        " END AS status",
        "CASE WHEN o_orderkey % 20 < 6 THEN 'France' WHEN o_orderkey % 20 < 9 THEN 'FRANCE'"
        " WHEN o_orderkey % 20 < 11 THEN ' france ' WHEN o_orderkey % 20 < 19 THEN 'Germany'"
        " ELSE 'N/A' END AS country",
        "IF(o_orderkey % 3 = 0, NULL, o_orderpriority) AS note",
        "o_orderdate AS created_at",
        "IF(o_orderkey % 40 = 0, TIMESTAMP'1990-01-01 00:00:00',"
        " TIMESTAMP'2002-01-01 00:00:00') AS closed_at",
        "IF(o_orderkey % 30 = 0, 'not-a-date', CAST(o_orderdate AS STRING)) AS modified_at",
    )
    return base.unionByName(base.filter("id % 24 = 0"))


ACTIVE_RULES = [
    rules.build_rule("status is active", "status", "==", "active", "high"),
    rules.Rule("age is set", "age >= 0 AND age <= 120", "age", "medium"),
    rules.build_rule("status is not inactive", "status", "!=", "inactive", "low"),
    rules.Rule("gross above net", "price_ht < price_ttc", "price_ht"),
]


def _rule_counts(df: DataFrame, active: list, null_policy: str = "violation") -> DataFrame:
    compiled = rules.compile_rules(df, active, null_policy)
    return count_checks(compiled.df, compiled.checks).select(
        F.col("name").alias("rule"), "severity", "violations", "checked"
    )


def rule_violations(spark, sf_dir, null_policy="violation"):
    return _rule_counts(dirty_orders(spark, sf_dir), ACTIVE_RULES, null_policy)


def rule_coerced_compare(spark, sf_dir):
    active = [
        rules.build_rule("modified_at over 0", "modified_at", ">", "0"),
        rules.build_rule("phone over 500", "phone", ">", "500"),
        rules.build_rule("phone is not 7", "phone", "!=", "7"),
    ]
    return _rule_counts(dirty_orders(spark, sf_dir), active).select("rule", "violations")


def rule_not_applicable(spark, sf_dir):
    """Two rules that cannot apply beside one that does; all leave an issue."""
    result = score(
        dirty_orders(spark, sf_dir),
        "dirty_orders",
        [
            rules.Rule("no such column", "missing_column > 0", "missing_column"),
            rules.Rule("not a condition", "age + 1", "age"),
            ACTIVE_RULES[0],
        ],
        720,
        DIRTY_AS_OF,
    )
    return views.issues(result).filter("check LIKE 'rule%'").select("check", "severity", "column")


def null_profile(spark, sf_dir):
    return checks.null_profile(dirty_orders(spark, sf_dir))


def completeness_score(spark, sf_dir):
    parts = [
        checks.completeness(df).select(F.lit(name).alias("table_name"), "*")
        for name, df in (
            ("dirty_orders", dirty_orders(spark, sf_dir)),
            ("lineitem", table(spark, sf_dir, "lineitem")),
        )
    ]
    return parts[0].unionByName(parts[1])


def duplicate_rows(spark, sf_dir):
    return distinct.duplicate_rows(dirty_orders(spark, sf_dir))


def freshness_events(spark, sf_dir):
    found = freshness(table(spark, sf_dir, "events"), ["ts"], EVENTS_AS_OF, 168)
    return found.select("column", "max_ts", "lag_hours", "score")


def freshness_string_dates(spark, sf_dir):
    found = freshness(dirty_orders(spark, sf_dir), ["modified_at"], DIRTY_AS_OF, 720)
    return found.select("max_ts", "unparsable")


def negative_values(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    return count_checks(df, checks.negative_checks(df)).select("column", "violations", "checked")


def quartiles_exact(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    found = quartiles(df, _filled_numbers(df))
    rows = [(c, round(q1, 6), round(q3, 6), round(q3 - q1, 6)) for c, (q1, q3) in found.items()]
    return spark.createDataFrame(rows, "column string, q1 double, q3 double, iqr double")


def _filled_numbers(df: DataFrame) -> dict[str, tuple[str, int]]:
    scan = FusedScan()
    for c in checks.numeric_columns(df):
        scan.want(c, f"count({quote_name(c)})")
    filled = scan.run(df)
    return {
        c: (f"CAST({quote_name(c)} AS DOUBLE)", n)
        for c, n in filled.items()
        if n >= MIN_VALUES_FOR_OUTLIERS
    }


def outliers(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    fences = quartiles(df, _filled_numbers(df))
    counted = count_checks(df, checks.outlier_checks(df, fences))
    return counted.select(
        "column",
        F.col("violations").alias("outliers"),
        "checked",
        (F.col("violations") / F.col("checked")).alias("ratio"),
    )


def _scored_checks(df: DataFrame, found: list[Check]) -> DataFrame:
    score_sql = round1_sql("greatest(0e0, (1 - violations / checked) * 100)")
    return count_checks(df, found).selectExpr(
        "column", "violations", "checked", f"{score_sql} AS score"
    )


def email_validity(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    return _scored_checks(df, checks.email_checks(df, ColumnRoles(emails=["email"])))


def phone_validity(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    return _scored_checks(df, checks.phone_checks(df, ColumnRoles(phones=["phone"])))


def pair_order(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    counted = count_checks(df, checks.pair_checks(df, detect_roles(df).pairs))
    sides = F.split("column", "/")
    return counted.select(
        sides[0].alias("col_a"), sides[1].alias("col_b"), "violations", "checked"
    )


def padded_strings(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    return count_checks(df, checks.padding_checks(df)).select("column", "violations", "checked")


def fake_nulls(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    return count_checks(df, checks.fake_null_checks(df)).select("column", "violations", "checked")


def padded_texts(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    found = [*checks.padding_checks(df), *checks.fake_null_checks(df)]
    named = [Check(c.dimension, c.kind, c.column, c.violation, c.checked, name=c.kind) for c in found]
    return count_checks(df, named).selectExpr("column", "name AS check", "violations", "checked")


def case_variants(spark, sf_dir):
    """Spellings and normalised spellings of every string column, both exact."""
    df = dirty_orders(spark, sf_dir)
    texts = checks.string_columns(df)
    cells = {f"{c}|spellings": (quote_name(c), T.StringType()) for c in texts}
    cells |= {f"{c}|values": (folded(quote_name(c)), T.StringType()) for c in texts}
    counted = distinct.distinct_values(df, cells)
    key = F.split("key", r"\|")
    n = F.col("distinct_count")
    return counted.groupBy(key[0].alias("column")).agg(
        F.max(F.when(key[1] == "spellings", n)).alias("spellings"),
        F.max(F.when(key[1] == "values", n)).alias("distinct_values"),
    )


def distinct_per_column(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    found = distinct.distinct_values(df, distinct.typed_columns(df), whole_rows=True)
    return found.select("key", "distinct_count")


def dirty_score(spark: SparkSession, sf_dir: str, active: list | None = None) -> ScoreResult:
    df = dirty_orders(spark, sf_dir)
    return score(df, "dirty_orders", active, 720, DIRTY_AS_OF, stage=True)


def dimension_scores(spark, sf_dir):
    return views.dimension_scores(dirty_score(spark, sf_dir))


def dimension_scores_with_rule(spark, sf_dir):
    found = views.dimension_scores(dirty_score(spark, sf_dir, ACTIVE_RULES[:1]))
    return found.select("ordinal", "dimension", "weight", "score", "grade")


def standardization_score(spark, sf_dir):
    found = views.dimension_scores(dirty_score(spark, sf_dir))
    return found.filter("dimension = 'standardization'").select("dimension", "score")


def global_score(spark, sf_dir):
    return views.global_score(dirty_score(spark, sf_dir))


def issues(spark, sf_dir):
    return views.issues(dirty_score(spark, sf_dir, ACTIVE_RULES)).select(
        "dimension", "severity", "column", "check", "violations", "checked"
    )


def issue_severity_counts(spark, sf_dir):
    return views.issue_severity_counts(dirty_score(spark, sf_dir, ACTIVE_RULES))


def run_summary(spark, sf_dir):
    return views.run_summary(dirty_score(spark, sf_dir, ACTIVE_RULES))


def column_scores(spark, sf_dir):
    return views.column_scores(dirty_score(spark, sf_dir))


def worst_columns(spark, sf_dir):
    """The 14 worst columns of all scored columns of lineitem and orders."""
    result = score(_wide_orders(spark, sf_dir), "wide_orders", None, 720, DIRTY_AS_OF)
    return views.worst_columns(result)


def _wide_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty orders with more columns than the report shows."""
    return dirty_orders(spark, sf_dir).selectExpr(
        "*",
        "IF(id % 2 = 0, NULL, status) AS half_status",
        "IF(id % 4 = 0, country, NULL) AS quarter_country",
        "id % 7 AS week_slot",
        "id % 1000 AS bucket",
    )


def table_dimensions(spark, sf_dir, name):
    result = score(table(spark, sf_dir, name), name, None, 168, EVENTS_AS_OF)
    return views.dimension_scores(result)


def table_columns(spark, sf_dir, name):
    result = score(table(spark, sf_dir, name), name, None, 168, EVENTS_AS_OF)
    return views.column_scores(result)


def roles_by_content(spark, sf_dir):
    return role_shares(dirty_orders(spark, sf_dir))


def detected_roles(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    return roles_table(df, detect_roles(df))


def numeric_profile(spark, sf_dir):
    parts = [
        checks.numeric_profile(table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "*")
        for t in ("lineitem", "part", "customer")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def allowed_values(spark, sf_dir):
    return suggest.allowed_values(table(spark, sf_dir, "orders"))


def suggest_rules(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    found = suggest.suggestions_table(df, suggest.suggest_rules(df))
    return found.select("name", "condition", "column", "severity")


def suggest_rules_new(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    active = [rules.Rule("email: valid e-mail", "contains(email, '@')", "email", "high")]
    found = suggest.suggestions_table(df, suggest.suggest_rules(df))
    return suggest.without_active(found, views.rules_frame(spark, active)).select(
        "name", "column", "severity"
    )


def suggested_rule_violations(spark, sf_dir):
    """Every suggestion taken over as a rule and evaluated."""
    df = dirty_orders(spark, sf_dir)
    return _rule_counts(df, [s.as_rule() for s in suggest.suggest_rules(df)])


def union_duplicates(spark, sf_dir):
    found = distinct.duplicate_rows(dirty_orders(spark, sf_dir))
    return found.selectExpr(
        "inline(array(struct('kept' AS kind, distinct_rows AS row_count),"
        " struct('added' AS kind, dup_rows AS row_count)))"
    )


def csv_roundtrip(spark, sf_dir):
    """Customers written as semicolon CSV and read back with sniffed delimiter and types."""
    path = f"{scratch_dir(spark, 'csv')}/customer.csv"
    source = spark.read.parquet(f"{sf_dir}/customer.parquet")
    source.write.options(header=True, sep=";", quote='"', escape='"').csv(path)
    return read_csv(spark, path)


def table_roundtrip(spark, sf_dir):
    """Suppliers saved as a catalog table and read back by name."""
    name = f"supplier_{scratch_dir(spark, 'x').rsplit('-', 1)[1]}"
    path = f"{scratch_dir(spark, 'table')}/supplier"
    spark.read.parquet(f"{sf_dir}/supplier.parquet").write.option("path", path).saveAsTable(name)
    return spark.read.table(name)


def table_sizes(spark, sf_dir):
    parts = [
        table_size(table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "*")
        for t in SCORED_TABLES
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def document_delimiters(spark, sf_dir):
    return delimiter_counts(table(spark, sf_dir, "documents"), "text")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "null_profile": null_profile,
        "completeness_score": completeness_score,
        "duplicate_rows": duplicate_rows,
        "freshness_events": freshness_events,
        "freshness_string_dates": freshness_string_dates,
        "negative_values": negative_values,
        "rule_violations": rule_violations,
        "rule_violations_null_ignored": partial(rule_violations, null_policy="ignore"),
        "rule_coerced_compare": rule_coerced_compare,
        "rule_not_applicable": rule_not_applicable,
        "quartiles": quartiles_exact,
        "outliers": outliers,
        "email_validity": email_validity,
        "phone_validity": phone_validity,
        "pair_order": pair_order,
        "padded_strings": padded_strings,
        "fake_nulls": fake_nulls,
        "padded_texts": padded_texts,
        "case_variants": case_variants,
        "distinct_per_column": distinct_per_column,
        "standardization_score": standardization_score,
        "dimension_scores": dimension_scores,
        "dimension_scores_with_rule": dimension_scores_with_rule,
        "global_score": global_score,
        "issues": issues,
        "issue_severity_counts": issue_severity_counts,
        "run_summary": run_summary,
        "column_scores": column_scores,
        "worst_columns": worst_columns,
        "roles_by_content": roles_by_content,
        "detected_roles": detected_roles,
        "numeric_profile": numeric_profile,
        "allowed_values": allowed_values,
        "suggest_rules": suggest_rules,
        "suggest_rules_new": suggest_rules_new,
        "suggested_rule_violations": suggested_rule_violations,
        "union_duplicates": union_duplicates,
        "csv_roundtrip": csv_roundtrip,
        "table_roundtrip": table_roundtrip,
        "table_sizes": table_sizes,
        "document_delimiters": document_delimiters,
    }
    for name in SCORED_TABLES:
        found[f"score_{name}"] = partial(table_dimensions, name=name)
        found[f"columns_{name}"] = partial(table_columns, name=name)
    return found
