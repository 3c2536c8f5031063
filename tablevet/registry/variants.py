"""Queries on the same tables in other shapes, beside the SQL they are checked against.

Written dates, files with other delimiters, rules and pairs that share a name, suggestions by
kind of column, catalog tables, reports, and sketches held against exact values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablevet.functions.values import quote_name, sql_text
from tablevet.operators import distinct, rules, suggest
from tablevet.operators.checks import numeric_columns
from tablevet.operators.freshness import freshness
from tablevet.operators.fused import rows_of
from tablevet.operators.quartiles import approximate_quartiles
from tablevet.operators.roles import ColumnRoles, Pair, detect_roles, roles_table
from tablevet.plans import views
from tablevet.plans.score import score
from tablevet.registry import oracles
from tablevet.registry.queries import DIRTY_AS_OF, EVENTS_AS_OF, dirty_orders, table
from tablevet.sources.files import DELIMITERS, read_csv, sniff_delimiter
from tablevet.sources.reports import write_report
from tablevet.sources.scratch import scratch_dir
from tablevet.sources.tables import list_tables, preview, read_table, table_size

# ------------------------------------------------------------------ rules and pairs of one name


def rules_same_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules of one name and column, and one of another column."""
    active = [
        rules.Rule("in range", "age >= 0", "age", "high"),
        rules.Rule("in range", "age <= 40", "age", "low"),
        rules.Rule("in range", "price_ht <= 100000", "price_ht"),
    ]
    result = score(dirty_orders(spark, sf_dir), "dirty_orders", active, 720, DIRTY_AS_OF)
    found = views.issues(result).filter("check = 'rule'")
    return found.select("column", "severity", "violations", "checked")


def pairs_same_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orders of the same two columns, both without a name."""
    pairs = [Pair("price_ht", "price_ttc", "<"), Pair("price_ht", "price_ttc", ">", severity="low")]
    df = dirty_orders(spark, sf_dir)
    result = score(df, "dirty_orders", None, 720, DIRTY_AS_OF, roles=ColumnRoles(pairs=pairs))
    found = views.issues(result).filter("check = 'pair'")
    return found.select("column", "severity", "violations", "checked")


def _rules_sql() -> str:
    tests = [("age", "high", "age >= 0"), ("age", "low", "age <= 40"), ("price_ht", "medium", "price_ht <= 100000")]
    return oracles.dirty(
        oracles.both(
            [
                f"SELECT '{c}' AS \"column\", '{s}' AS severity,"
                f" {oracles.count_if(f'NOT coalesce({t}, false)')} AS violations, count(*) AS checked FROM dirty"
                for c, s, t in tests
            ]
        )
    )


def _pairs_sql() -> str:
    return oracles.dirty(
        oracles.both(
            [
                f"SELECT 'price_ht/price_ttc' AS \"column\", '{s}' AS severity,"
                f" {oracles.count_if(f'price_ht {op} price_ttc')} AS violations,"
                f" count(price_ht + price_ttc) AS checked FROM dirty"
                for s, op in (("high", ">="), ("low", "<="))
            ]
        )
    )


# ------------------------------------------------------------------ written dates

# Spark's pattern and the other engine's for the same text.
WRITTEN = {
    "slashed": ("dd/MM/yyyy", "%d/%m/%Y"),
    "dashed": ("dd-MM-yyyy", "%d-%m-%Y"),
    "dotted": ("yyyy.MM.dd", "%Y.%m.%d"),
    "compact": ("yyyyMMdd", "%Y%m%d"),
    "short": ("d MMM yyyy", "%-d %b %Y"),
    "spoken": ("MMMM d, yyyy", "%B %-d, %Y"),
    "american": ("MM/dd/yyyy hh:mm a", "%m/%d/%Y %I:%M %p"),
    "two_digits": ("dd/MM/yy", "%d/%m/%y"),
}


def _written_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [F.date_format("o_orderdate", p).alias(c) for c, (p, _) in WRITTEN.items()]
    mail = F.expr("IF(o_orderkey % 5 = 0, o_orderpriority, concat('u', o_orderkey, '@mail.com'))")
    padded = F.concat(F.lit(" " * 80), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select(*shown, padded.alias("padded"), mail.alias("contact"), "o_orderpriority")


def freshness_written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _written_orders(spark, sf_dir)
    found = freshness(df, [*WRITTEN, "padded"], DIRTY_AS_OF, 720)
    return found.select("column", "max_ts", "unparsable")


def _mixed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in one form, but for one in 337 in the other."""
    american, european = (F.date_format("o_orderdate", p) for p in ("MM/dd/yyyy", "dd/MM/yyyy"))
    stray = F.expr("o_orderkey % 337 = 0")
    return table(spark, sf_dir, "orders").select(
        F.when(stray, european).otherwise(american).alias("mostly_american"),
        F.when(stray, american).otherwise(european).alias("mostly_european"),
        F.when(stray, "soon").otherwise(F.date_format("o_orderdate", "d/M/yy")).alias("short_european"),
    )


def freshness_mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stray date of the other order costs its own cell only."""
    df = _mixed_orders(spark, sf_dir)
    found = freshness(df, df.columns, DIRTY_AS_OF, 720)
    return found.select("column", "max_ts", "unparsable", "score")


def roles_mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date role is kept, whatever the strays."""
    df = _mixed_orders(spark, sf_dir)
    return roles_table(df, detect_roles(df))


def roles_by_content_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _written_orders(spark, sf_dir)
    return roles_table(df, detect_roles(df))


def _freshness_sql() -> str:
    latest = "max(date_trunc('day', o_orderdate))"
    rows = [
        f"SELECT '{c}' AS \"column\", {latest} AS max_ts,"
        f" CAST(0 AS BIGINT) AS unparsable FROM orders"
        for c in [*WRITTEN, "padded"]
    ]
    return oracles.both(rows)


_MIXED = """(SELECT *, o_orderkey % 337 = 0 AS stray, date_trunc('day', o_orderdate) AS own, CASE WHEN day(o_orderdate) <= 12
    THEN make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0.0) END AS swapped FROM orders)"""


def _mixed_sql() -> str:
    """A stray is misread where its day could be a month and lost where it could not."""
    now = f"TIMESTAMP '{DIRTY_AS_OF}'"
    lag = f"date_diff('microsecond', max_ts, {now}) / 3.6e9"
    parts = [
        f"SELECT '{c}' AS \"column\", max(CASE WHEN stray THEN {stray} ELSE own END) AS max_ts,"
        f" count(*) FILTER (stray AND {stray} IS NULL) AS unparsable FROM {_MIXED}"
        for c, stray in (("mostly_american", "swapped"), ("mostly_european", "swapped"), ("short_european", "CAST(NULL AS TIMESTAMP)"))
    ]
    return f"SELECT *, least(100.0, greatest(0.0, 100 - {lag} / 720 * 100)) AS score FROM ({oracles.both(parts)})"


def _mixed_roles_sql() -> str:
    rows = [
        f"SELECT '{c}' AS \"column\", 'date' AS role FROM {_MIXED} HAVING count(CASE WHEN stray THEN {stray} ELSE own END) / count(*) > 0.7"
        for c, stray in (("mostly_american", "swapped"), ("mostly_european", "swapped"), ("short_european", "NULL"))
    ]
    return oracles.both(rows)


def _roles_sql() -> str:
    dates = [
        f"SELECT '{c}' AS \"column\", 'date' AS role FROM orders"
        f" HAVING count(try_strptime(strftime(o_orderdate, '{p}'), '{p}')) / count(*) > 0.7"
        for c, (_, p) in WRITTEN.items()
    ]
    dates.append("SELECT 'padded', 'date' FROM orders HAVING count(o_orderdate) / count(*) > 0.7")
    mail = "SELECT 'contact', 'email' FROM orders HAVING count(*) FILTER (WHERE o_orderkey % 5 != 0) / count(*) > 0.7"
    return oracles.both([*dates, mail])


# ------------------------------------------------------------------ files


def csv_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written with every usual delimiter and read back with the sniffed one."""
    source = spark.read.parquet(f"{sf_dir}/customer.parquet")
    out = None
    for d in DELIMITERS:
        path = f"{scratch_dir(spark, 'delimiters')}/customer.txt"
        source.write.options(header=True, sep=d, quote='"', escape='"').csv(path)
        df = read_csv(spark, path, sep=sniff_delimiter(spark, path, among=DELIMITERS))
        found = df.agg(
            F.lit(d).alias("delimiter"), F.lit(len(df.columns)).alias("n_columns"), F.count("*").alias("n_rows"),
            F.sum("c_custkey").alias("keys"), F.round(F.sum("c_acctbal"), 2).alias("balance"),
        )
        out = found if out is None else out.unionByName(found)
    return out


def csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks written as CSV and read back by default options."""
    path = f"{scratch_dir(spark, 'breaks')}/documents.csv"
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    source.write.options(header=True, quote='"', escape='"', **keep).csv(path)
    df = read_csv(spark, path, sep=",")
    return df.select("doc_id", "lang", F.md5("text").alias("digest"))


def _delimiters_sql() -> str:
    names = {",": "','", ";": "';'", "\t": "chr(9)", "|": "'|'"}
    return oracles.both(
        [
            f"SELECT {names[d]} AS delimiter, CAST(5 AS INT) AS n_columns, count(*) AS n_rows,"
            f" CAST(sum(c_custkey) AS BIGINT) AS keys, round(sum(c_acctbal), 2) AS balance FROM customer"
            for d in DELIMITERS
        ]
    )


# ------------------------------------------------------------------ suggestions


def suggest_numeric_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is suggested for the numbers of three tables and of a share in percent."""
    tables = {t: table(spark, sf_dir, t) for t in ("part", "lineitem", "customer")}
    tables["shares"] = tables["lineitem"].selectExpr("l_discount * 100 AS discount_pct", "l_linenumber AS line_count")
    out = None
    for name, df in tables.items():
        found = suggest.suggestions_table(df, suggest.suggest_rules(df)).filter("NOT contains(condition, ' IN (')")
        found = found.select(F.lit(name).alias("table_name"), "name", "condition", "severity")
        out = found if out is None else out.unionByName(found)
    return out


def _suggest_sql() -> str:
    def row(source, name, condition, severity, when="true", t=None):
        return (
            f"SELECT '{t or source}' AS table_name, {name} AS name, {condition} AS condition, '{severity}' AS severity"
            f" FROM {source} HAVING {when}"
        )

    rows = []
    for t, c in (("part", "p_retailprice"), ("lineitem", "l_extendedprice")):
        rows.append(row(t, f"'{c}: not negative'", f"'`{c}` >= 0'", "high"))
        cap = f"CAST(trunc(max({c}) * 3) AS BIGINT)"
        name = f"'{c}: no extreme value (<= ' || format('{{:,}}', {cap}) || ')'"
        rows.append(row(t, name, f"'`{c}` <= ' || {cap}", "medium", f"max({c}) < 100000"))
    rows.append(row("lineitem", "'l_quantity: not a negative quantity'", "'`l_quantity` >= 0'", "medium"))
    rows.append(row("lineitem", "'line_count: not a negative quantity'", "'`line_count` >= 0'", "medium", t="shares"))
    for t, c, x in (("lineitem", "l_discount", "l_discount"), ("shares", "discount_pct", "l_discount * 100")):
        kind = f"CASE WHEN max({x}) <= 1 THEN 'rate' ELSE 'percentage' END"
        top = f"CASE WHEN max({x}) <= 1 THEN '1' ELSE '100' END"
        rows.append(row("lineitem", f"'{c}: ' || {kind} || ' from 0 to ' || {top}", f"'`{c}` >= 0 AND `{c}` <= ' || {top}", "high", t=t))
    share = "count(*) FILTER (WHERE c_acctbal < 0) / count(c_acctbal) > 0.05"
    rows.append(row("customer", "'c_acctbal: no negative value'", "'`c_acctbal` >= 0'", "medium", share))
    return oracles.both(rows)


# ------------------------------------------------------------------ reports and the catalog


def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of orders written and its column scores read back."""
    result = score(table(spark, sf_dir, "orders"), "sales.orders", None, 168, EVENTS_AS_OF)
    written = write_report(result, scratch_dir(spark, "report"), EVENTS_AS_OF)
    found = spark.read.parquet(written["column_scores"])
    return found.select("table_name", "run", "column", "completeness", "uniqueness", "overall")


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables saved under a schema of their own, listed, read by name and counted."""
    schema = f"tablevet_{scratch_dir(spark, 'x').rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {schema} LOCATION {sql_text(scratch_dir(spark, 'catalog'))}")
    try:
        for name in ("nation", "region", "supplier"):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").write.saveAsTable(f"{schema}.{name}")
        names = [r.table_name for r in list_tables(spark, schema).collect()]
        first = [r.table_name for r in list_tables(spark, schema, most=2).collect()]
        rows = []
        for name in names:
            size = table_size(read_table(spark, name, schema)).first()
            rows.append((name, name in first, size.row_count, size.col_count))
    finally:
        spark.sql(f"DROP DATABASE {schema} CASCADE")
    return spark.createDataFrame(rows, "table_name string, among_first boolean, row_count bigint, col_count int")


# ------------------------------------------------------------------ sketches against exact values


def quartiles_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each sketched quartile lies within 1.1 points of its rank, by counts of all values."""
    df = table(spark, sf_dir, "lineitem")
    names = numeric_columns(df)
    doubles = [f"CAST({quote_name(c)} AS DOUBLE)" for c in names]
    sketches = df.selectExpr(*[f"{approximate_quartiles(x)} AS s{i}" for i, x in enumerate(doubles)])
    both = df.crossJoin(F.broadcast(sketches))  # one row
    records = [
        {"column": sql_text(c)}
        | {
            f"{q}_close": f"count_if({x} < s{i}[{k}]) <= count({x}) * {at + 0.011} AND count_if({x} <= s{i}[{k}]) >= count({x}) * {at - 0.011}"
            for k, (q, at) in enumerate((("q1", 0.25), ("q3", 0.75)))
        }
        for i, (c, x) in enumerate(zip(names, doubles))
    ]
    return rows_of(both, records, "column:string, q1_close:boolean, q3_close:boolean")


def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each sketched number of distinct values is within 15 % of the exact one."""
    df = table(spark, sf_dir, "lineitem")
    records = [{"column": sql_text(c), "approx": f"approx_count_distinct({quote_name(c)})"} for c in df.columns]
    sketched = rows_of(df, records, "column:string, approx:bigint")
    exact = distinct.distinct_values(df, distinct.typed_columns(df)).withColumnRenamed("key", "column")
    close = F.abs(F.col("approx") - F.col("distinct_count")) <= F.col("distinct_count") * 0.15
    return sketched.join(exact, "column").select("column", F.col("distinct_count").alias("exact"), close.alias("close"))


def sketched_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact scores of lineitem, and whether those from sketches are within 5 points."""
    df = table(spark, sf_dir, "lineitem")
    exact, sketched = (views.dimension_scores(score(df, "lineitem", None, 168, EVENTS_AS_OF, exact=e)) for e in (True, False))
    near = sketched.select("dimension", F.col("score").alias("sketched"))
    close = (F.abs(F.col("score") - F.col("sketched")) <= 5).alias("close")
    return exact.join(near, "dimension").select("dimension", "score", close)


def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a preview has, and how many of them the table holds."""
    df = table(spark, sf_dir, "lineitem")
    shown = preview(df)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    held = shown.join(df.select(*keys), keys, "left_semi").agg(F.count("*").alias("found"))
    return shown.agg(F.count("*").alias("shown")).crossJoin(held)


def variant_queries() -> dict:
    return {
        "rules_same_name": rules_same_name,
        "pairs_same_columns": pairs_same_columns,
        "freshness_written_dates": freshness_written_dates,
        "freshness_mixed_order": freshness_mixed_order,
        "roles_mixed_order": roles_mixed_order,
        "roles_by_content_decided": roles_by_content_decided,
        "csv_delimiters": csv_delimiters,
        "csv_line_breaks": csv_line_breaks,
        "suggest_numeric_rules": suggest_numeric_rules,
        "report_roundtrip": report_roundtrip,
        "catalog_tables": catalog_tables,
        "quartiles_approx": quartiles_approx,
        "approx_distinct": approx_distinct,
        "sketched_dimensions": sketched_dimensions,
        "preview": preview_rows,
    }


def variant_oracles() -> dict[str, str]:
    lineitem = oracles.types_of("lineitem")
    orders = oracles.column_rows("orders", oracles.types_of("orders"))
    return {
        "rules_same_name": _rules_sql(),
        "pairs_same_columns": _pairs_sql(),
        "freshness_written_dates": _freshness_sql(),
        "freshness_mixed_order": _mixed_sql(),
        "roles_mixed_order": _mixed_roles_sql(),
        "roles_by_content_decided": _roles_sql(),
        "csv_delimiters": _delimiters_sql(),
        "csv_line_breaks": "SELECT doc_id, lang, md5(text) AS digest FROM documents",
        "suggest_numeric_rules": _suggest_sql(),
        "report_roundtrip": f"SELECT 'sales_orders' AS table_name, '20240201_000000' AS run, * FROM ({orders})",
        "catalog_tables": oracles.both(
            [
                f"SELECT '{t}' AS table_name, {first} AS among_first, count(*) AS row_count, CAST({n} AS INT) AS col_count FROM {t}"
                for t, first, n in (("nation", "true", 3), ("region", "true", 2), ("supplier", "false", 4))
            ]
        ),
        "quartiles_approx": oracles.both(
            [
                f"SELECT '{c}' AS \"column\", count({c}) > 0 AS q1_close, count({c}) > 0 AS q3_close FROM lineitem"
                for c, t in lineitem.items()
                if t == "n"
            ]
        ),
        "approx_distinct": oracles.both(
            [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS exact, true AS close FROM lineitem" for c in lineitem]
        ),
        "sketched_dimensions": f"SELECT dimension, score, true AS close FROM ({oracles.table_dimensions('lineitem')})",
        "preview": "SELECT least(count(*), 50) AS shown, least(count(*), 50) AS found FROM lineitem",
    }
