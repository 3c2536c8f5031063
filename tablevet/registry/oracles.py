"""The same answers in plain SQL, for an independent engine to compute."""

from __future__ import annotations

EMAIL = r"'^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\n?\z'"
PHONE = r"'^[+\p{Nd}][\p{Nd}\s\p{Z}\-.()]{6,20}\n?\z'"
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
TOKENS = "('n/a', 'na', 'null', 'none', '-', '--', 'unknown', 'inconnu', '?', 'nan', 'nd')"

DIRTY = """dirty_base AS (
SELECT o_orderkey AS id,
 CASE WHEN o_orderkey % 8 = 0 THEN 'invalid' ELSE 'user' || CAST(o_orderkey AS VARCHAR) || '@mail.com' END AS email,
 CASE WHEN o_orderkey % 10 = 0 THEN 'abc' ELSE '+336' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END AS phone,
 CAST(CASE WHEN o_orderkey % 15 = 0 THEN -5 ELSE 18 + o_custkey % 62 END AS INT) AS age,
 CASE WHEN o_orderkey % 97 = 0 THEN 9000000.0e0 ELSE o_totalprice END AS price_ht,
 CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 0.5e0 ELSE o_totalprice * 1.2e0 END AS price_ttc,
 CASE WHEN o_orderkey % 20 < 6 THEN 'active' WHEN o_orderkey % 20 < 10 THEN 'ACTIVE'
      WHEN o_orderkey % 20 < 12 THEN 'Active' WHEN o_orderkey % 20 < 19 THEN 'inactive' END AS status,
 CASE WHEN o_orderkey % 20 < 6 THEN 'France' WHEN o_orderkey % 20 < 9 THEN 'FRANCE'
      WHEN o_orderkey % 20 < 11 THEN ' france ' WHEN o_orderkey % 20 < 19 THEN 'Germany' ELSE 'N/A' END AS country,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS note,
 o_orderdate AS created_at,
 CASE WHEN o_orderkey % 40 = 0 THEN CAST('1990-01-01 00:00:00' AS TIMESTAMP)
      ELSE CAST('2002-01-01 00:00:00' AS TIMESTAMP) END AS closed_at,
 CASE WHEN o_orderkey % 30 = 0 THEN 'not-a-date' ELSE CAST(o_orderdate AS VARCHAR) END AS modified_at
FROM orders),
dirty AS (SELECT * FROM dirty_base UNION ALL SELECT * FROM dirty_base WHERE id % 24 = 0)"""

DIRTY_TYPES = {
    "id": "n", "email": "s", "phone": "s", "age": "n", "price_ht": "n", "price_ttc": "n",
    "status": "s", "country": "s", "note": "s", "created_at": "t", "closed_at": "t",
    "modified_at": "s",
}
# Column types of the given tables: n number, s string, t timestamp, o other.
TYPES = {
    "customer": "c_custkey n, c_name s, c_nationkey n, c_acctbal n, c_mktsegment s",
    "supplier": "s_suppkey n, s_name s, s_nationkey n, s_acctbal n",
    "part": "p_partkey n, p_name s, p_brand s, p_type s, p_size n, p_retailprice n",
    "orders": "o_orderkey n, o_custkey n, o_orderstatus s, o_totalprice n, o_orderdate t,"
    " o_orderpriority s",
    "lineitem": "l_orderkey n, l_partkey n, l_suppkey n, l_linenumber n, l_quantity n,"
    " l_extendedprice n, l_discount n, l_tax n, l_returnflag s, l_linestatus s, l_shipdate t",
    "events": "event_id n, ts t, user_id n, event_type s, value n, props s",
    "documents": "doc_id n, text s, lang s, source s, n_chars n",
    "embeddings": "vec_id n, embedding o, label n",
    "pages": "page_id n, url s, html s",
    "benchmark": "item_id n, text s",
    "labels": "doc_id n, quality n, toxic n",
    "conversations": "conv_id n, turn n, role s, text s",
}
# Numbers whose name says they must not be negative.
NON_NEGATIVE = {
    "orders": ["o_totalprice"],
    "lineitem": ["l_quantity", "l_extendedprice"],
    "part": ["p_retailprice"],
    "pages": ["page_id"],
}
DATES = {"orders": ["o_orderdate"], "lineitem": ["l_shipdate"], "events": ["ts"]}
WEIGHTS = [
    ("completeness", "0.2e0"), ("consistency", "0.15e0"), ("validity", "0.15e0"),
    ("uniqueness", "0.12e0"), ("freshness", "0.1e0"), ("distribution", "0.08e0"),
    ("correlation", "0.08e0"), ("volumetry", "0.07e0"), ("standardization", "0.05e0"),
]


def round1(x: str) -> str:
    return f"floor(({x}) * 10e0 + 0.5e0) / 10e0"


def types_of(name: str) -> dict[str, str]:
    return dict(part.split() for part in TYPES[name].split(","))


def folded(c: str) -> str:
    return f"lower(regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g'))"


def padded(c: str) -> str:
    return rf"regexp_matches({c}, '^{SPACE}|{SPACE}\z')"


def grade(c: str) -> str:
    return f"CASE WHEN {c} >= 80 THEN 'good' WHEN {c} >= 60 THEN 'medium' ELSE 'critical' END"


def share(violations: str, checked: str) -> str:
    return (
        f"CASE WHEN {checked} = 0 THEN 90e0 ELSE"
        f" {round1(f'least(100e0, greatest(0e0, (1 - {violations} / {checked}) * 100))')} END"
    )


def count_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def both(records: list[str]) -> str:
    return " UNION ALL ".join(records)


def dirty(select: str) -> str:
    return f"WITH {DIRTY} {select}"


# ------------------------------------------------------------------ whole scores


def dimension_ctes(
    source: str,
    types: dict[str, str],
    as_of: str,
    threshold: int,
    negatives: list[str],
    dates: list[str],
    emails: tuple = (),
    phones: tuple = (),
    pairs: tuple = (),
    rules: tuple = (),
) -> str:
    """CTEs ending in ``dims(completeness, …, standardization)``, one row."""
    numbers = [c for c, t in types.items() if t == "n"]
    texts = [c for c, t in types.items() if t == "s"]
    nulls = " + ".join(count_if(f"{c} IS NULL") for c in types)

    lags = [
        f"(epoch_us(TIMESTAMP '{as_of}') - epoch_us(max(TRY_CAST({c} AS TIMESTAMP)))) / 3.6e9"
        for c in dates
    ]
    fresh = [f"least(100e0, greatest(0e0, 100 - {lag} / {threshold}e0 * 100))" for lag in lags]
    freshness = round1(f"({' + '.join(fresh)}) / {len(fresh)}") if fresh else "75e0"

    failing = [f"{c} < 0" for c in negatives] + [f"NOT coalesce({r}, false)" for r in rules]
    consistency_v = " + ".join(map(count_if, failing)) or "0"
    consistency_c = f"{len(failing)} * count(*)"

    formats = [(c, EMAIL) for c in emails] + [(c, PHONE) for c in phones]
    validity_v = " + ".join(
        count_if(f"{c} IS NOT NULL AND NOT regexp_matches(CAST({c} AS VARCHAR), {p})")
        for c, p in formats
    ) or "0"
    validity_c = " + ".join(f"count({c})" for c, _ in formats) or "0"

    pairs_v = " + ".join(count_if(f"{a} >= {b}") for a, b in pairs) or "0"
    pairs_c = " + ".join(count_if(f"{a} IS NOT NULL AND {b} IS NOT NULL") for a, b in pairs) or "0"

    ratios = both(
        [
            f"SELECT {count_if(f'{c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)')}"
            f" / count({c}) AS ratio FROM {source}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,"
            f" quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source})"
            f" HAVING count({c}) >= 10 AND max(q3 - q1) <> 0"
            for c in numbers
        ]
    )
    spelled = both(
        [
            f"SELECT count(DISTINCT {c}) AS nu, count(DISTINCT {folded(c)}) AS nl,"
            f" {count_if(f'{c} IS NOT NULL AND {padded(c)}')}"
            f" + {count_if(f'{folded(c)} IN {TOKENS}')} AS v, count({c}) AS c FROM {source}"
            for c in texts
        ]
    )
    standard = (
        f"SELECT {share('s.v', 's.c')} AS score FROM (SELECT coalesce(sum(v + CASE WHEN nu BETWEEN 2 AND 50"
        f" AND nl < nu THEN (nu - nl) * 10 ELSE 0 END), 0) AS v, coalesce(sum(c), 0) AS c FROM spelled) s"
        if texts
        else "SELECT 90e0 AS score"
    )
    copies = f"(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})))"
    return f"""
ratios AS ({ratios or "SELECT 0e0 AS ratio WHERE false"}),
spelled AS ({spelled or "SELECT 0 AS nu, 0 AS nl, 0 AS v, 0 AS c WHERE false"}),
standard AS ({standard}),
dims AS (SELECT
 {round1(f"(1 - ({nulls}) / (count(*) * {len(types)})) * 100")} AS completeness,
 {share(f"({consistency_v})", f"({consistency_c})")} AS consistency,
 {share(f"({validity_v})", f"({validity_c})")} AS validity,
 {round1(f"greatest(0e0, 100 - {copies} / count(*) * 100 * 2)")} AS uniqueness,
 {freshness} AS freshness,
 (SELECT CASE WHEN count(*) = 0 THEN 90e0 ELSE {round1("greatest(0e0, 100 - avg(ratio) * 500)")} END FROM ratios) AS distribution,
 {share(f"({pairs_v})", f"({pairs_c})")} AS correlation,
 80e0 AS volumetry,
 (SELECT score FROM standard) AS standardization
FROM {source})"""


def dirty_ctes(rules: tuple = ()) -> str:
    return f"{DIRTY}," + dimension_ctes(
        "dirty", DIRTY_TYPES, "2002-01-02 00:00:00", 720, ["age", "price_ht", "price_ttc"],
        ["created_at", "closed_at", "modified_at"], ("email",), ("phone",),
        (("price_ht", "price_ttc"), ("created_at", "closed_at")), rules,
    )


GLOBAL = round1(" + ".join(f"{d} * {w}" for d, w in WEIGHTS))


def dimension_rows() -> str:
    return both(
        [
            f"SELECT CAST({i} AS INT) AS ordinal, '{d}' AS dimension, {w} AS weight,"
            f" {d} AS score, {grade(d)} AS grade FROM dims"
            for i, (d, w) in enumerate(WEIGHTS, start=1)
        ]
    )


def table_dimensions(name: str) -> str:
    ctes = dimension_ctes(
        name, types_of(name), "2024-02-01 00:00:00", 168, NON_NEGATIVE.get(name, []),
        DATES.get(name, []),
    )
    return f"WITH {ctes.strip()} {dimension_rows()}"


def column_rows(source: str, columns) -> str:
    measured = both(
        [
            f"SELECT '{c}' AS \"column\","
            f" {round1(f'(1 - {count_if(f"{c} IS NULL")} / count(*)) * 100')} AS completeness,"
            f" {round1(f'count(DISTINCT {c}) / count(*) * 100')} AS uniqueness FROM {source}"
            for c in columns
        ]
    )
    overall = round1("completeness * 0.6e0 + least(uniqueness * 1.5e0, 100e0) * 0.4e0")
    return f'SELECT "column", completeness, uniqueness, least(100e0, {overall}) AS overall FROM ({measured})'


# ------------------------------------------------------------------ dirty orders

RULES = [  # name, severity, condition, passes on null, column
    ("status is active", "high", "status = 'active'", False, "status"),
    ("age is set", "medium", "age >= 0 AND age <= 120", False, "age"),
    ("status is not inactive", "low", "status <> 'inactive'", True, "status"),
    ("gross above net", "medium", "price_ht < price_ttc", False, "price_ht"),
]


def rule_rows(null_passes: bool = False) -> str:
    return both(
        [
            f"SELECT '{name}' AS rule, '{severity}' AS severity,"
            f" {count_if(f'NOT coalesce({condition}, {str(on_null or null_passes).lower()})')} AS violations,"
            " count(*) AS checked FROM dirty"
            for name, severity, condition, on_null, _ in RULES
        ]
    )


NUMBER = "TRY_CAST({} AS DOUBLE)"


def coerced_rows() -> str:
    rules = [
        ("modified_at over 0", f"coalesce({NUMBER.format('modified_at')} > 0, false)"),
        ("phone over 500", f"coalesce({NUMBER.format('phone')} > 500, false)"),
        ("phone is not 7", f"coalesce({NUMBER.format('phone')} <> 7, true)"),
    ]
    return both(
        [f"SELECT '{n}' AS rule, {count_if(f'NOT {r}')} AS violations FROM dirty" for n, r in rules]
    )


def check_rows(violation, columns, filled: bool = True, source: str = "dirty") -> str:
    return both(
        [
            f"SELECT '{c}' AS \"column\", {count_if(f'{c} IS NOT NULL AND {violation(c)}')} AS violations,"
            f" {f'count({c})' if filled else 'count(*)'} AS checked FROM {source}"
            for c in columns
        ]
    )


def is_fake(c: str) -> str:
    return f"{folded(c)} IN {TOKENS}"


DIRTY_TEXTS = [c for c, t in DIRTY_TYPES.items() if t == "s"]
DIRTY_NUMBERS = [c for c, t in DIRTY_TYPES.items() if t == "n"]


def issue_rows() -> str:
    """One row per possible issue with its severity, null where there is none."""
    rows = []

    def add(dimension, column, check, violations, checked, severity):
        rows.append(
            f"SELECT '{dimension}' AS dimension, severity, '{column}' AS \"column\", '{check}' AS \"check\","
            f" violations, checked FROM (SELECT *, {severity} AS severity"
            f" FROM (SELECT CAST({violations} AS BIGINT) AS violations, CAST({checked} AS BIGINT) AS checked FROM dirty))"
        )

    pct = "violations / checked * 100"
    any_ = "CASE WHEN violations > 0 THEN '{}' END"
    for c in DIRTY_TYPES:
        add("completeness", c, "null", count_if(f"{c} IS NULL"), "count(*)",
            f"CASE WHEN {pct} > 50 THEN 'high' WHEN {pct} > 20 THEN 'medium' END")
    add("uniqueness", "all", "duplicate",
        "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))", "count(*)",
        f"CASE WHEN {pct} > 20 THEN 'high' WHEN {pct} > 5 THEN 'medium' END")
    for c in ("created_at", "closed_at", "modified_at"):
        lag = (
            "(epoch_us(TIMESTAMP '2002-01-02 00:00:00') - epoch_us((SELECT"
            f" max(TRY_CAST({c} AS TIMESTAMP)) FROM dirty))) / 3.6e9"
        )
        add("freshness", c, "stale", "max(1)", "max(1)",
            f"CASE WHEN {lag} > 2160 THEN 'high' WHEN {lag} > 720 THEN 'medium' END")
    for c in ("age", "price_ht", "price_ttc"):
        add("consistency", c, "negative", count_if(f"{c} < 0"), "count(*)", any_.format("high"))
    for _, severity, condition, on_null, column in RULES:
        failing = count_if(f"NOT coalesce({condition}, {str(on_null).lower()})")
        add("consistency", column, "rule", failing, "count(*)", any_.format(severity))
    for c in DIRTY_NUMBERS:
        q1, q3 = (f"(SELECT quantile_cont(CAST({c} AS DOUBLE), {q}) FROM dirty)" for q in (0.25, 0.75))
        beyond = f"{c} < {q1} - 3 * ({q3} - {q1}) OR {c} > {q3} + 3 * ({q3} - {q1})"
        add("distribution", c, "outlier", count_if(beyond), f"count({c})",
            f"CASE WHEN {pct} > 5 THEN 'medium' END")
    add("validity", "email", "email", count_if(f"NOT regexp_matches(email, {EMAIL})"), "count(email)",
        f"CASE WHEN {pct} > 20 THEN 'high' WHEN violations > 0 THEN 'medium' END")
    add("validity", "phone", "phone", count_if(f"NOT regexp_matches(phone, {PHONE})"), "count(phone)",
        any_.format("medium"))
    for a, b in (("price_ht", "price_ttc"), ("created_at", "closed_at")):
        add("correlation", f"{a}/{b}", "pair", count_if(f"{a} >= {b}"),
            count_if(f"{a} IS NOT NULL AND {b} IS NOT NULL"), any_.format("high"))
    for c in DIRTY_TEXTS:
        add("standardization", c, "padding", count_if(f"{c} IS NOT NULL AND {padded(c)}"), f"count({c})",
            any_.format("low"))
        add("standardization", c, "fake_null", count_if(is_fake(c)), f"count({c})", any_.format("medium"))
        add("standardization", c, "case_variant",
            f"count(DISTINCT {c}) - count(DISTINCT {folded(c)})", f"count(DISTINCT {c})",
            "CASE WHEN checked BETWEEN 2 AND 50 AND violations > 0 THEN 'medium' END")
    return f"SELECT * FROM ({both(rows)}) WHERE severity IS NOT NULL"


def summary_row() -> str:
    rules = tuple(
        f"coalesce({condition}, {str(on_null).lower()})" for _, _, condition, on_null, _ in RULES
    )
    return f"""WITH {dirty_ctes(rules)}, found AS ({issue_rows()})
SELECT 'dirty_orders' AS table_name, (SELECT count(*) FROM dirty) AS row_count, CAST({len(DIRTY_TYPES)} AS INT) AS col_count,
 CAST((SELECT count(*) FROM found) AS INT) AS issue_count,
 CAST((SELECT count(*) FROM found WHERE severity = 'high') AS INT) AS high_count,
 CAST((SELECT count(*) FROM found WHERE severity = 'medium') AS INT) AS medium_count,
 CAST({len(RULES)} AS INT) AS rule_count, {GLOBAL} AS score, {grade(GLOBAL)} AS grade FROM dims"""


def suggestion_rows() -> str:
    """Conditional suggestions of the dirty table, with their conditions."""
    numbers = {"price_ht": "price_ht", "price_ttc": "price_ttc"}
    rows = ["SELECT 'email: valid e-mail' AS name, 'contains(`email`, ''@'')' AS condition, 'email' AS \"column\", 'high' AS severity"]
    for c in numbers:
        rows.append(f"SELECT '{c}: not negative', '`{c}` >= 0', '{c}', 'high'")
        cap = f"(SELECT CAST(trunc(max({c}) * 3) AS BIGINT) FROM dirty)"
        rows.append(
            f"SELECT '{c}: no extreme value (<= ' || format('{{:,}}', {cap}) || ')', '`{c}` <= ' || {cap}, '{c}', 'medium'"
            f" WHERE (SELECT max({c}) FROM dirty) < 100000"
        )
    rows.append("SELECT 'age: age from 0 to 120', '`age` >= 0 AND `age` <= 120', 'age', 'high'")
    rows.append("SELECT 'id: no negative value', '`id` >= 0', 'id', 'medium'"
                " WHERE (SELECT avg(CAST(id < 0 AS INT)) FROM dirty) > 0.05")  # fmt: skip
    for c in DIRTY_TEXTS:
        rows.append(
            f"SELECT '{c}: allowed value', '`{c}` IN (''' || (SELECT string_agg(v, ''', ''' ORDER BY v) FROM"
            f" (SELECT DISTINCT {c} AS v FROM dirty WHERE {c} IS NOT NULL)) || ''')', '{c}', 'medium'"
            f" WHERE (SELECT count(DISTINCT {c}) BETWEEN 2 AND 6 AND count({c}) >= 20 FROM dirty)"
        )
        rows.append(
            f"SELECT '{c}: lower case', '`{c}` = lower(`{c}`)', '{c}', 'low'"
            f" WHERE (SELECT count(DISTINCT lower({c})) < count(DISTINCT {c}) FROM dirty)"
        )
    for a, b in (("price_ht", "price_ttc"), ("created_at", "closed_at")):
        rows.append(f"SELECT '{a} < {b} (order)', '`{a}` <= `{b}`', '{a}', 'high'")
    return both(rows)


def all_oracles() -> dict[str, str]:
    found = _dirty_oracles() | _table_oracles()
    for name in TYPES:
        found[f"score_{name}"] = table_dimensions(name)
        found[f"columns_{name}"] = column_rows(name, types_of(name))
    return found


def _dirty_oracles() -> dict[str, str]:
    nulls = both(
        [
            f"SELECT '{c}' AS \"column\", {count_if(f'{c} IS NULL')} AS null_count, count(*) AS row_count,"
            f" {round1(f'(1 - {count_if(f"{c} IS NULL")} / count(*)) * 100')} AS completeness FROM dirty"
            for c in DIRTY_TYPES
        ]
    )

    def cells(name, source, columns):
        missing = " + ".join(count_if(f"{c} IS NULL") for c in columns)
        return (
            f"SELECT '{name}' AS table_name, {round1(f'(1 - ({missing}) / (count(*) * {len(columns)})) * 100')}"
            f" AS score, {missing} AS nulls, count(*) * {len(columns)} AS cells FROM {source}"
        )

    def validity(c, pattern):
        bad = count_if(f"{c} IS NOT NULL AND NOT regexp_matches({c}, {pattern})")
        return (
            f"SELECT '{c}' AS \"column\", {bad} AS violations, count({c}) AS checked,"
            f" {round1(f'greatest(0e0, (1 - {bad} / count({c})) * 100)')} AS score FROM dirty"
        )

    outliers = both(
        [
            f"SELECT '{c}' AS \"column\", {count_if(f'{c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)')} AS outliers,"
            f" count({c}) AS checked, {count_if(f'{c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)')} / count({c}) AS ratio"
            f" FROM dirty, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM dirty)"
            for c in DIRTY_NUMBERS
        ]
    )
    pairs = both(
        [
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, {count_if(f'{a} >= {b}')} AS violations,"
            f" {count_if(f'{a} IS NOT NULL AND {b} IS NOT NULL')} AS checked FROM dirty"
            for a, b in (("price_ht", "price_ttc"), ("created_at", "closed_at"))
        ]
    )
    variants = both(
        [
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS spellings, count(DISTINCT {folded(c)}) AS distinct_values FROM dirty"
            for c in DIRTY_TEXTS
        ]
    )
    shares = both(
        [
            f"SELECT '{c}' AS \"column\", {count_if(f"regexp_matches({c}, '[-/:]') AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL")} / count({c}) AS date_ratio,"
            f" {count_if(f'regexp_matches({c}, {EMAIL})')} / count({c}) AS email_ratio FROM dirty"
            for c in DIRTY_TEXTS
        ]
    )
    copies = "SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS d FROM dirty"
    wide = (
        "wide AS (SELECT *, CASE WHEN id % 2 = 0 THEN NULL ELSE status END AS half_status,"
        " CASE WHEN id % 4 = 0 THEN country END AS quarter_country, id % 7 AS week_slot,"
        " id % 1000 AS bucket FROM dirty)"
    )
    wide_columns = [*DIRTY_TYPES, "half_status", "quarter_country", "week_slot", "bucket"]
    suggested = both(
        [
            f"SELECT '{name}' AS rule, '{severity}' AS severity, {count_if(f'NOT coalesce({condition}, false)')} AS violations, count(*) AS checked FROM dirty"
            for name, severity, condition in (
                ("email: valid e-mail", "high", "contains(email, '@')"),
                ("price_ht: not negative", "high", "price_ht >= 0"),
                ("price_ttc: not negative", "high", "price_ttc >= 0"),
                ("age: age from 0 to 120", "high", "age >= 0 AND age <= 120"),
                ("status: allowed value", "medium", "status IN (SELECT DISTINCT status FROM dirty WHERE status IS NOT NULL)"),
                ("status: lower case", "low", "status = lower(status)"),
                ("country: allowed value", "medium", "country IN (SELECT DISTINCT country FROM dirty)"),
                ("country: lower case", "low", "country = lower(country)"),
                ("note: allowed value", "medium", "note IN (SELECT DISTINCT note FROM dirty WHERE note IS NOT NULL)"),
                ("price_ht < price_ttc (order)", "high", "price_ht <= price_ttc"),
                ("created_at < closed_at (order)", "high", "created_at <= closed_at"),
            )
        ]
    )
    return {
        "null_profile": dirty(nulls),
        "completeness_score": dirty(
            both([cells("dirty_orders", "dirty", DIRTY_TYPES), cells("lineitem", "lineitem", types_of("lineitem"))])
        ),
        "duplicate_rows": dirty(
            f"SELECT n AS row_count, d AS distinct_rows, n - d AS dup_rows,"
            f" {round1('greatest(0e0, 100 - (n - d) / n * 100 * 2)')} AS score FROM ({copies})"
        ),
        "union_duplicates": dirty(
            f"SELECT 'kept' AS kind, d AS row_count FROM ({copies}) UNION ALL SELECT 'added', n - d FROM ({copies})"
        ),
        "freshness_string_dates": dirty(
            "SELECT max(TRY_CAST(modified_at AS TIMESTAMP)) AS max_ts,"
            " count(modified_at) - count(TRY_CAST(modified_at AS TIMESTAMP)) AS unparsable FROM dirty"
        ),
        "negative_values": dirty(
            check_rows(lambda c: f"{c} < 0", ["age", "price_ht", "price_ttc"], filled=False)
        ),
        "rule_violations": dirty(rule_rows()),
        "rule_violations_null_ignored": dirty(rule_rows(null_passes=True)),
        "rule_coerced_compare": dirty(coerced_rows()),
        "rule_not_applicable": dirty(
            "SELECT 'rule_not_applicable' AS \"check\", 'low' AS severity, 'missing_column' AS \"column\""
            " UNION ALL SELECT 'rule_not_applicable', 'low', 'age'"
            " UNION ALL SELECT 'rule', 'high', 'status' FROM dirty"
            " HAVING count(*) FILTER (WHERE NOT coalesce(status = 'active', false)) > 0"
        ),
        "outliers": dirty(outliers),
        "email_validity": dirty(validity("email", EMAIL)),
        "phone_validity": dirty(validity("phone", PHONE)),
        "pair_order": dirty(pairs),
        "padded_strings": dirty(check_rows(padded, DIRTY_TEXTS)),
        "fake_nulls": dirty(check_rows(is_fake, DIRTY_TEXTS)),
        "case_variants": dirty(variants),
        "standardization_score": f"WITH {dirty_ctes()} SELECT 'standardization' AS dimension, standardization AS score FROM dims",
        "dimension_scores": f"WITH {dirty_ctes()} {dimension_rows()}",
        "dimension_scores_with_rule": f"WITH {dirty_ctes(("status = 'active'",))} {dimension_rows()}",
        "global_score": f"WITH {dirty_ctes()} SELECT {GLOBAL} AS score, {grade(GLOBAL)} AS grade,"
        f" CASE WHEN {GLOBAL} >= 80 THEN 'ok' WHEN {GLOBAL} >= 70 THEN 'warn' ELSE 'error' END AS alert FROM dims",
        "issues": dirty(issue_rows()),
        "issue_severity_counts": dirty(f"SELECT severity, count(*) AS n FROM ({issue_rows()}) GROUP BY severity"),
        "run_summary": summary_row(),
        "column_scores": dirty(column_rows("dirty", DIRTY_TYPES)),
        "worst_columns": f"WITH {DIRTY}, {wide} SELECT * FROM ({column_rows('wide', wide_columns)})"
        ' ORDER BY overall, "column" LIMIT 14',
        "roles_by_content": dirty(shares),
        "detected_roles": "SELECT * FROM (VALUES ('email', 'email'), ('phone', 'phone'), ('created_at', 'date'),"
        " ('closed_at', 'date'), ('modified_at', 'date'), ('price_ht/price_ttc', 'pair'),"
        " ('created_at/closed_at', 'pair')) t(\"column\", role)",
        "suggest_rules": dirty(suggestion_rows()),
        "suggest_rules_new": dirty(
            f"SELECT name, \"column\", severity FROM ({suggestion_rows()}) WHERE name <> 'email: valid e-mail'"
        ),
        "suggested_rule_violations": dirty(suggested),
    }


def _table_oracles() -> dict[str, str]:
    lineitem = types_of("lineitem")
    quartiles = both(
        [
            f"SELECT '{c}' AS \"column\", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr FROM"
            f" (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM lineitem)"
            for c, t in lineitem.items()
            if t == "n"
        ]
    )
    distinct = both(
        [f"SELECT '{c}' AS key, count(DISTINCT {c}) AS distinct_count FROM lineitem" for c in lineitem]
        + ["SELECT '*', count(*) FROM (SELECT DISTINCT * FROM lineitem)"]
    )
    profile = both(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS \"min\","
            f" CAST(max({c}) AS DOUBLE) AS \"max\", {count_if(f'{c} < 0')} / count({c}) AS neg_share FROM {t}"
            for t in ("lineitem", "part", "customer")
            for c, kind in types_of(t).items()
            if kind == "n"
        ]
    )
    texts = both(
        [
            f"SELECT '{c}' AS \"column\", '{check}' AS \"check\", {count_if(f'{c} IS NOT NULL AND {flaw(c)}')} AS violations,"
            f" count({c}) AS checked FROM documents"
            for check, flaw in (("padding", padded), ("fake_null", is_fake))
            for c in ("text", "lang", "source")
        ]
    )
    allowed = both(
        [
            f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS INT) AS n_values,"
            f" (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM orders WHERE {c} IS NOT NULL)) AS allowed_values"
            f" FROM orders HAVING count(DISTINCT {c}) BETWEEN 2 AND 6 AND count({c}) >= 20"
            for c in ("o_orderstatus", "o_orderpriority")
        ]
    )
    lag = "(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts))) / 3.6e9"
    return {
        "freshness_events": f"SELECT 'ts' AS \"column\", max(ts) AS max_ts, {lag} AS lag_hours,"
        f" least(100e0, greatest(0e0, 100 - {lag} / 168e0 * 100)) AS score FROM events",
        "quartiles": quartiles,
        "distinct_per_column": distinct,
        "numeric_profile": profile,
        "padded_texts": texts,
        "allowed_values": allowed,
        "csv_roundtrip": "SELECT * FROM customer",
        "table_roundtrip": "SELECT * FROM supplier",
        "table_sizes": both(
            [
                f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({len(types_of(t))} AS INT) AS col_count FROM {t}"
                for t in TYPES
            ]
        ),
        "document_delimiters": "SELECT CAST(sum(length(text) - length(replace(text, ';', ''))) AS BIGINT) AS semicolons,"
        " CAST(sum(length(text) - length(replace(text, ',', ''))) AS BIGINT) AS commas FROM documents",
    }
