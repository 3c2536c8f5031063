"""Operators on small tables, against brute force where they search or sketch."""

import random

import numpy as np
import pytest

from tablevet import Rule, add_rule, build_rule, detect_roles, remove_rule, suggest_rules
from tablevet.functions.text import is_email, is_phone
from tablevet.operators import quartiles as Q
from tablevet.operators.distinct import ROW, distinct_counts, duplicate_rows, typed_columns
from tablevet.operators.fused import count_checks
from tablevet.operators.roles import assemble_roles
from tablevet.operators.rules import compile_rules
from tablevet.operators.suggest import suggestions_table, without_active
from tablevet.plans.views import rules_frame


# ---------------------------------------------------------------- quartiles


def numbers(spark, values):
    rows = [(None if v is None else float(v),) for v in values]
    return spark.createDataFrame(rows, "x double").repartition(4)


def check_quartiles(spark, values, **limits):
    df = numbers(spark, values)
    kept = [v for v in values if v is not None]
    found = Q.quartiles(df, {"x": ("x", len(kept))}, **limits)["x"]
    assert found == pytest.approx(tuple(np.quantile(kept, [0.25, 0.75])), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("pick_limit", [3, 40, 100_000])
@pytest.mark.parametrize(
    "shape", ["uniform", "heavy", "third_one_value", "two_values", "constant", "tails", "sorted"]
)
def test_quartiles_equal_brute_force(spark, monkeypatch, shape, pick_limit):
    monkeypatch.setattr(Q, "_SAMPLE_SIZE", 50)
    rng = random.Random(shape)
    n = 1_001
    values = {
        "uniform": [rng.random() for _ in range(n)],
        "heavy": [rng.choice([1, 2, 2, 3, 7]) for _ in range(n)],
        "third_one_value": [5.0 if i % 3 == 0 else rng.uniform(0, 9) for i in range(n)],
        "two_values": [float(i * 4 < n) for i in range(n)],
        "constant": [2.5] * n,
        "tails": [rng.paretovariate(0.3) * rng.choice([-1, 1]) for _ in range(n)],
        "sorted": list(range(n)),
    }[shape]
    check_quartiles(spark, values + [None] * 17, pick_limit=pick_limit)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10])
def test_quartiles_of_few_values(spark, n):
    check_quartiles(spark, [i * i for i in range(n)])


def test_quartiles_skip_columns_without_values(spark):
    assert Q.quartiles(numbers(spark, [None, None]), {"x": ("x", 0)}) == {}


def test_quartile_budget_splits_scans(spark, monkeypatch):
    monkeypatch.setattr(Q, "_BUFFER_BUDGET", 150)
    monkeypatch.setattr(Q, "_SAMPLE_SIZE", 100)
    df = spark.range(100).selectExpr("double(id) AS a", "double(-id) AS b", "double(id * 2) AS c")
    found = Q.quartiles(df, {c: (c, 100) for c in df.columns})
    assert found == {"a": (24.75, 74.25), "b": (-74.25, -24.75), "c": (49.5, 148.5)}


def test_approximate_quartiles_stay_within_one_percent_of_rank(spark, sf_dir):
    from tablevet.registry.variants import quartiles_approx

    found = quartiles_approx(spark, sf_dir).collect()
    assert len(found) == 8 and all(r.q1_close and r.q3_close for r in found)


def test_approximate_distinct_is_close(spark, sf_dir):
    from tablevet.registry.variants import approx_distinct

    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    exact = distinct_counts(df, typed_columns(df))
    found = approx_distinct(spark, sf_dir).collect()
    assert all(r.close for r in found)
    assert {r.column: r.exact for r in found} == exact


# ---------------------------------------------------------------- distinct


def test_distinct_counts_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [
        (rng.choice([None, 1, 2]), rng.choice([None, "a", "b", ""]), rng.choice([None, 0.0, -0.0, 1.5]))
        for _ in range(400)
    ]
    df = spark.createDataFrame(rows, "i int, s string, x double")
    found = distinct_counts(df, typed_columns(df), whole_rows=True)
    columns = list(zip(*rows))
    assert found == {
        **{c: len({v for v in columns[k] if v is not None}) for k, c in enumerate("isx")},
        ROW: len(set(rows)),
    }
    assert duplicate_rows(df).first().distinct_rows == found[ROW]


def test_distinct_counts_with_one_hot_value(spark):
    df = spark.range(30_000).selectExpr("IF(id % 3 = 0, 'hot', concat('v', id)) AS s")
    assert distinct_counts(df, typed_columns(df), whole_rows=True) == {"s": 20_001, ROW: 20_001}


def test_arrays_differ_by_null_place_and_length(spark):
    df = spark.sql(
        "SELECT explode(array(array(1, NULL), array(NULL, 1), array(1), array(1, NULL),"
        " CAST(array() AS array<int>))) AS a"
    )
    assert distinct_counts(df, typed_columns(df)) == {"a": 4}


def test_duplicates_of_tiny_tables(spark):
    assert duplicate_rows(spark.range(0)).first() == (0, 0, 0, 100.0)
    assert duplicate_rows(spark.range(1)).first() == (1, 1, 0, 100.0)


# ---------------------------------------------------------------- formats


@pytest.mark.parametrize(
    "cell, valid",
    [("a@b.co", True), ("a.b+c@d-e.fr", True), ("a@b", False), ("@b.co", False), ("a b@c.de", False),
     ("a@b.c", False), ("a@b.co\n", True), ("a@b.co\n\n", False), ("", False)],
)
def test_email_format(spark, cell, valid):
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.selectExpr(is_email("c")).first()[0] is valid


@pytest.mark.parametrize(
    "cell, valid",
    [("+33612345678", True), ("+(33)6123456", True), ("06 12.34-56", True), ("123456", False),
     ("1234567", True), ("0" * 21, True), ("0" * 22, False), ("(0)612345", False), ("abc", False),
     ("06\u00a012\u00a034\u00a056", True)],
)
def test_phone_format(spark, cell, valid):
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.selectExpr(is_phone("c")).first()[0] is valid


# ---------------------------------------------------------------- rules


def violations(df, *rules, **options):
    compiled = compile_rules(df, list(rules), **options)
    assert not compiled.rejected
    return [r.violations for r in count_checks(compiled.df, compiled.checks).collect()]


@pytest.fixture(scope="module")
def people(spark):
    return spark.sql(
        "SELECT * FROM VALUES (1, 'a', '10'), (2, 'b', 'x'), (NULL, NULL, NULL), (4, 'a', '3d')"
        " AS t(age, status, code)"
    )


def test_built_rules(people):
    assert violations(people, build_rule("r", "age", ">", "1")) == [2]
    assert violations(people, build_rule("r", "age", "!=", "1")) == [1]
    assert violations(people, build_rule("r", "status", "==", "a")) == [2]
    assert violations(people, build_rule("r", "status", "!=", "a")) == [2]


def test_text_against_number_is_coerced(people):
    assert violations(people, build_rule("r", "code", ">=", "5")) == [3]
    assert violations(people, build_rule("r", "code", "!=", "10")) == [1]


def test_null_policy(people):
    free = Rule("r", "age > 1")
    assert violations(people, free) == [2]
    assert violations(people, free, null_policy="ignore") == [1]
    with pytest.raises(ValueError):
        compile_rules(people, [free], null_policy="maybe")


def test_free_condition_with_bad_cast_does_not_fail_the_job(spark, people):
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    assert violations(people, Rule("r", "status > 5"), Rule("s", "age >= 1")) == [4, 1]
    assert spark.conf.get("spark.sql.ansi.enabled") == ansi


def test_condition_syntax(people):
    assert violations(people, Rule("r", "`age` >= 1 and `age` <= 2 -- range")) == [2]
    assert violations(people, {"name": "r", "condition": 'status == "a"', "tag": "x"}) == [2]


@pytest.mark.parametrize("condition", ["missing > 1", "age +", "age + 1", "sum(age) > 1", ""])
def test_rules_that_do_not_apply_are_reported(people, condition):
    compiled = compile_rules(people, [Rule("r", condition, "age"), Rule("ok", "age > 0")])
    assert [r.name for r, _ in compiled.rejected] == ["r"]
    assert [c.name for c in compiled.checks] == ["ok"]


def test_number_column_against_text_is_rejected(people):
    assert compile_rules(people, [build_rule("r", "age", ">", "old")]).rejected


def test_rule_list_operations():
    rules = add_rule([], build_rule("a", "x", ">", "0"))
    rules = add_rule(rules, build_rule("b", "it's", "==", "o'k"))
    assert rules[1].condition == "`it's` == 'o\\'k'"
    assert [r.name for r in remove_rule(rules, "a")] == ["b"]
    with pytest.raises(ValueError):
        build_rule("a", "x", "~", "0")
    with pytest.raises(ValueError):
        Rule("a", severity="fatal")


# ---------------------------------------------------------------- roles and suggestions


def test_first_matching_role_wins(spark):
    schema = spark.sql(
        "SELECT '' AS email_date, '' AS telephone, '' AS created_at, current_date() AS day, 1 AS mail_id"
    ).schema
    from tablevet import NameLists

    roles = assemble_roles(schema, {}, NameLists())
    assert roles.emails == ["email_date", "mail_id"]
    assert roles.phones == ["telephone"]
    assert roles.dates == ["created_at", "day"]


def test_detection_may_sample(spark):
    df = spark.range(100).selectExpr("concat('u', id, '@x.org') AS contact")
    assert detect_roles(df, sample_rows=10).emails == ["contact"]


@pytest.fixture(scope="module")
def shop(spark):
    return spark.range(100).selectExpr(
        "concat('u', id, '@x.org') AS email",
        "CAST(id AS double) AS price",
        "id * 2000 AS total_amount",
        "CAST(20 + id % 50 AS int) AS age",
        "id / 100 AS discount",
        "id % 90 AS pct_done",
        "id AS nb_items",
        "id - 10 AS balance",
        "id - 2 AS drift",
        "CASE id % 3 WHEN 0 THEN 'o''k' WHEN 1 THEN 'O''K' ELSE 'b\\\\c' END AS state",
        "CAST(NULL AS double) AS cost",
    )


def test_suggestions(shop):
    found = {s.name: s for s in suggest_rules(shop)}
    assert set(found) == {
        "email: valid e-mail", "price: not negative", "price: no extreme value (<= 297)",
        "total_amount: not negative", "age: age from 0 to 120", "discount: rate from 0 to 1",
        "pct_done: percentage from 0 to 100", "nb_items: not a negative quantity",
        "balance: no negative value", "state: allowed value", "state: lower case",
    }
    assert found["price: no extreme value (<= 297)"].condition == "`price` <= 297"
    assert found["state: allowed value"].condition == "`state` IN ('O\\'K', 'b\\\\c', 'o\\'k')"


def test_suggestions_are_valid_rules(shop):
    by_name = {s.name: s.as_rule() for s in suggest_rules(shop)}
    counts = dict(zip(by_name, violations(shop, *by_name.values())))
    assert counts["state: allowed value"] == 0
    assert counts["state: lower case"] == 33
    assert counts["balance: no negative value"] == 10
    assert counts["email: valid e-mail"] == 0


def test_active_rules_are_not_suggested_again(spark, shop):
    active = [Rule("price: not negative", "price >= 0")]
    kept = suggest_rules(shop, active=active)
    assert "price: not negative" not in {s.name for s in kept}
    joined = without_active(
        suggestions_table(shop, suggest_rules(shop)), rules_frame(spark, active)
    )
    assert {r.name for r in joined.collect()} == {s.name for s in kept}


# ---------------------------------------------------------------- empty tables


def test_profiles_of_an_empty_table(spark, sf_dir):
    from datetime import datetime

    from tablevet.operators import checks, suggest
    from tablevet.operators.freshness import freshness
    from tablevet.operators.roles import role_shares

    empty = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("false")
    assert {r.completeness for r in checks.null_profile(empty).collect()} == {0.0}
    assert checks.completeness(empty).first() == (0.0, 0, 0)
    assert checks.numeric_profile(empty).first().neg_share is None
    assert role_shares(empty).first().date_ratio is None
    assert freshness(empty, ["o_orderdate"], datetime(2024, 1, 1)).first().score is None
    assert suggest.allowed_values(empty).collect() == []
    assert suggest.suggest_rules(empty) == []
    counts = distinct_counts(empty, typed_columns(empty), whole_rows=True)
    assert set(counts.values()) == {0}


# ---------------------------------------------------------------- names, fences, settings


def test_one_key_cannot_stand_for_two_aggregates():
    from tablevet.operators.fused import FusedScan

    scan = FusedScan()
    scan.want("n", "count(1)")
    scan.want("n", "count(1)")
    with pytest.raises(ValueError, match="two different"):
        scan.want("n", "count(2)")


def test_a_column_named_like_the_whole_row(spark):
    df = spark.createDataFrame([(i // 10, i) for i in range(100)], "`*` int, x int")
    assert distinct_counts(df, typed_columns(df), whole_rows=True) == {"*": 10, "x": 100, ROW: 100}


def test_infinite_quartiles_leave_no_outliers(spark):
    from tablevet.operators.checks import outlier_checks

    df = spark.createDataFrame([(float("inf"),)] * 90 + [(float(i),) for i in range(10)], "x double")
    fences = {"x": (float("inf"), float("inf"))}
    row = count_checks(df, outlier_checks(df, fences)).first()
    assert (row.violations, row.checked) == (0, 100)


def test_two_scores_in_threads_leave_the_settings_as_found(spark):
    import threading

    from tablevet import score
    from tablevet.functions.settings import held_setting

    keys = ("spark.sql.ansi.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]
    df = spark.range(200).selectExpr("id", "CAST(id AS STRING) AS s")
    rules = [build_rule("r", "s", ">", "5")]
    threads = [threading.Thread(target=score, args=(df, "t", rules)) for _ in range(3)]
    with held_setting(spark, keys[1], "50"):
        with held_setting(spark, keys[1], "9"):
            assert spark.conf.get(keys[1]) == "50"
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    assert [spark.conf.get(k) for k in keys] == before


def test_written_dates(spark):
    from pyspark.sql import types as T

    from tablevet.functions.values import as_wall_time, of_times

    texts = {
        "25/12/2023": (None, "2023-12-25 00:00:00"), "01/05/24": ("2024-01-05 00:00:00", "2024-05-01 00:00:00"),
        "20240105": ("2024-01-05 00:00:00",) * 2, "5 Jan 2024": ("2024-01-05 00:00:00",) * 2,
        "Jan 5, 2024 3:04 pm": ("2024-01-05 15:04:00",) * 2, "2024.01.05": ("2024-01-05 00:00:00",) * 2,
        " " * 90 + "2024-01-05T10:00:00+02:00": ("2024-01-05 10:00:00",) * 2, "75001": (None, None),
        "12/31/1999 12:05 AM": ("1999-12-31 00:05:00", None), "1.2.30": (None, None), "May the 4th": (None, None),
        "31-12-70": (None, "1970-12-31 00:00:00"), "30/02/2024": (None, None), "": (None, None),
    }
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    found = df.selectExpr("c", *(f"{as_wall_time('c', T.StringType(), d)} AS t{d:d}" for d in (False, True))).collect()
    assert {r.c: (r.t0 and str(r.t0), r.t1 and str(r.t1)) for r in found} == texts
    for last, latest in (("01/12/2024", "2024-01-12"), ("13/01/2024", "2024-12-01")):
        df = spark.createDataFrame([("01/12/2024",), (last,)], "c string")
        assert str(df.selectExpr(of_times("max({0})", "c", T.StringType())).first()[0])[:10] == latest
