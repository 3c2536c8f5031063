"""Scores of whole tables: known values, edge cases, properties, plan size."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablevet import ColumnRoles, NameLists, Pair, Rule, build_rule, score
from tablevet.plans import views
from tablevet.registry.queries import dirty_orders, dirty_score

AS_OF = datetime(2024, 1, 2)


def issue_kinds(result):
    return {(i.check, i.column, i.severity) for i in result.issues}


def test_known_dimension_scores(spark, sf_dir):
    result = dirty_score(spark, sf_dir)
    assert result.scores == {
        "completeness": 96.6, "consistency": 97.6, "validity": 86.8, "uniqueness": 92.0,
        "freshness": 32.2, "distribution": 98.7, "correlation": 96.9, "volumetry": 80.0,
        "standardization": 97.4,
    }
    assert result.global_score == 87.4
    assert result.row_count == 15_625


def test_known_consistency_with_rule(spark, sf_dir):
    rule = build_rule("active", "status", "==", "active")
    assert dirty_score(spark, sf_dir, [rule]).scores["consistency"] == 80.8


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, price double, email string, seen_date string")
    result = score(df, as_of=AS_OF)
    assert result.row_count == 0
    assert result.scores["completeness"] == 0.0
    assert result.scores["uniqueness"] == 100.0
    assert result.scores["freshness"] == 75.0
    neutral = ("consistency", "validity", "distribution", "correlation", "standardization")
    assert {result.scores[d] for d in neutral} == {90.0}
    assert all((c.completeness, c.uniqueness, c.overall) == (0, 0, 0) for c in result.columns)


def test_single_row(spark):
    result = score(spark.sql("SELECT 1 AS id, 'a' AS label"), as_of=AS_OF)
    assert result.scores["uniqueness"] == 100.0
    assert result.scores["completeness"] == 100.0


def test_all_null_and_constant_columns(spark):
    df = spark.range(20).selectExpr(
        "id", "CAST(NULL AS double) AS gone", "CAST(NULL AS string) AS blank", "1.5e0 AS same"
    )
    result = score(df, as_of=AS_OF)
    assert ("null", "gone", "high") in issue_kinds(result)
    assert result.scores["distribution"] == 100.0  # only id has fences
    assert result.scores["standardization"] == 90.0
    by_name = {c.name: c for c in result.columns}
    assert by_name["gone"].uniqueness == 0.0
    assert by_name["gone"].completeness == 0.0


def test_nan_counts_as_null(spark):
    df = spark.sql("SELECT explode(array(1e0, double('NaN'), NULL, 2e0)) AS x")
    result = score(df, as_of=AS_OF)
    assert result.scores["completeness"] == 50.0
    assert result.columns[0].uniqueness == 50.0


@pytest.mark.parametrize("filled, expected", [(9, 90.0), (10, 50.0)])
def test_outliers_need_ten_values(spark, filled, expected):
    df = spark.range(filled).selectExpr("IF(id = 0, 1e9, 10e0 + id % 4) AS x")
    assert score(df, as_of=AS_OF).scores["distribution"] == expected


def test_future_date_is_fresh_and_reported(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-05 00:00:00' AS at, 1 AS n")
    result = score(df, as_of=AS_OF)
    assert result.scores["freshness"] == 100.0
    assert ("future", "at", "low") in issue_kinds(result)


def test_default_as_of_is_now(spark):
    df = spark.sql("SELECT localtimestamp() AS at")
    assert score(df).scores["freshness"] > 99


def test_stale_severity(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS a, DATE'2023-12-01' AS b")
    result = score(df, as_of=datetime(2024, 1, 2, 12), freshness_threshold_hours=24)
    assert {("stale", "a", "medium"), ("stale", "b", "high")} <= issue_kinds(result)


def test_all_white_space_counts_as_padding(spark):
    cells = ["a", "\tb", "c\n", "\u00a0d", "e\u3000", " f ", "g h", ""]
    df = spark.createDataFrame([(c,) for c in cells], "label string")
    result = score(df, as_of=AS_OF)
    padded = next(i for i in result.issues if i.check == "padding")
    assert padded.violations == sum(c != c.strip() for c in cells) == 5


def test_fake_nulls(spark):
    cells = ["N/A", " null ", "NONE", "--", "ok", "nano", "?", "\tUnknown\n", "x" * 100, " " * 90 + "nd"]
    df = spark.createDataFrame([(c,) for c in cells], "label string")
    result = score(df, as_of=AS_OF)
    assert next(i for i in result.issues if i.check == "fake_null").violations == 7


@pytest.mark.parametrize("spellings, found", [(50, True), (52, False)])
def test_case_variants_up_to_fifty_spellings(spark, spellings, found):
    df = spark.range(spellings * 3).selectExpr(
        f"concat(IF(id % {spellings} < {spellings // 2}, 'v', 'V'),"
        f" id % {spellings} % {spellings // 2}) AS label"
    )
    kinds = {i.check for i in score(df, as_of=AS_OF).issues}
    assert ("case_variant" in kinds) is found


def test_awkward_column_names(spark):
    df = spark.sql("SELECT id AS `a.b`, id AS `c d`, -id AS `unit``price`, 'x' AS `it's` FROM range(12)")
    result = score(df, rules=[build_rule("r", "a.b", ">", "5")], as_of=AS_OF)
    assert [c.name for c in result.columns] == ["a.b", "c d", "unit`price", "it's"]
    assert {("negative", "unit`price", "high"), ("rule", "a.b", "medium")} <= issue_kinds(result)
    assert views.column_scores(result).count() == 4


def test_nested_columns_and_small_numbers(spark):
    df = spark.sql(
        """SELECT map('a', id % 2, 'b', 1L) AS m, named_struct('x', id % 3, 'y', NULL) AS s,
                  array(id % 4, NULL) AS arr, array(array(id % 2)) AS deep,
                  parse_json(concat('{"k":', id % 5, '}')) AS v,
                  CAST(id % 2 AS tinyint) AS stock_b, CAST(-id AS smallint) AS stock_s,
                  CAST(id AS decimal(10,2)) AS price, id % 2 = 0 AS flag, X'00' AS raw
           FROM range(40)"""
    )
    result = score(df, as_of=AS_OF)
    unique = {c.name: round(c.uniqueness / 100 * 40) for c in result.columns}
    assert unique == {
        "m": 2, "s": 3, "arr": 4, "deep": 2, "v": 5, "stock_b": 2, "stock_s": 40, "price": 40,
        "flag": 2, "raw": 1,
    }
    assert ("negative", "stock_s", "high") in issue_kinds(result)


def test_rare_types(spark):
    df = spark.sql(
        """SELECT NULL AS nothing, INTERVAL '1' DAY * id AS span, make_interval(0, 0, 0, id) AS cal,
                  array(make_interval(0, 0, 0, id)) AS cals, TIME'10:00:00' AS clock,
                  CAST(id AS VARCHAR(5)) AS vc, named_struct() AS hollow,
                  TIMESTAMP'+12024-01-01 00:00:00' AS far_date
           FROM (SELECT CAST(id AS INT) AS id FROM range(30))"""
    )
    result = score(df, as_of=AS_OF)
    unique = {c.name: round(c.uniqueness / 100 * 30) for c in result.columns}
    assert unique == {
        "nothing": 0, "span": 30, "cal": 30, "cals": 30, "clock": 1, "vc": 30, "hollow": 1,
        "far_date": 1,
    }
    assert result.scores["freshness"] == 75.0  # no readable date


def test_map_order_does_not_make_rows_distinct(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert score(df, as_of=AS_OF).scores["uniqueness"] == 0.0


def test_null_positions_make_rows_distinct(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('a', NULL), (NULL, 'a'), ('a', NULL), ('', 'a') AS t(x, y)"
    )
    result = score(df, as_of=AS_OF)
    copies = next(i for i in result.issues if i.check == "duplicate")
    assert copies.violations == 1


def test_postcodes_are_not_dates(spark):
    df = spark.range(40).selectExpr("CAST(75001 + id AS string) AS postcode")
    assert score(df, as_of=AS_OF).roles.dates == []


def test_roles_by_content(spark):
    df = spark.range(10).selectExpr(
        "concat('u', id, '@x.org') AS contact",
        "IF(id < 8, '2024-01-0' || (id + 1), 'later') AS moment",
        "IF(id < 7, '2024-01-01', 'later') AS seldom",
        "'01/0' || (id % 9 + 1) || '/2024' AS us",
        "'2024/01/0' || (id % 9 + 1) AS slashed",
    )
    result = score(df, as_of=datetime(2024, 1, 10))
    assert result.roles.emails == ["contact"]
    assert result.roles.dates == ["moment", "us", "slashed"]
    assert result.freshness["us"][0] == datetime(2024, 1, 9)
    assert result.freshness["slashed"][0] == datetime(2024, 1, 9)
    assert result.scores["validity"] == 100.0


def test_pairs_by_position_and_all_operators(spark):
    df = spark.sql(
        "SELECT CAST(id AS double) AS a_ht, CAST(id + IF(id = 3, 0, 1) AS double) AS a_ttc,"
        " TIMESTAMP_NTZ'2024-01-01 00:00:00' AS start_date, '2023-01-01' AS end_date FROM range(10)"
    )
    result = score(df, as_of=AS_OF)
    assert [(p.col_a, p.col_b) for p in result.roles.pairs] == [
        ("a_ht", "a_ttc"),
        ("start_date", "end_date"),
    ]
    broken = {i.column: i.violations for i in result.issues if i.check == "pair"}
    assert broken == {"a_ht/a_ttc": 1, "start_date/end_date": 10}
    expected = {"<": 1, "<=": 0, ">": 10, ">=": 9, "==": 9, "!=": 1}
    for operator, violations in expected.items():
        roles = ColumnRoles(pairs=[Pair("a_ht", "a_ttc", operator, "p")])
        found = score(df, as_of=AS_OF, roles=roles)
        assert sum(i.violations for i in found.issues if i.check == "pair") == violations


def test_numeric_date_names_are_not_dates(spark):
    df = spark.range(3).selectExpr("id AS birth_year", "20240101 AS date_key")
    assert score(df, as_of=AS_OF).scores["freshness"] == 75.0


def test_name_lists_can_be_replaced(spark):
    df = spark.range(3).selectExpr("'x' AS hotel")
    assert score(df, as_of=AS_OF).roles.phones == ["hotel"]
    assert score(df, as_of=AS_OF, names=NameLists(phone=("phone",))).roles.phones == []


def test_copies_halve_uniqueness(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    once = score(df, as_of=AS_OF)
    twice = score(df.unionByName(df), as_of=AS_OF)
    copies = next(i for i in twice.issues if i.check == "duplicate")
    assert once.scores["uniqueness"] == 100.0
    assert copies.pct == 50.0
    assert twice.scores["uniqueness"] == 0.0


def test_order_and_partitions_do_not_matter(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    expected = dirty_score(spark, sf_dir)
    shuffled = score(
        df.repartition(13, F.rand(3)), "dirty_orders", None, 720, datetime(2002, 1, 2)
    )
    assert shuffled.scores == expected.scores
    assert shuffled.issues == expected.issues
    assert shuffled.columns == expected.columns


def test_scores_stay_in_range(spark):
    df = spark.range(30).selectExpr(
        "' N/A ' AS bad_text", "'x' AS email", "'y' AS phone", "-1 AS price", "'1990-01-01' AS date"
    )
    result = score(df, rules=[Rule("never", "price > 0", "price")], as_of=AS_OF)
    assert all(0 <= s <= 100 for s in result.scores.values())
    assert result.scores["standardization"] == 50.0
    assert result.scores["consistency"] == result.scores["validity"] == 0.0


def test_thresholds_are_checked(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        score(df, freshness_threshold_hours=0)
    with pytest.raises(ValueError):
        score(df, freshness_threshold_hours=721)
    with pytest.raises(ValueError):
        views.alert(F.lit(1), 101)


def test_alert_tests_eighty_first(spark):
    df = spark.sql("SELECT explode(array(85e0, 80e0, 79.9e0, 60e0, 10e0)) AS s")
    high = [r[0] for r in df.select(views.alert(F.col("s"), 90)).collect()]
    low = [r[0] for r in df.select(views.alert(F.col("s"), 60)).collect()]
    assert high == ["ok", "ok", "error", "error", "error"]
    assert low == ["ok", "ok", "warn", "warn", "error"]


def _jobs(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    action()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_columns(spark, tmp_path):
    def stored(width):
        path = str(tmp_path / f"w{width}")
        spark.range(500).selectExpr(
            *[f"CAST(id % {7 + i} AS double) AS n{i}" for i in range(width)],
            *[f"CAST(id % {5 + i} AS string) AS s{i}" for i in range(width)],
        ).write.parquet(path)
        return spark.read.parquet(path)

    narrow, wide = stored(2), stored(10)
    few = _jobs(spark, "narrow", lambda: score(narrow, as_of=AS_OF))
    many = _jobs(spark, "wide", lambda: score(wide, as_of=AS_OF))
    assert few == many


def test_wide_scans_are_cut_by_column(spark, monkeypatch):
    from tablevet.operators import fused

    df = spark.range(30).selectExpr(*[f"concat('v', id % {i + 2}) AS s{i}" for i in range(12)])
    whole = score(df, as_of=AS_OF)
    read = []
    select = type(df).selectExpr
    monkeypatch.setattr(fused, "MAX_AGGREGATES", 16)
    monkeypatch.setattr(type(df), "selectExpr", lambda self, *e: (read.append(e), select(self, *e))[1])
    cut = score(df, as_of=AS_OF)
    assert (cut.scores, cut.columns) == (whole.scores, whole.columns)
    scans = [" ".join(e) for e in read if len(e) == 16]
    assert scans
    assert all(sum(f"`s{i}`" in scan for i in range(12)) <= 4 for scan in scans)


def test_pure_python_workers_are_not_used(spark, sf_dir):
    from tablevet.operators.distinct import distinct_values, typed_columns

    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = distinct_values(df, typed_columns(df), whole_rows=True)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sketches_come_close(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    exact = dirty_score(spark, sf_dir)
    rough = score(df, "dirty_orders", None, 720, datetime(2002, 1, 2), exact=False)
    assert rough.scores["uniqueness"] == pytest.approx(exact.scores["uniqueness"], abs=2)  # rows are sketched, error 0.4 %
    for dimension, value in exact.scores.items():
        assert abs(rough.scores[dimension] - value) <= 2
    for a, b in zip(exact.columns, rough.columns):
        assert a.completeness == b.completeness
        assert abs(a.uniqueness - b.uniqueness) <= 10
    assert json.dumps(rough.scores)


def test_a_staged_source_is_read_once(spark, tmp_path):
    """The file is read by one job when it is staged, by every scan when it is not."""
    path = str(tmp_path / "t.csv")
    spark.range(500).selectExpr("id", "CAST(id % 7 AS STRING) AS s", "id * 0.5 AS x").write.csv(path, header=True)
    df = spark.read.schema("id bigint, s string, x double").csv(path, header=True)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = df.mapInArrow(count, df.schema)
    plain = score(counted, as_of=AS_OF)
    assert seen.value > 500
    before = seen.value
    assert score(counted, as_of=AS_OF, stage=True).scores == plain.scores
    assert seen.value == before + 500
