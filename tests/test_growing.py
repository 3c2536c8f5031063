"""Merged states, histories, streams, samples, packed keys and quartile scans."""

import math
import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablevet.functions.values import of_times, with_written_times
from tablevet.operators import quartiles as Q
from tablevet.operators.distinct import ROW, distinct_counts, duplicate_rows_approx, typed_columns
from tablevet.operators.fused import Check
from tablevet.operators.roles import ColumnRoles, Pair, detect_roles, role_shares
from tablevet.operators.sampling import sample_rows
from tablevet.plans import views
from tablevet.plans.history import volumetry
from tablevet.plans.increments import Profile, append_part, measure_part, merged, score_states
from tablevet.plans.score import score
from tablevet.streaming.windows import keep_windows, latest_windows, windowed_counts

AS_OF = datetime(2024, 6, 1)

# ---------------------------------------------------------------- written dates


def latest(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    timed, at = with_written_times(df, ["c"])
    kind = df.schema["c"].dataType
    row = timed.selectExpr(f"{of_times('max({0})', '`c`', kind, at['c'])} AS m", f"{of_times('count({0})', '`c`', kind, at['c'])} AS n").first()
    return row.m, row.n


def test_a_stray_date_costs_one_cell(spark):
    days = [date(2023, 1, 1) + timedelta(i) for i in range(336)]
    american = [f"{d:%m/%d/%Y}" for d in days]
    assert latest(spark, american + ["25/12/2023"]) == (datetime(2023, 12, 2), 336)
    european = [f"{d:%d.%m.%Y}" for d in days]
    assert latest(spark, european + ["12.25.2023"]) == (datetime(2023, 12, 2), 336)
    assert latest(spark, ["13/01/2024", "01/13/2024", "02/03/2024"]) == (datetime(2024, 2, 3), 2)  # a tie: month first
    assert latest(spark, ["2024-05-06", "7 May 2024", None, "x", "13/5/2024 1:02 pm"]) == (datetime(2024, 5, 13, 13, 2), 3)


def test_stray_dates_keep_the_role_and_are_parsed_once(spark):
    rows = [(f"{date(2023, 1, 1) + timedelta(i):%m/%d/%Y}",) for i in range(300)] + [("31/12/2023",)]
    df = spark.createDataFrame(rows, "when_ string")
    assert detect_roles(df).dates == ["when_"]
    row = role_shares(df).first()
    assert row.date_ratio == pytest.approx(300 / 301)
    plan = role_shares(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(when_") == 1


# ---------------------------------------------------------------- packed keys


def test_packed_keys_equal_brute_force(spark):
    rng = random.Random(8)
    longs = [rng.randrange(-200, 200) for _ in range(300)] + [2**63 - 1, -(2**63), -(2**63) + 1, 0, -1, 63, 64, -64, -65, None]
    doubles = [rng.choice([0.1, 0.25, 1.1, 1.005, 0.1 + 0.2, -0.0, 0.0, 1e15, 1e15 + 1, -1e300, 2.675, math.inf]) for _ in longs]
    doubles[:40] = [rng.randrange(-10**6, 10**6) / 100 for _ in range(40)]
    doubles[40:80] = [rng.random() for _ in range(40)]
    second = datetime(1969, 12, 31)
    times = [second + timedelta(seconds=rng.randrange(-90, 90) * rng.choice([1, 86400]), microseconds=rng.choice([0, 0, 1])) for _ in longs]
    days = [date(1960, 1, 1) + timedelta(rng.randrange(9000)) for _ in longs]
    rows = list(zip(longs, doubles, times, times, days, [None if x is None else x % 7 for x in longs], map(str, doubles)))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "l bigint, d double, t timestamp, n timestamp_ntz, y date, s smallint, x string").repartition(5)
    found = distinct_counts(df, typed_columns(df), whole_rows=True)
    for i, c in enumerate(df.columns):
        assert found[c] == len({r[i] for r in rows if r[i] is not None}), c
    assert found[ROW] == len(set(rows))


def test_dense_columns_shuffle_fewer_records(spark):
    """Neighbours share a record; a column too sparse for that needs one record a value, as before."""
    from tablevet.functions.values import packed
    from pyspark.sql import types as T

    high, low, _ = packed("x", T.LongType())
    dense, sparse = (spark.range(6400).selectExpr(f"id * {step} AS x").selectExpr(f"{high} AS h", f"{low} AS l").distinct().count() for step in (1, 1000))
    assert (dense, sparse) == (100, 6400)


# ---------------------------------------------------------------- quartiles


def test_n_rounds_take_n_and_one_scans(spark, monkeypatch):
    scans = Counter()
    scan, guides = Q._scan, Q.guide_scan
    monkeypatch.setattr(Q, "_scan", lambda *a, **k: scans.update(rounds=1) or scan(*a, **k))
    monkeypatch.setattr(Q, "guide_scan", lambda *a: scans.update(sketch=1) or guides(*a))
    monkeypatch.setattr(Q, "_SAMPLE_SIZE", 2_000)
    n = 200_000
    df = spark.range(n).selectExpr("double(hash(id)) AS a", "double(pmod(hash(id, 3), 1000)) AS b", "double(id % 3) AS c")
    rows = df.toPandas()
    wanted = {c: tuple(rows[c].quantile([0.25, 0.75])) for c in df.columns}
    assert Q.quartiles(df, {c: (c, n) for c in df.columns}, pick_limit=20_000) == wanted
    assert scans == {"sketch": 1, "rounds": 1}  # the sketch's brackets are read whole
    scans.clear()
    assert Q.quartiles(df, {c: (c, n) for c in df.columns}, pick_limit=500) == wanted
    assert scans["sketch"] == 1 and scans["rounds"] <= 3  # samples are drawn while counting
    scans.clear()
    assert Q.quartiles(df, {"a": ("a", n)}, pick_limit=n) == {"a": wanted["a"]}
    assert scans == {"rounds": 1}


# ---------------------------------------------------------------- sketches of rows


def test_sketched_rows_shuffle_no_rows(spark):
    df = spark.range(30_000).selectExpr("id % 20000 AS a", "IF(id % 3 = 0, NULL, 'x') AS b", "id % 20000 / 7 AS c")
    exact = df.distinct().count()
    found = duplicate_rows_approx(df)
    row = found.first()
    assert row.row_count == 30_000 and abs(row.distinct_rows - exact) <= 0.02 * exact
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("Exchange") == 1
    assert tuple(duplicate_rows_approx(df.limit(0)).first()) == (0, 0, 0, 100.0)


# ---------------------------------------------------------------- merged states


def parts_frame(spark, n=600):
    return spark.range(n).selectExpr(
        "id AS key", "IF(id % 10 = 0, NULL, id % 97) AS age", "IF(id % 100 = 0, 1e6, id % 50 + 0.5e0) AS price",
        "IF(id % 4 = 0, 'bad', concat('u', id, '@x.org')) AS email", "IF(id % 3 = 0, 'Paris', IF(id % 3 = 1, 'PARIS', ' Rome')) AS city",
        "date_format(date_add(DATE'2023-01-01', CAST(id % 350 AS INT)), IF(id % 50 = 0, 'dd/MM/yyyy', 'MM/dd/yyyy')) AS start_date",
        "date_format(date_add(DATE'2023-02-01', CAST(id % 300 AS INT)), 'dd-MM-yyyy') AS end_date",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS seen_at",
    )


def test_merged_states_give_the_score_of_the_whole(spark, tmp_path):
    df = parts_frame(spark)
    profile = Profile(detect_roles(df), (), "violation")
    assert [p.name for p in profile.roles.pairs] == ["start_date before end_date"]
    path = str(tmp_path / "states")
    for i in (2, 0, 1, 0):  # in any order, one of them again
        append_part(path, df.filter(F.col("key") % 3 == i), f"p/{i}", profile)
    append_part(path, df.limit(0), "empty", profile)
    states = spark.read.parquet(path)
    whole = score(df, "t", None, 720, AS_OF)
    for kept in (states, merged(states)):
        found = score_states(kept, df.schema, profile, "t", 720, AS_OF)
        assert found.row_count == whole.row_count
        for dimension, value in whole.scores.items():
            assert found.scores[dimension] == pytest.approx(value, abs=2 if dimension in ("uniqueness", "distribution") else 0), dimension
        assert found.freshness == whole.freshness
        key = lambda r: sorted((i.dimension, i.column, i.check, i.violations, i.checked) for i in r.issues if i.dimension != "uniqueness")
        assert key(found) == key(whole)


def test_state_of_a_part_is_small(spark):
    df = parts_frame(spark, 5_000)
    state = measure_part(df, "p", Profile(ColumnRoles(dates=["seen_at"], pairs=[Pair("age", "price")])))
    assert state.columns == ["part", "measure", "kind", "number", "value", "time", "sketch"]
    assert state.count() < 20 * len(df.columns)
    assert {r.kind for r in state.select("kind").distinct().collect()} == {"sum", "low", "high", "latest", "distinct", "quantiles"}


# ---------------------------------------------------------------- history


def test_volumetry_from_history(spark):
    rows = [("t", i, n) for i, n in enumerate([100, 100, 100, 50, 100, 400, 0])] + [("u", 1, 5), ("z", 1, 0), ("z", 2, 0), ("z", 3, 0), ("z", 4, 0), ("z", 5, 9)]
    found = {(r.table_name, r.run): (r.expected_rows, r.score) for r in volumetry(spark.createDataFrame(rows, "table_name string, run int, row_count bigint")).collect()}
    assert [found["t", i][1] for i in range(7)] == [80, 80, 80, 50, 85.7, 0, 0]
    assert found["u", 1] == (None, 80) and found["z", 4] == (0, 100) and found["z", 5] == (0, 0)
    few = spark.range(10)
    assert score(few, as_of=AS_OF).scores["volumetry"] == 80
    assert score(few, as_of=AS_OF, earlier_row_counts=[10, 12]).scores["volumetry"] == 80
    assert score(few, as_of=AS_OF, earlier_row_counts=[9, 10, 11]).scores["volumetry"] == 100
    result = score(few, as_of=AS_OF, earlier_row_counts=[30, 30, 30])
    assert result.scores["volumetry"] == 33.3
    assert [(r.severity, r.check) for r in views.issues(result).collect() if r.dimension == "volumetry"] == [("medium", "volume")]


# ---------------------------------------------------------------- streams


def test_late_rows_are_counted_until_the_watermark(spark, tmp_path):
    def put(name, rows):
        df = spark.createDataFrame([(t, v) for t, v in rows], "ts timestamp_ntz, v int").coalesce(1)
        df.write.parquet(str(tmp_path / "in" / name))

    day = datetime(2024, 3, 1)
    checks = [Check("consistency", "negative", "v", "v < 10", "v IS NOT NULL")]
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    files = {
        "a": [(day + timedelta(hours=h), h) for h in range(0, 30, 6)],
        "b": [(day + timedelta(days=4), None)],
        "c": [(day + timedelta(days=3), 1), (day, 99), (None, 5)],  # the second is too late
    }
    for name, rows in files.items():  # one run for each file that comes
        put(name, rows)
        stream = spark.readStream.schema("ts timestamp_ntz, v int").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        keep_windows(windowed_counts(stream, "ts", checks, "1 day", "2 days"), out, marks).awaitTermination()
    found = {r.window_start: (r.n_rows, r.v_nulls, r.check_0_violations, r.check_0_checked) for r in latest_windows(spark, out).collect()}
    assert found == {day: (4, 0, 2, 4), day + timedelta(1): (1, 0, 0, 1), day + timedelta(4): (1, 1, 0, 0), day + timedelta(3): (1, 0, 1, 1)}


# ---------------------------------------------------------------- samples


def test_samples_do_not_depend_on_order(spark):
    df = spark.range(2_000).selectExpr("id", "IF(id % 5 = 0, NULL, id % 11) AS b", "array(id, NULL) AS c", "'x' AS __order_9")
    one = sorted(map(str, sample_rows(df, 100).collect()))
    two = sorted(map(str, sample_rows(df.repartition(9, "b").orderBy("b"), 100).collect()))
    assert one == two and len(one) == 100
    by = [sorted(map(str, sample_rows(d, 50, by=["b"]).collect())) for d in (df, df.repartition(3))]
    assert by[0] == by[1] and len(by[0]) == 50
    assert sample_rows(df, 0).count() == 0 and sample_rows(df, 5_000).count() == 2_000
    with pytest.raises(ValueError):
        sample_rows(df, 3, by=["nothing"])


# ---------------------------------------------------------------- footers


def test_footers_answer_without_a_data_page(spark, tmp_path):
    from tablevet.operators.checks import null_profile, numeric_profile
    from tablevet.sources.footers import footer_frame, parquet_null_profile, parquet_numeric_profile, pushed_aggregates

    path = str(tmp_path / "t")
    df = spark.range(1_000).selectExpr(
        "IF(id % 3 = 0, NULL, id) AS a", "CAST(-1 - id % 5 AS INT) AS b", "CAST(id % 7 - 3 AS SMALLINT) AS c", "CAST(NULL AS BIGINT) AS d",
        "IF(id % 4 = 0, double('NaN'), IF(id % 4 = 1, NULL, id - 10e0)) AS e", "IF(id % 9 = 0, NULL, 'x') AS f", "array(id) AS g",
        "CAST(id AS DECIMAL(9, 2)) AS h", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS i",
    )
    df.repartition(3).write.parquet(path)
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    from tablevet.functions.values import normalize

    plain = normalize(spark.read.parquet(path))
    assert rows(parquet_null_profile(spark, path)) == rows(null_profile(plain))
    assert rows(parquet_numeric_profile(spark, path)) == rows(numeric_profile(plain))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    with pushed_aggregates(spark):
        plan = footer_frame(spark, path, ["count(*)", "count(`a`)", "min(`b`)", "max(`b`)", "count(`f`)", "count(`i`)"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(a), MIN(b), MAX(b), COUNT(f), COUNT(i)]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    empty = str(tmp_path / "e")
    df.limit(0).write.parquet(empty)
    assert rows(parquet_null_profile(spark, empty)) == rows(null_profile(normalize(spark.read.parquet(empty))))
    assert rows(parquet_numeric_profile(spark, empty)) == rows(numeric_profile(normalize(spark.read.parquet(empty))))
