"""Sources and sinks that need no service."""

import json
from datetime import datetime

import pytest

from tablevet import (
    list_tables,
    preview,
    read_csv,
    read_source,
    read_table,
    score,
    staged,
    write_report,
)
from tablevet.sources import files
from tablevet.sources.databases import ReadSplit, jdbc_options
from tablevet.sources.demo import demo_table
from tablevet.sources.reports import report_name
from tablevet.sources.scratch import scratch_dir
from tablevet.sources.tables import table_size


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "head, sep", [("a;b;c\n1;2;3", ";"), ("a,b,c\n1,2,3", ","), ("a;b,c\n", ","), ("a\n", ",")]
)
def test_delimiter(spark, tmp_path, head, sep):
    assert files.sniff_delimiter(spark, write(tmp_path / "x.csv", head)) == sep


def test_csv_types_and_missing_values(spark, tmp_path):
    path = write(
        tmp_path / "x.CSV",
        'n,x,flag,text,gone,code\n1,1.5,True,"a ""b"", c",,007x\n,NA,False,N/A,,2d\n3,2,,x,null,3\n',
    )
    df = read_source(spark, path)
    assert dict(df.dtypes) == {
        "n": "bigint", "x": "double", "flag": "boolean", "text": "string", "gone": "double",
        "code": "string",
    }
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, 'a "b", c', None, "007x"),
        (None, None, False, None, None, "2d"),
        (3, 2.0, None, "x", None, "3"),
    ]


def test_csv_with_schema_and_line_breaks(spark, tmp_path):
    path = write(tmp_path / "x.csv", 'a;b\n1;"x\ny"\n')
    df = read_csv(spark, path, schema="a int, b string", multi_line=True)
    assert df.collect() == [(1, "x\ny")]


def test_parquet_by_suffix(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    assert read_source(spark, path).count() == 5


def test_url_is_copied_to_scratch(spark, tmp_path):
    path = write(tmp_path / "u.csv", "a,b\n1;2,3\n")
    df = files.read_url(spark, f"file://{path}")
    assert df.collect() == [("1;2", 3)]
    assert files.table_name_of("https://host/dir/u.csv?x=1") == "u.csv"


def test_object_store_options():
    uri, options = files.s3_source("b", "/d/x.csv", region="eu-west-1")
    assert uri == "s3a://b/d/x.csv"
    assert "Anonymous" in options["fs.s3a.aws.credentials.provider"]
    _, keyed = files.s3_source("b", "x", key="k", secret="s")
    assert keyed == {"fs.s3a.access.key": "k", "fs.s3a.secret.key": "s"}
    _, half = files.s3_source("b", "x", key="k")
    assert "fs.s3a.aws.credentials.provider" not in half

    uri, options = files.azure_source("AccountName=acc;AccountKey=a==;X=1", "cont", "p/x.parquet")
    assert uri == "abfss://cont@acc.dfs.core.windows.net/p/x.parquet"
    assert options == {"fs.azure.account.key.acc.dfs.core.windows.net": "a=="}

    account = {"client_email": "e", "private_key_id": "i", "private_key": "k"}
    uri, options = files.gcs_source("b", "x.csv", json.dumps(account))
    assert uri == "gs://b/x.csv"
    assert options["fs.gs.auth.service.account.email"] == "e"


def test_jdbc_options():
    base = dict(host="h", db="d", user="u", password="p", query="SELECT * FROM t;")
    plain = jdbc_options("postgresql", **base)
    assert plain["url"] == "jdbc:postgresql://h:5432/d"
    assert plain["query"] == "SELECT * FROM t"
    split = jdbc_options("mysql", **base, port=3307, split=ReadSplit("id", "0", "100", 4))
    assert split["url"] == "jdbc:mysql://h:3307/d"
    assert split["dbtable"] == "(SELECT * FROM t) t"
    assert split["numPartitions"] == "4" and "query" not in split
    with pytest.raises(ValueError):
        jdbc_options("sqlite", **base)


def test_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    for name in ("b", "a"):
        spark.range(3).write.mode("overwrite").saveAsTable(f"shop.{name}")
    assert [r.table_name for r in list_tables(spark, "shop").collect()][:2] == ["a", "b"]
    df = read_table(spark, "a", "shop")
    assert table_size(df).first() == (3, 1)
    assert preview(df, 2).count() == 2


def test_scratch_follows_the_session(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(base)
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_staged_copy_is_the_same_table(spark):
    df = demo_table(spark)
    copy = staged(df)
    assert copy.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, copy.collect())) == sorted(map(str, df.collect()))


def test_demo_table(spark):
    df = demo_table(spark)
    assert df.count() == 625
    result = score(df, "demo.table", as_of=datetime(2024, 6, 1))
    found = {(i.check, i.column) for i in result.issues}
    assert {
        ("email", "email"), ("phone", "phone"), ("negative", "age"), ("case_variant", "status"),
        ("fake_null", "country"), ("stale", "created_at"),
    } <= found
    assert result.scores["uniqueness"] == 92.0


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_report_is_written_by_table_and_run(spark, tmp_path, fmt):
    at = datetime(2024, 1, 2, 3, 4, 5)
    result = score(demo_table(spark), "demo.table", as_of=at)
    written = write_report(result, str(tmp_path), at, fmt)
    assert set(written) == {"summary", "dimensions", "issues", "rules", "column_scores", "worst_columns"}
    back = spark.read.format(fmt).load(written["dimensions"])
    assert back.count() == 9
    assert {(r.table_name, r.run) for r in back.collect()} == {("demo_table", "20240102_030405")}
    assert spark.read.format(fmt).load(written["issues"]).count() == len(result.issues)
    assert report_name("demo.table", at) == "demo_table_20240102_030405"


def test_only_files_with_broken_lines_are_read_whole(spark, tmp_path):
    from tablevet.sources.files import _by_broken_lines

    folder = tmp_path / "some files"
    folder.mkdir()
    for name, body in (("a b.csv", 'k,t\n1,x\n2,"y"\n'), ("c.csv", 'k,t\n3,"two\nlines"\n'), ("d.csv", "k,t\n4,NA\n")):
        (folder / name).write_text(body)
    parts = _by_broken_lines(spark, str(folder), None)
    assert [(len(files), whole) for files, whole in parts] == [(2, False), (1, True)]
    found = sorted(map(tuple, read_csv(spark, str(folder)).collect()))
    assert found == [(1, "x"), (2, "y"), (3, "two\nlines"), (4, None)]
    assert sorted(map(tuple, read_csv(spark, str(folder), sep=",", schema="k int, t string").collect()))[2] == (3, "two\nlines")
    assert _by_broken_lines(spark, str(folder / "d.csv"), None) == [(str(folder / "d.csv"), False)]


def test_staged_copy_is_given_back(spark, tmp_path, monkeypatch):
    from tablevet.plans import score as plans
    from tablevet.sources.scratch import booked, staged

    paths = []
    monkeypatch.setattr(plans, "give_back", lambda s, p: paths.extend(p))
    plans.score(spark.range(20), stage=True)
    assert len(paths) == 1 and spark.read.parquet(paths[0]).count() == 20
    monkeypatch.undo()
    plans.give_back(spark, paths)
    assert spark.read.parquet(paths[0]).count() == 0
    with booked() as outer:
        with booked() as inner:
            staged(spark.range(3))
        staged(spark.range(3))
    assert len(inner) == 1 and len(outer) == 2
