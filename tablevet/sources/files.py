"""CSV and Parquet files, local, shared or in an object store."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from tablevet.functions.text import occurrences
from tablevet.functions.values import quote_name, sql_text
from tablevet.operators.fused import FusedScan
from tablevet.sources.scratch import scratch_dir

SNIFF_CHARS = 4096
DELIMITERS = (",", ";", "\t", "|")
# Cell texts a CSV reader takes for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_source(
    spark: SparkSession, uri: str, options: dict[str, str] | None = None, **csv: object
) -> DataFrame:
    """Read one file, folder or URL; the suffix tells the format.

    ``.parquet`` is Parquet, and so is anything but ``.csv`` on Azure and Google storage.  The
    rest is CSV: with commas behind a URL and for ``.csv`` objects of a store, with any usual
    delimiter for its other objects, else with commas or semicolons as the head of the file says.
    """
    scheme, path = urlparse(uri).scheme.lower(), urlparse(uri).path.lower()
    if scheme in ("http", "https"):
        return read_url(spark, uri)
    if path.endswith(".parquet") or (scheme in _PARQUET_STORES and not path.endswith(".csv")):
        return spark.read.options(**(options or {})).parquet(uri)
    if scheme in (*_PARQUET_STORES, "s3", "s3a"):
        if path.endswith(".csv"):
            csv = {"sep": ","} | csv
        elif "sep" not in csv:
            csv["sep"] = sniff_delimiter(spark, uri, options, DELIMITERS)
    return read_csv(spark, uri, options=options, **csv)


_PARQUET_STORES = ("abfs", "abfss", "wasb", "wasbs", "gs")


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    schema: str | None = None,
    na_tokens: tuple[str, ...] = NA_TOKENS,
    multi_line: bool | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """CSV with a header line.

    Without ``schema`` one scan finds the type of every column: whole numbers, numbers,
    booleans or text.  ``na_tokens`` read as null.  ``multi_line`` allows line breaks inside
    quotes; by default a scan for lines with an odd number of quotes decides file by file, for
    files with such lines cannot be split and are read by one task each, and all others can.
    """
    sep = sep or sniff_delimiter(spark, path, options)
    parts = [(path, multi_line)] if multi_line is not None else _by_broken_lines(spark, path, options)

    def cells_of(files: str | list[str], whole: bool, columns: str | None) -> DataFrame:
        reader = spark.read.options(**(options or {})).options(header=True, sep=sep, quote='"', escape='"', multiLine=whole)
        return reader.schema(columns).csv(files) if columns else reader.options(inferSchema=False).csv(files)

    text = cells_of(*parts[0], schema)
    if len(parts) > 1:
        names = schema or ", ".join(f"{quote_name(c)} STRING" for c in text.columns)
        text = text.union(cells_of(*parts[1], names))
    if schema:
        return text
    tokens = ", ".join(sql_text(t) for t in na_tokens)
    cells = {c: f"IF({quote_name(c)} IN ({tokens}), NULL, {quote_name(c)})" for c in text.columns}
    scan = FusedScan()
    for c, cell in cells.items():
        scan.want((c, "filled"), f"count({cell})")
        for kind, cast in _CASTS.items():
            scan.want((c, kind), f"count({cast.format(cell)})")
    found = scan.run(text)
    return text.selectExpr(
        *[
            f"{_column_type(found, c).format(cell)} AS {quote_name(c)}"
            for c, cell in cells.items()
        ]
    )


_CASTS = {
    "whole": r"try_cast(IF({0} RLIKE r'^\s*[+-]?[0-9]+\s*$', {0}, NULL) AS BIGINT)",
    "number": r"try_cast(IF({0} RLIKE r'[0-9.][dDfF]\s*$', NULL, {0}) AS DOUBLE)",
    "boolean": "CASE {0} WHEN 'True' THEN true WHEN 'False' THEN false"
    " WHEN 'true' THEN true WHEN 'false' THEN false WHEN 'TRUE' THEN true"
    " WHEN 'FALSE' THEN false END",
}


def _column_type(found: dict, c: str) -> str:
    """The narrowest cast that reads every filled cell; an empty column is a number."""
    for kind in ("whole", "number", "boolean"):
        if found[c, kind] == found[c, "filled"]:
            return _CASTS["number" if found[c, "filled"] == 0 else kind]
    return "{0}"


def _by_broken_lines(
    spark: SparkSession, path: str, options: dict[str, str] | None
) -> list[tuple[str | list[str], bool]]:
    """The files to be read line by line and those to be read whole, as (paths, whole)."""
    lines = spark.read.options(**(options or {})).text(path)
    odd = lines.filter(f"{occurrences('value', chr(34))} % 2 = 1")
    broken = {unquote(r.file) for r in odd.selectExpr("_metadata.file_path AS file").distinct().collect()}
    if not broken:
        return [(path, False)]
    others = sorted(f for f in map(unquote, lines.inputFiles()) if _plain(f) not in map(_plain, broken))
    return [(others, False), (sorted(broken), True)] if others else [(path, True)]


def _plain(file: str) -> str:
    """A file's URI, of which several spellings mean the same: ``file:/a`` and ``file:///a``."""
    return re.sub(r"^(\w+):/+", r"\1:/", file)


def sniff_delimiter(
    spark: SparkSession,
    path: str,
    options: dict[str, str] | None = None,
    among: tuple[str, ...] = (";", ","),
) -> str:
    """The delimiter that the first ``SNIFF_CHARS`` characters hold most of; ``,`` where none does.

    Of a folder, the file with the smallest path is looked at.  With more than two delimiters to
    choose from, text in quotes is left out, for a sentence holds commas whatever cuts its cells.
    """
    reader = spark.read.options(**(options or {}))
    files = sorted(reader.text(path).inputFiles())
    if not files:
        return ","
    # every line has its line feed, so this many lines always reach the number of characters
    lines = reader.text(unquote(files[0])).limit(SNIFF_CHARS)
    head, size = [], 0
    for row in lines.selectExpr(f"substring(value, 1, {SNIFF_CHARS}) AS line").toLocalIterator():
        head.append(row["line"])
        size += len(row["line"]) + 1
        if size >= SNIFF_CHARS:
            break
    text = "\n".join(head)[:SNIFF_CHARS]
    if len(among) > 2:
        text = re.sub(r'"[^"]*"?', "", text)
    found = {d: text.count(d) for d in among}
    return max(found, key=lambda d: (found[d], d == ","))


def delimiter_counts(df: DataFrame, column_name: str) -> DataFrame:
    """(semicolons, commas) in all of a text column; lazy, one scan."""
    c = quote_name(column_name)
    return df.selectExpr(
        f"coalesce(sum({occurrences(c, ';')}), 0L) AS semicolons",
        f"coalesce(sum({occurrences(c, ',')}), 0L) AS commas",
    )


def read_url(spark: SparkSession, url: str) -> DataFrame:
    """Comma CSV behind a URL, streamed into the shared scratch folder and read from there.

    One stream feeds the copy, so this is for the small files such URLs offer.
    """
    jvm = spark._jvm
    target = f"{scratch_dir(spark, 'url')}/{table_name_of(url)}"
    path = jvm.org.apache.hadoop.fs.Path(target)
    conf = spark._jsc.hadoopConfiguration()
    source = jvm.java.net.URL(url).openStream()
    sink = path.getFileSystem(conf).create(path, True)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, sink, conf, True)
    return read_csv(spark, target, sep=",")


def table_name_of(uri: str) -> str:
    """Last segment of a path or URL."""
    return urlparse(uri).path.rstrip("/").split("/")[-1] or "dataset"


# ------------------------------------------------------------------ object stores


def s3_source(
    bucket: str, path: str, key: str = "", secret: str = "", region: str = ""
) -> tuple[str, dict[str, str]]:
    """URI and read options; anonymous when neither key nor secret is given."""
    options = {}
    if region:
        options["fs.s3a.endpoint.region"] = region
    if key or secret:
        options["fs.s3a.access.key"] = key
        options["fs.s3a.secret.key"] = secret
    else:
        options["fs.s3a.aws.credentials.provider"] = (
            "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
        )
    return f"s3a://{bucket}/{path.lstrip('/')}", options


def azure_source(connection: str, container: str, blob: str) -> tuple[str, dict[str, str]]:
    """URI and read options from a storage connection string."""
    parts = dict(p.split("=", 1) for p in connection.split(";") if "=" in p)
    host = f"{parts['AccountName']}.dfs.{parts.get('EndpointSuffix', 'core.windows.net')}"
    options = {}
    if "AccountKey" in parts:
        options[f"fs.azure.account.key.{host}"] = parts["AccountKey"]
    return f"abfss://{container}@{host}/{blob.lstrip('/')}", options


def gcs_source(bucket: str, path: str, credentials: str) -> tuple[str, dict[str, str]]:
    """URI and read options from service-account JSON."""
    account = json.loads(credentials)
    return f"gs://{bucket}/{path.lstrip('/')}", {
        "fs.gs.auth.service.account.enable": "true",
        "fs.gs.auth.service.account.email": account["client_email"],
        "fs.gs.auth.service.account.private.key.id": account["private_key_id"],
        "fs.gs.auth.service.account.private.key": account["private_key"],
    }
