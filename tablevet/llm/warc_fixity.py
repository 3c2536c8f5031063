"""Fixity audit of WARC replicas by Merkle trees, with DataFrame functions only.

A replica is a table of records: ``file, offset, length, digest``.  The records that begin in one
range of ``LEAF_BYTES`` make a leaf, ``FANOUT`` neighbouring nodes the node above, up to one root for
each file; every digest covers the places and digests below it in order.  An audit compares the
roots of two replicas, then on each level only the children of nodes that differ, and at
last the records of the leaves that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablevet.sources.scratch import staged

LEAF_BYTES = 1 << 16
FANOUT = 16
RECORDS_PER_FILE = 1000


def record_text(url: Column, body: Column) -> Column:
    """The bytes of a WARC response record, as text."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def as_records(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Places for rows that have ``length`` and ``digest``: adds ``file`` and ``offset``.

    A file takes ``RECORDS_PER_FILE`` consecutive keys, in order of key, then digest; a row without a
    key goes to one of a thousand files by its digest.
    """
    spare = -1 - F.pmod(F.xxhash64("digest"), F.lit(1000))
    rows = rows.withColumn("file", F.coalesce(F.floor(F.col(key) / RECORDS_PER_FILE), spare).cast("bigint"))
    before = Window.partitionBy("file").orderBy(key, "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint"))


def _digest(place: str, digest: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(digest).alias("d"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x.p.cast("string"), x.d)), ";"), 256)


def merkle_levels(records: DataFrame, levels: int) -> list[DataFrame]:
    """Stored nodes ``file, node, digest`` from the leaves (first) to one root for each file (last)."""
    marked = records.withColumn("d", F.concat_ws("/", F.col("length").cast("string"), "digest"))
    leaf = F.floor(F.col("offset") / LEAF_BYTES).cast("bigint").alias("node")
    out = [staged(marked.groupBy("file", leaf).agg(_digest("offset", "d").alias("digest")))]
    for _ in range(levels):
        above = F.floor(F.col("node") / FANOUT).cast("bigint").alias("node_")
        level = out[-1].groupBy("file", above).agg(_digest("node", "digest").alias("digest"))
        out.append(staged(level.withColumnRenamed("node_", "node")))
    return out


def _level_count(*replicas: DataFrame) -> int:
    """Levels above the leaves until every file has one node; a few even for files of petabytes."""
    last = max((r.agg(F.max("offset")).first()[0] or 0) for r in replicas) // LEAF_BYTES
    levels = 0
    while last:
        last //= FANOUT
        levels += 1
    return levels


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """``file, offset, status, length, replica_length``: the records in which two replicas differ.

    ``status`` is ``changed`` (another length or digest at the same place), ``missing`` (only in the
    first) or ``extra`` (only in the second).  Records without file or offset have no place and are
    left out; of records that repeat file and offset all count.  Two empty replicas agree.
    """
    placed = "file IS NOT NULL AND offset IS NOT NULL"
    columns = ["file", "offset", "length", "digest"]
    first, second = (staged(r.filter(placed).select(*columns)) for r in (first, second))
    levels = _level_count(first, second)
    trees = merkle_levels(first, levels), merkle_levels(second, levels)
    differing = None
    for level in range(levels, -1, -1):
        sides = [t[level] for t in trees]
        if differing is not None:
            parent = F.floor(F.col("node") / FANOUT).cast("bigint")
            sides = [s.withColumn("parent", parent).join(differing, ["file", "parent"], "left_semi").drop("parent") for s in sides]
        both = sides[0].withColumnRenamed("digest", "a").join(sides[1].withColumnRenamed("digest", "b"), ["file", "node"], "full")
        differing = staged(both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("file", F.col("node").alias("parent")))
    leaf = F.floor(F.col("offset") / LEAF_BYTES).cast("bigint")
    a, b = (r.withColumn("parent", leaf).join(differing, ["file", "parent"], "left_semi") for r in (first, second))
    a = a.groupBy("file", "offset").agg(F.max("length").alias("length"), _digest("length", "digest").alias("a"))
    b = b.groupBy("file", "offset").agg(F.max("length").alias("replica_length"), _digest("length", "digest").alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    both = a.join(b, ["file", "offset"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("file", "offset", status.alias("status"), "length", "replica_length")
