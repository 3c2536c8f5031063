"""Counts of byte contexts over a corpus, and scores of texts from a table of contexts.

A text is the sequence of its UTF-8 bytes (A-Z as a-z) and one end sign; before its first byte
stand start signs.  A gram of order k packs k signs of context and the sign that follows, nine
bits each, the newest lowest, so that cutting the oldest sign is a bit mask.

Counts are combined inside each task before one shuffle by gram.  A finished model is a table
with one row for each gram that occurs, and texts are scored against blocks of that table of
at most ``BLOCK_ROWS`` rows: what is broadcast is bounded whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tablevet.llm.textcodes import LOWER, let_go, mix, signed, slices
from tablevet.sources.scratch import staged

SIGN_BITS = 9
END, START = 256, 257
SIGNS = 257  # bytes and the end sign: what a model gives a probability
BLOCK_ROWS = 4_000_000
_HELD_ROWS = 1_000_000


def gram_codes(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Top-order grams of all positions of a slice's texts: each text's bytes, then its end."""
    n = len(at) - 1
    step = order + 1
    signs = np.full(len(data) + n * step + order, START, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(at))
    signs[np.arange(len(data)) + owner * step + order] = LOWER[data]
    ends = at[1:] + np.arange(n) * step + order
    signs[ends] = END
    codes = signs[: len(signs) - order].copy()
    for i in range(1, step):
        codes <<= np.uint64(SIGN_BITS)
        codes |= signs[i : len(signs) - order + i]
    return codes[signs[order:] != START]


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rank = np.argsort(codes, kind="stable")
    codes = codes[rank]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(counts[rank], first)


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    let_go()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def flush():
        codes, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
        held[:] = [(codes, counts)]
        return len(codes)

    def out():
        codes, counts = held.pop()
        for i in range(0, len(codes), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(codes[i : i + (1 << 16)])), pa.array(counts[i : i + (1 << 16)])], names=["gram", "n"]
            )

    for batch in batches:
        learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        for use in (True, False):
            texts = batch.column("text").filter(pa.array(learn == use))
            for _, data, at in slices(texts, 1 << 20):
                codes = gram_codes(data, at, order)
                codes.sort()
                first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                counts = np.diff(np.r_[first, len(codes)]) if use else np.zeros(len(first), np.int64)
                held.append((codes[first], counts))
                rows += len(first)
                if rows > _HELD_ROWS:
                    rows = flush()
                    if rows > _HELD_ROWS // 2:
                        yield from out()
                        rows = 0
    if held:
        flush()
        yield from out()


def gram_counts(docs: DataFrame, learn: Column, order: int) -> DataFrame:
    """``gram, n``: every top-order gram of all texts, counted where ``learn`` holds (else 0)."""
    parts = docs.select("text", F.coalesce(learn, F.lit(False)).alias("learn")).mapInArrow(
        partial(_counted, order=order), "gram bigint, n bigint"
    )
    return staged(parts.groupBy("gram").agg(F.sum("n").alias("n")))


def context(gram: str | Column = "gram") -> Column:
    return F.shiftrightunsigned(gram, SIGN_BITS)


def without_oldest(order: int, gram: str | Column = "gram") -> Column:
    """The gram of order ``order - 1`` at the end of one of order ``order``."""
    return (F.col(gram) if isinstance(gram, str) else gram).bitwiseAND(F.lit((1 << (SIGN_BITS * order)) - 1))


class Lookup:
    """Values by 64-bit key: keys sorted by hash, found from their hash's leading bits on."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = mix(keys)
        rank = np.argsort(hashed)
        self.keys = np.r_[keys[rank], np.uint64(2**64 - 1)]
        self.values = np.r_[values[rank], 0.0]
        self.bits = max(1, int(len(keys)).bit_length())
        tops = hashed[rank] >> np.uint64(64 - self.bits)
        self.starts = np.searchsorted(tops, np.arange(1 << self.bits, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.bincount(tops.astype(np.int64)).max()) if len(keys) else 0

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys; 0 for keys that are not here."""
        at = self.starts[mix(keys) >> np.uint64(64 - self.bits)]
        found = self.keys[at] == keys
        out = np.where(found, self.values[at], 0.0)
        open_ = np.flatnonzero(~found)
        for _ in range(1, self.most):
            if not len(open_):
                break
            here = np.minimum(at[open_] + 1, len(self.keys) - 1)
            at[open_] = here
            found = self.keys[here] == keys[open_]
            out[open_[found]] = self.values[here[found]]
            open_ = open_[~found]
        return out


def _scored(batches: Iterator[pa.RecordBatch], table: Broadcast, order: int, column: str) -> Iterator[pa.RecordBatch]:
    let_go()
    lookup = table.value
    for batch in batches:
        sums = np.zeros(batch.num_rows)
        for first, data, at in slices(batch.column("text"), 1 << 20):
            logs = lookup(gram_codes(data, at, order))
            starts = at[:-1] + np.arange(len(at) - 1)  # each text has one sign more than bytes
            sums[first : first + len(starts)] = np.add.reduceat(logs, starts)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], names=[*batch.schema.names, column])


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def with_scores(docs: DataFrame, model: DataFrame, order: int, column: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with the sum of the model's ``value`` over the grams of each ``text``.

    ``model`` (``gram, value``, stored) holds every gram that occurs in the texts.  It is sent to
    the tasks in blocks of about ``block_rows`` rows; the texts are read once for each block.
    """
    spark = docs.sparkSession
    blocks = max(1, -(-model.count() // block_rows))

    def scored(texts: DataFrame, block: int) -> DataFrame:
        own = model.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == block).toArrow()
        # sorted here once, so that a worker holds the table and nothing beside it
        sent = spark.sparkContext.broadcast(Lookup(own.column("gram").to_numpy().view(np.uint64), own.column("value").to_numpy()))
        task = partial(_scored, table=sent, order=order, column=column)
        return texts.mapInArrow(task, f"{ddl(texts)}, `{column}` double")

    if blocks == 1:
        return scored(docs, 0)
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()))
    parts = [staged(scored(rows.select("__row", "text"), b).select("__row", column)) for b in range(blocks)]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return rows.join(total.groupBy("__row").agg(F.sum(column).alias(column)), "__row").drop("__row")
