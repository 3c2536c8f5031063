"""Benchmark passages in documents, found by the q-gram lemma.

A text part within edit distance k of an item of m characters shares at least m + 1 - q * (k + 1)
of its q-grams, all on diagonals (place in the text minus place in the item) that lie within k of
each other.  Shared q-grams are counted in bands of diagonals that overlap by k, so that each
such part falls whole into one band.  Bands that reach the bound are kept, and the item is aligned
with the region of the text around the band.

Texts and items are compared with A-Z as a-z and each run of ASCII white space as one space.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablevet.llm.bytegrams import ddl
from tablevet.llm.textcodes import blanks, character_hash, characters, held, mix, slices
from tablevet.sources.scratch import staged

GRAM = 12
EDITS_PER = 20  # one edit allowed for so many characters of an item
BLOCK_CHARS = 4_000_000
_BITS = 23
_HITS = 1 << 20


def folded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice's texts with white space made even, and the texts' offsets."""
    chars, at = characters(data, at)
    space = blanks(chars)
    again = np.zeros(len(chars), bool)
    again[1:] = space[1:] & space[:-1]
    again[at[:-1][at[:-1] < len(chars)]] = False
    kept = np.r_[0, np.cumsum(~again)]
    return np.where(space, np.uint32(32), chars)[~again], kept[at]


def _gram_hashes(chars: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all q-grams inside the texts, their places and their texts."""
    sums, down = character_hash(chars)
    own = np.maximum(np.diff(at) - size + 1, 0)
    text = np.repeat(np.arange(len(own)), own)
    place = np.arange(len(text)) - np.repeat(np.cumsum(own) - own - at[:-1], own)
    return mix((sums[place + size] - sums[place]) * down[place]), place, text


@dataclass
class _Index:
    """The items of one block whose q-grams have one size."""

    size: int
    ids: np.ndarray
    items: list[np.ndarray]
    budgets: np.ndarray
    bounds: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(size: int, ids: np.ndarray, items: list[np.ndarray]) -> _Index:
        lengths = np.array([len(i) for i in items])
        # the most edits for which the lemma still asks for a shared q-gram
        budgets = np.maximum(0, np.minimum(lengths // EDITS_PER, lengths // size - 1))
        at = np.r_[0, np.cumsum(lengths)]
        hashes, place, owner = _gram_hashes(np.concatenate(items), at, size)
        rank = np.argsort(hashes, kind="stable")
        keys, starts = np.unique(hashes[rank], return_index=True)
        return _Index(
            size, ids, items, budgets, lengths + 1 - size * (budgets + 1), keys, np.r_[starts, len(rank)],
            owner[rank], (place - at[owner])[rank],
        )

    def seen(self) -> np.ndarray:
        out = np.zeros(1 << _BITS, bool)
        out[self.keys >> np.uint64(64 - _BITS)] = True
        return out

    def bands(self, hashes: np.ndarray, place: np.ndarray, text: np.ndarray, seen: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, first diagonal) of the bands that reach their item's bound."""
        some = np.flatnonzero(seen[hashes >> np.uint64(64 - _BITS)])
        at = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
        met = self.keys[at] == hashes[some]
        some, at = some[met], at[met]
        counts = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(counts)
        found: list[np.ndarray] = []
        numbers: list[np.ndarray] = []
        row = 0
        while row < len(some):  # the lists of a frequent q-gram may be long: a bounded number at a time
            base = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, base + _HITS, side="right")))
            own = counts[row:stop]
            entry = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own - self.starts[at[row:stop]], own)
            source = np.repeat(some[row:stop], own)
            item = self.owners[entry]
            diagonal = place[source] - self.offsets[entry] + (1 << 20)
            width = self.budgets[item] + 1
            band = diagonal // width
            # band b holds the diagonals from b * width on, width + budget of them
            both = np.r_[band, band - 1]
            use = np.r_[np.ones(len(band), bool), (diagonal - (band - 1) * width < width + self.budgets[item])]
            rows = np.stack([np.tile(text[source], 2), np.tile(item, 2), both])[:, use]
            if rows.shape[1]:
                rank = np.lexsort(rows[::-1])
                rows = rows[:, rank]
                new = np.flatnonzero(np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)])
                found.append(rows[:, new])
                numbers.append(np.diff(np.r_[new, rows.shape[1]]))
            row = stop
        if not found:
            return []
        rows, n = np.concatenate(found, axis=1), np.concatenate(numbers)
        rank = np.lexsort(rows[::-1])
        rows = rows[:, rank]
        new = np.flatnonzero(np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)])
        total = np.add.reduceat(n[rank], new)
        rows = rows[:, new]
        good = total >= self.bounds[rows[1]]
        first = rows[2] * (self.budgets[rows[1]] + 1) - (1 << 20)
        return list(zip(rows[0][good].tolist(), rows[1][good].tolist(), first[good].tolist()))


def band_width(item: int, region: int, budget: int) -> int:
    """Diagonals that alignments of at most ``budget`` edits can touch."""
    return max(0, region - item + 2 * budget + 1)


def banded_distance(item: np.ndarray, region: np.ndarray, budget: int) -> int:
    """Smallest edit distance between ``item`` and any part of ``region``; ``budget + 1`` if larger.

    Only the diagonals of the band are filled: a part begins and ends inside the region, so the
    diagonal of an alignment lies from 0 to the difference of the lengths, give or take one for each edit.
    """
    width, far = band_width(len(item), len(region), budget), budget + 1
    if not width:
        return far
    outside = np.full(budget, -1, np.int64)
    signs = np.concatenate([outside, region.astype(np.int64), outside])
    steps = np.arange(width)
    row = np.where((steps >= budget) & (steps <= budget + len(region)), 0, far)
    for i, sign in enumerate(item):
        new = row + (signs[i : i + width] != sign)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > budget:
            return far
    return int(min(row.min(), far))


def _indexes(ids: list[int], texts: list[str]) -> list[_Index]:
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    chars, cuts = folded(np.frombuffer(b"".join(raw), np.uint8), at)
    by_size: dict[int, list[int]] = {}
    items = []
    for i in range(len(ids)):
        item = chars[cuts[i] : cuts[i + 1]]
        inked = np.flatnonzero(item != 32)
        items.append(item[inked[0] : inked[-1] + 1] if len(inked) else item[:0])
        if len(items[-1]):
            by_size.setdefault(min(GRAM, len(items[-1])), []).append(i)
    return [_Index.of(size, np.array([ids[i] for i in rows]), [items[i] for i in rows]) for size, rows in by_size.items()]


def _searched(batches: Iterator[pa.RecordBatch], name: str, block) -> Iterator[pa.RecordBatch]:
    indexes = held(name, lambda: [(index, index.seen()) for index in _indexes(*block.value)])
    for batch in batches:
        found: list[list[int]] = [[] for _ in range(batch.num_rows)]
        for first, data, at in slices(batch.column("text"), 1 << 20):
            chars, cuts = folded(data, at)
            for index, seen in indexes:
                done = set()
                for text, item, diagonal in index.bands(*_gram_hashes(chars, cuts, index.size), seen):
                    if (text, item) in done:
                        continue
                    own, budget = index.items[item], int(index.budgets[item])
                    low = max(cuts[text], diagonal - budget)
                    high = min(cuts[text + 1], diagonal + 3 * budget + len(own) + 1)
                    if banded_distance(own, chars[low:high], budget) <= budget:
                        done.add((text, item))
                        found[first + text].append(int(index.ids[item]))
        items = pa.array([sorted(set(x)) for x in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, items], names=[*batch.schema.names, "item_ids"])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``item_ids``: the benchmark items of which the text holds a near copy, in order.

    A near copy is a part of the text within one edit for each ``EDITS_PER`` characters of the
    whole item; items too short for the lemma at that rate take the most edits it allows, the
    shortest must occur exactly.  Null and blank texts hold nothing; null, blank and unnumbered items are in
    nothing; rows are searched one by one, so repeated rows stay, and so do other columns.

    Items travel to the tasks in blocks of about ``block_chars`` characters; the documents are
    read once for each block, so a benchmark of any size is searched whole.
    """
    spark = docs.sparkSession
    docs = docs.drop("item_ids")
    known = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    chars = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))

    def searched(texts: DataFrame, number: int) -> DataFrame:
        own = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).toArrow()
        sent = spark.sparkContext.broadcast((own.column("item_id").to_pylist(), own.column("text").to_pylist()))
        task = partial(_searched, name=uuid.uuid4().hex, block=sent)
        return texts.mapInArrow(task, f"{ddl(texts)}, item_ids array<bigint>")

    if blocks == 1:
        return searched(docs, 0)
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()))
    total = None
    for number in range(blocks):
        part = staged(searched(rows.select("__row", "text"), number).filter("size(item_ids) > 0").select("__row", "item_ids"))
        total = part if total is None else total.unionByName(part)
    total = total.groupBy("__row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    out = rows.join(total, "__row", "left").drop("__row")
    return out.withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<bigint>")))
