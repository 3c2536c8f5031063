"""Similarity join on word shingles by parity sketches.

Every document's set of shingles is folded into bit sketches by XOR.  Toggling one element
changes one bit of one part, so two sketches differ in at most as many places as their sets
do.  Sets of Jaccard similarity ``t`` differ in at most ``(1 - t) / (1 + t) * (a + b)`` elements
for sizes a and b.  With more parts than that, some parts must agree (pigeonhole), and
documents meet in an equi-join on those parts.  Exact verification follows.

Sizes are cut into bands with a fixed ratio.  A document joins in its own band, and in the next
one if a partner can be that large.  A band with difference bound ``d`` has ``d + 1 + s``
parts, of which a document leaves out its ``s`` lightest (ties kept).  At least ``s + 1``
parts agree for a linked pair, and the heaviest of them is kept on both sides, so nothing is
lost, while parts that hold next to nothing, which would join unrelated documents, stay out.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablevet.llm.components import components
from tablevet.llm.textcodes import let_go, list_column, mix, shingle_hashes, signed, slices, word_hashes
from tablevet.sources.scratch import staged

SKETCH_WORDS = 16
SKETCH_BITS = 64 * SKETCH_WORDS


class Similarity:
    """Jaccard similarity of at least ``percent`` / 100, in whole numbers."""

    def __init__(self, percent: int):
        if not 50 < percent <= 100:
            raise ValueError("the similarity must be over 50 and at most 100 percent")
        self.percent = percent

    def most_difference(self, total: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes sum to ``total``."""
        return (100 - self.percent) * total // (100 + self.percent)

    def largest_partner(self, size: int) -> int:
        return 100 * size // self.percent

    @lru_cache(maxsize=1)  # noqa: B019
    def bands(self) -> list[int]:
        """Smallest size of each band; below the first, only equal sets link."""
        first = next((n for n in range(1, 201) if self.largest_partner(n) > n), 1 << 40)
        out = [first]
        while out[-1] < 1 << 40:
            out.append(max(self.largest_partner(out[-1]) + 2, out[-1] * 3 // 2))
        return out

    def band_parts(self, band: int) -> tuple[int, int]:
        """(parts, how many of them a document may leave out)."""
        d = self.most_difference(2 * (self.bands()[band + 1] - 1))
        slack = (d + 1) // 3
        return d + 1 + slack, slack

    def bands_of(self, size: int) -> list[int]:
        own = bisect_right(self.bands(), size) - 1
        if own < 0:
            return []
        return [own, own + 1] if self.largest_partner(size) >= self.bands()[own + 1] else [own]


def part_keys(elements: np.ndarray, likeness: Similarity) -> np.ndarray:
    """Join keys of a set of sorted distinct 64-bit elements: one for each part that is kept."""
    keys = []
    for band in likeness.bands_of(len(elements)):
        parts, slack = likeness.band_parts(band)
        part = ((elements >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # grows with the element
        edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        counts = np.diff(edges)
        folded = np.zeros(parts, np.uint64)
        full = np.flatnonzero(counts)
        folded[full] = np.bitwise_xor.reduceat(mix(elements), edges[full])
        kept = np.flatnonzero(counts >= np.partition(counts, slack)[slack])
        name = mix(np.uint64(band << 40) + kept.astype(np.uint64))
        keys.append(mix(folded[kept] ^ name))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def sketch_of(elements: np.ndarray, size: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the elements that hash to each of ``size`` bits, a power of two; its halves by XOR are the sketch of half the size."""
    bits = np.bincount((mix(elements) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.int64)


def wide_sketch_of(elements: np.ndarray) -> np.ndarray:
    """A sketch of a bit or more an element; none for a set that :func:`sketch_of` tells apart itself."""
    if len(elements) <= SKETCH_BITS:
        return np.zeros(0, np.int64)
    return sketch_of(elements, 1 << (len(elements) - 1).bit_length())


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, data, at in slices(batch.column("text")):
        words, starts = word_hashes(data, at)
        for i in range(len(at) - 1):
            yield first + i, np.unique(shingle_hashes(words[starts[i] : starts[i + 1]], size))


def _sketched(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    let_go()
    likeness = Similarity(percent)
    for batch in batches:
        n = batch.num_rows
        sizes, key_counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        sketches, keys = np.zeros((n, SKETCH_WORDS), np.int64), []
        wide, wide_counts = [np.zeros(0, np.int64)], np.zeros(n, np.int64)
        for row, found in _sets(batch, size):
            sizes[row] = len(found)
            if not len(found):
                continue
            one[row] = np.bitwise_xor.reduce(mix(found ^ np.uint64(0xA5A5A5A5)))
            two[row] = np.add.reduce(mix(found))
            if own := part_keys(found, likeness).tolist():
                sketches[row] = sketch_of(found)
                wide.append(wide_sketch_of(found))
                wide_counts[row] = len(wide[-1])
                keys.append(np.array(own, np.uint64))
                key_counts[row] = len(own)
        joined = signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(sizes), pa.array(signed(one)), pa.array(signed(two)),
                list_column(sketches.reshape(-1), np.full(n, SKETCH_WORDS)), list_column(np.concatenate(wide), wide_counts),
                list_column(joined, key_counts),
            ],
            names=["doc_id", "n_shingles", "one", "two", "sketch", "wide", "keys"],
        )


def _element_lists(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        found = [own for _, own in _sets(batch, size)]
        for start in range(0, len(found), 256):
            own = found[start : start + 256]
            lists = list_column(signed(np.concatenate(own)), np.array([len(x) for x in own]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(start, len(own)), lists], names=["doc_id", "elements"]
            )


def _hamming() -> Column:
    """Differing bits of the sketches of a pair."""
    return sum((F.bit_count(F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])) for i in range(SKETCH_WORDS)), F.lit(0))


def _wide_hamming() -> Column:
    """Differing bits of the wide sketches of a pair, of which the longer is folded to the other; of no bits if one has none."""
    a, b = F.col("a_wide"), F.col("b_wide")

    def folded(x: Column, other: Column) -> Column:
        n = F.size(other)
        halves = F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > n, halves).otherwise(x)

    bits = F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.aggregate(bits, F.lit(0), lambda total, n: total + n))


def _may_link(percent: int) -> Column:
    """Not ruled out by sizes and sketches.  Sizes so near leave the wide sketches at most a fold apart."""
    a, b = F.col("a_n"), F.col("b_n")
    most = (a + b) * (100 - percent)
    near = (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (_hamming() * (100 + percent) <= most)
    return near & (_wide_hamming() * (100 + percent) <= most)


def _verified(pairs: DataFrame, docs: DataFrame, sketched: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the stored pairs ``a, b`` whose sets are similar enough; only sets that their sketches leave open are read."""
    near = pairs
    for side in "ab":
        own = [f"doc_id AS {side}", f"n_shingles AS {side}_n", f"sketch AS {side}_sketch", f"wide AS {side}_wide"]
        near = near.join(sketched.filter("size(keys) > 0").selectExpr(*own), side)
    near = staged(near.filter(_may_link(percent)).select("a", "b").distinct())
    ids = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
    sets = docs.join(staged(ids), "doc_id", "left_semi").mapInArrow(
        partial(_element_lists, size=size), "doc_id bigint, elements array<bigint>"
    )
    sets = staged(sets)
    for side in "ab":
        near = near.join(sets.selectExpr(f"doc_id AS {side}", f"elements AS {side}_set"), side)
    common = F.size(F.array_intersect("a_set", "b_set")).cast("bigint")
    union = F.size("a_set") + F.size("b_set") - common
    return near.filter(common * 100 >= union * percent).select("a", "b").distinct()


def similar_documents(docs: DataFrame, shingle_words: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id``: classes of documents joined by similarity links.

    Words are runs of bytes other than ASCII white space, with A-Z as a-z.  A document's set
    holds its distinct runs of ``shingle_words`` words; a shorter text is one shingle.  Two
    documents link when 100 * |intersection| >= ``percent`` * |union|; ``component_id`` is the smallest
    doc_id that links reach.  Null and empty texts have no shingle and link with nothing.
    Rows with one doc_id are one document for links and keep a row each; a row whose doc_id is
    null is alone and its component is null.  Other columns are left out.

    Equal sets are one class before any join.  Candidates are first compared with the smallest
    document of their part only; where a part then still holds several components, all its pairs
    of different components are compared.  Sketches that grow with the sets reject most of them before their sets are read.
    """
    docs = docs.select("doc_id", "text")
    sketched = staged(
        docs.mapInArrow(
            partial(_sketched, size=shingle_words, percent=percent),
            "doc_id bigint, n_shingles bigint, one bigint, two bigint, sketch array<bigint>, wide array<bigint>, keys array<bigint>",
        )
    )
    same = ["one", "two", "n_shingles"]
    known = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(known.groupBy(*same).agg(F.min("doc_id").alias("class")))

    # a class is one row here, so its parts need no further shuffle than the one by key
    keyed = known.filter("size(keys) > 0").groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    parts = keyed.select(F.explode("keys").alias("key"), "doc_id")
    part = Window.partitionBy("key")
    members = parts.select("key", "doc_id", F.min("doc_id").over(part).alias("pivot"), F.max("doc_id").over(part).alias("last"))
    members = staged(members.filter("pivot < last").drop("last"))
    stars = staged(members.filter("doc_id != pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct())
    links = staged(_verified(stars, docs, sketched, shingle_words, percent))

    rest = staged(_unjoined(members, links, sketched, percent).join(stars, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = links.union(_verified(rest, docs, sketched, shingle_words, percent))
    named = known.join(classes, same).filter("doc_id != class")
    repeated = known.groupBy("doc_id").agg(F.min("one"), F.max("one")).filter("min(one) != max(one)")
    own_links = named.join(repeated, "doc_id", "left_semi").selectExpr("class AS a", "doc_id AS b")
    found = staged(components(links.union(own_links)))

    out = sketched.join(classes, same, "left")
    out = out.join(found.withColumnRenamed("node", "class"), "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class", "doc_id")).alias("component_id"))


def _unjoined(members: DataFrame, links: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a part, are of different components so far and pass the sketch bound."""
    found = staged(components(links))
    named = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = staged(named.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    split = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_parts = staged(named.join(staged(split.filter("low < high").select("key")), "key"))
    near = open_parts.join(sketched.filter("size(keys) > 0").select("doc_id", "n_shingles", "sketch"), "doc_id")
    near = staged(near)
    left, right = (
        near.selectExpr("key", f"doc_id AS {s}", f"component AS {s}_of", f"n_shingles AS {s}_n", f"sketch AS {s}_sketch") for s in "ab"
    )
    total = F.col("a_n") + F.col("b_n")
    close = (F.col("a") < F.col("b")) & (F.col("a_of") != F.col("b_of")) & (_hamming() * (100 + percent) <= total * (100 - percent))
    return left.join(right, "key").filter(close).select("a", "b").distinct()


def one_of_each_component(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each component, once; a null doc_id is kept."""
    found = similar_documents(docs, shingle_words, percent)
    leaders = staged(found.filter("doc_id = component_id").select("doc_id").distinct())
    kept = docs.join(leaders, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
