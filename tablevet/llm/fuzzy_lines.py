"""Removal of lines that nearly repeat another line of the corpus.

A line is its set of character shingles (A-Z as a-z).  One pass over the texts gives every
line a MinHash signature by one permutation: each shingle hash falls into one bin, a bin
keeps its smallest, and an empty bin borrows from the next full one.  Bands of the signature are
join keys.  Lines that meet in a band are verified by the exact Jaccard similarity of their
shingle sets, and a distributed union-find keeps the first line of each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablevet.llm.components import components, contracted, joined_so_far
from tablevet.llm.textcodes import SLICE_BYTES, blanks, character_hash, characters, let_go, list_column, mix, signed, slices, text_arrays
from tablevet.sources.scratch import staged

SHINGLE = 8
PERCENT = 80
BANDS, ROWS = 8, 3  # a pair of similarity 0.8 shares a band with probability 0.997
SKETCH_BITS = 1024
MARKS = 1 << 26  # bits that mark the lines to be read again
ROUNDS = 1  # of joining components before the last links are known
PARTNERS = 4  # members of a part's largest component that each of its other members is compared with
PIECE = 1 << 18  # bytes of lines whose shingles a task holds at once, or one pair of longer lines
_EMPTY = np.uint64(2**64 - 1)
_STEP = 0x9E3779B1  # spreads the line numbers of a text over the marks


class _Lines:
    """The lines of a slice's texts: where they are, their hashes and those of their shingles."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: int):
        chars, text_at = characters(data, at)
        breaks = np.flatnonzero(chars == 10)
        self.starts = np.sort(np.r_[text_at[:-1], breaks + 1], kind="stable")
        self.ends = np.sort(np.r_[breaks, text_at[1:]], kind="stable")
        self.counts = np.diff(np.searchsorted(breaks, text_at)) + 1  # lines of each text
        sums, down = character_hash(chars)
        self.lengths = self.ends - self.starts
        whole = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self.one = mix(whole + self.lengths.astype(np.uint64))
        self.shingles = np.where(self.lengths >= size, self.lengths - size + 1, np.minimum(self.lengths, 1))
        self.line_of = np.repeat(np.arange(len(self.starts)), self.shingles)
        self.first = np.cumsum(self.shingles) - self.shingles  # each line's place among all shingles
        short = (self.lengths > 0) & (self.lengths < size)
        if len(chars) >= size:  # the shingles of all places in one sweep, then those that lie in one line
            every = (sums[size:] - sums[:-size]) * down[: len(chars) - size + 1]
            place = np.arange(len(self.line_of)) - np.repeat(self.first - self.starts, self.shingles)
            hashes = every[np.minimum(place, len(every) - 1)]
        else:
            hashes = np.zeros(len(self.line_of), np.uint64)
        hashes[self.first[short]] = whole[short]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.hashes = hashes ^ (hashes >> np.uint64(32))
        ink = np.flatnonzero(~blanks(chars))
        self.blank = np.searchsorted(ink, self.ends) == np.searchsorted(ink, self.starts)

    def second(self) -> np.ndarray:
        """A second hash of each line."""
        sums = np.zeros(len(self.shingles), np.uint64)
        if len(held := np.flatnonzero(self.shingles)):
            sums[held] = np.add.reduceat(self.hashes * np.uint64(0xA0761D6478BD642F), self.first[held])
        return mix(sums)

    def bands(self, bands: int, rows: int) -> np.ndarray:
        bins, lines = bands * rows, len(self.starts)
        cells = np.full(lines * bins, _EMPTY)
        where = (((self.hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(cells, self.line_of * bins + where, self.hashes * np.uint64(0xE7037ED1A0B428DB))
        cells = cells.reshape(lines, bins)
        open_ = np.flatnonzero((cells == _EMPTY).any(1) & (self.shingles > 0))
        own = cells[open_]
        filled = own.copy()
        for step in range(1, bins):
            lent = np.roll(own, -step, axis=1)
            take = (filled == _EMPTY) & (lent != _EMPTY)
            if not take.any():
                if not (filled == _EMPTY).any():
                    break
                continue
            filled[take] = lent[take] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64)
        cells[open_] = filled
        cells = cells.reshape(lines, bands, rows)
        keys = mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))[None, :] + np.zeros((lines, 1), np.uint64)
        for r in range(rows):
            keys = mix(keys ^ cells[:, :, r])
        return keys


def _pieces(batch: pa.RecordBatch, columns: list[str], budget: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that hold at most ``budget`` bytes in the given string columns, or one row that holds more."""
    at = sum(text_arrays(batch.column(c))[1] for c in columns)
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + budget, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def _signed_lines(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    let_go()
    names = ["doc_id", "text_key", "line_no", "one", "two", "blank", "bands"]
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("text_key")
        for first, data, at in slices(batch.column("text"), 1 << 19):
            own = _Lines(data, at, size)
            texts = np.repeat(np.arange(len(at) - 1), own.counts)
            line_no = np.arange(len(texts)) - np.repeat(np.cumsum(own.counts) - own.counts, own.counts)
            take = pa.array(texts + first)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(take), keys.take(take), pa.array(line_no.astype(np.int32)), pa.array(signed(own.one)),
                    pa.array(signed(own.second())), pa.array(own.blank),
                    list_column(signed(own.bands(bands, rows).reshape(-1)), np.full(len(texts), bands)),
                ],
                names=names,
            )


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each of ``n`` rows, in order: rows, and hashes with as many last bits cleared as number the rows."""
    room = np.uint64(64 - int(n).bit_length())
    keys = np.sort((rows.astype(np.uint64) << room) | (hashes >> (np.uint64(64) - room)))
    keys = keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]]
    return (keys >> room).astype(np.int64), keys << (np.uint64(64) - room)


def _sketches(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of distinct shingles of lines, and the parity of those that hash to each bit."""
    sizes, sketches = [], []
    for _, data, at in slices(column, 1 << 18):
        own, n = _Lines(data, at, size), len(at) - 1
        line, found = _distinct(own.line_of, own.hashes, n)
        bit = ((found >> np.uint64(32)) * np.uint64(SKETCH_BITS) >> np.uint64(32)).astype(np.int64)  # of the first bits, which no row takes
        bits = np.bincount(line * SKETCH_BITS + bit, minlength=n * SKETCH_BITS) & 1
        sizes.append(np.bincount(line, minlength=n))
        sketches.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
    return np.concatenate(sizes), np.concatenate(sketches)


def _marked_lines(batches: Iterator[pa.RecordBatch], size: int, marks: bytes) -> Iterator[pa.RecordBatch]:
    """The lines whose bit of ``marks`` is set, with sizes and sketches."""
    let_go()
    bits = np.frombuffer(marks, np.uint8)
    for batch in (piece for whole in batches for piece in _pieces(whole, ["text"], SLICE_BYTES)):
        keys = batch.column("text_key")
        lines = [(text or "").split("\n") for text in batch.column("text").to_pylist()]
        counts = np.array([len(x) for x in lines])
        texts = np.repeat(np.arange(len(lines)), counts)
        line_no = np.arange(len(texts)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = (keys.field("low").to_numpy(zero_copy_only=False)[texts] ^ (line_no * _STEP)) & (MARKS - 1)
        hits = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        for start in range(0, len(hits), 4096):
            own = hits[start : start + 4096]
            texts_of, numbers = texts[own], line_no[own]
            column = pa.array([lines[t][i] for t, i in zip(texts_of.tolist(), numbers.tolist())], pa.string())
            sizes, sketches = _sketches(column, size)
            columns = [keys.take(pa.array(texts_of)), pa.array(numbers.astype(np.int32)), column, pa.array(sizes)]
            columns.append(list_column(sketches, np.full(len(own), SKETCH_BITS // 64)))
            yield pa.RecordBatch.from_arrays(columns, names=["text_key", "line_no", "line", "n", "sketch"])


def _marks(wanted: DataFrame) -> bytes:
    """A bit for each of the wanted lines, ``MARKS`` bits however many there are."""
    place = F.col("text_key.low").bitwiseXOR(F.col("line_no").cast("bigint") * F.lit(_STEP)).bitwiseAND(F.lit(MARKS - 1))
    words = wanted.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
    found = words.agg(F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT)))").alias("bits")).toArrow()
    marks = np.zeros(MARKS // 64, np.int64)
    marks[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return marks.tobytes()


def _of_pairs(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a column of lines: (rows, hashes)."""
    parts = []
    for first, data, at in slices(column, 1 << 17):
        own = _Lines(data, at, size)
        parts.append((own.line_of + first, own.hashes))
    rows, hashes = (np.concatenate(x) for x in zip(*parts))
    return _distinct(rows, hashes, len(column))


def _verified(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs ``a, b`` of lines whose Jaccard similarity is large enough."""
    let_go()
    for batch in batches:
        for own in _pieces(batch, ["a_line", "b_line"], PIECE):
            rows, hashes = (np.concatenate(x) for x in zip(*(_of_pairs(own.column(c), size) for c in ("a_line", "b_line"))))
            total = np.bincount(rows, minlength=own.num_rows)
            common = total - np.bincount(_distinct(rows, hashes, own.num_rows)[0], minlength=own.num_rows)
            good = pa.array(common * 100 >= (total - common) * percent)
            yield own.select(["a", "b"]).filter(good)


def _text_key() -> Column:
    """128 bits of doc_id and text, as two hashes with different seeds."""
    parts = (F.col("doc_id").isNull(), F.col("doc_id"), F.coalesce("text", F.lit("")))
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("high"), F.xxhash64(F.lit(2), *parts).alias("low")).alias("text_key")


_TEXT_KEY = "struct<high: bigint, low: bigint>"


def _may_link(percent: int) -> Column:
    """Not ruled out by sizes and sketches: a sketch differs in at most as many bits as its set."""
    a, b = F.col("a_n"), F.col("b_n")
    differing = sum(
        (F.bit_count(F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0)
    )
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (differing * (100 + percent) <= (a + b) * (100 - percent))


def _side(lines: DataFrame, side: str, *columns: str) -> DataFrame:
    return lines.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))


def _exactly(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    return pairs.mapInArrow(partial(_verified, size=size, percent=percent), "a bigint, b bigint")


def _similar(pairs: DataFrame, lines: DataFrame, size: int, percent: int) -> DataFrame:
    pairs = pairs.join(_side(lines, "a", "n", "sketch"), "a").join(_side(lines, "b", "n", "sketch", "line"), "b")
    pairs = pairs.filter(_may_link(percent)).select("a", "b", "b_line")
    return _exactly(pairs.join(_side(lines, "a", "line"), "a"), size, percent)


def _named(members: DataFrame, links: DataFrame) -> DataFrame:
    """``key, id, pivot, of``, ``of`` being the component as far as joined."""
    joined = joined_so_far(links).withColumnRenamed("node", "id")
    return staged(members.join(joined, "id", "left").select("key", "id", "pivot", F.coalesce("component", "id").alias("of")))


def _open(named: DataFrame) -> DataFrame:
    """The rows of the parts that hold several components, with ``largest``, the component of most lines."""
    sizes = named.groupBy("key", "of").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("of", F.struct("n", "of")).alias("largest"), F.count("*").alias("several"))
    return staged(named.join(staged(largest.filter("several > 1").drop("several")), "key"))


def _with_largest(parts: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of each line outside its part's largest component with up to ``PARTNERS`` lines of that.

    Pivots are left out: each line of a part was compared with its pivot before.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(PARTNERS))
    others = parts.filter("id != pivot")
    partners = staged(others.filter("of = largest").groupBy("key", slot.alias("slot")).agg(F.min("id").alias("partner")))
    pairs = others.filter("of != largest").select("key", "id").join(partners, "key")
    return pairs.select(F.least("id", "partner").alias("a"), F.greatest("id", "partner").alias("b")).distinct()


def line_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, text_key, line_no, kept, first_doc_id, first_line_no`` for every line of every text.

    Lines end at line feeds and are numbered from 0.  Two lines link when the Jaccard similarity
    of their character shingles is at least ``percent`` / 100 and they meet in one of ``bands`` bands;
    equal lines always link.  A component keeps its first line by doc_id (nulls first), text and number.  A line
    shorter than a shingle is one shingle; blank lines are left alone: each is kept.  A null text is one
    blank line.  ``text_key`` is a hash of doc_id and text: equal rows count once.

    In a band, lines are first compared with one of those that have most equal copies (by powers of
    two).  Where several components are left in a band, lines outside its largest are compared with a few of that one; then, where
    several are left still, all pairs of different components, by parity sketches that rule out
    nearly all pairs below the similarity, and never one that reaches it.  Lines that do link are few
    components by then, so a band of many near copies does not come to all its pairs.
    """
    texts = docs.select("doc_id", "text", _text_key())
    task = partial(_signed_lines, size=size, bands=bands, rows=rows)
    lines = staged(
        texts.mapInArrow(
            task, f"doc_id bigint, text_key {_TEXT_KEY}, line_no int, one bigint, two bigint, blank boolean, bands array<bigint>"
        )
    )
    place = F.struct("doc_id", "text_key", "line_no")
    classes = lines.filter("NOT blank").groupBy("one", "two").agg(
        F.min(place).alias("at"), F.count("*").alias("copies"), F.first("bands").alias("bands")
    )
    # the more copies a class has (by powers of two), the smaller is its id
    rank = 31 - F.least(F.floor(F.log2("copies")), F.lit(31))
    classes = staged(classes.withColumn("id", rank * F.lit(1 << 57) + F.monotonically_increasing_id()))
    parts = classes.select(F.explode("bands").alias("key"), "id")
    part = Window.partitionBy("key")
    members = parts.select("key", "id", F.min("id").over(part).alias("pivot"), F.max("id").over(part).alias("last"))
    members = staged(members.filter("pivot < last").drop("last"))
    pair = [F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")]
    stars = members.filter("id != pivot").select(*pair).distinct()

    met = classes.select("id", "one", "two", "at").join(members.select("id"), "id", "left_semi")
    met = staged(met)
    wanted = met.select("id", "at.text_key", "at.line_no")
    task = partial(_marked_lines, size=size, marks=_marks(wanted))
    found = texts.select("text_key", "text").mapInArrow(
        task, f"text_key {_TEXT_KEY}, line_no int, line string, n bigint, sketch array<bigint>"
    )
    found = found.join(wanted, ["text_key", "line_no"]).dropDuplicates(["text_key", "line_no"])
    found = staged(found.select("id", "line", "n", "sketch"))

    links = contracted(_similar(stars, found, size, percent), ROUNDS)
    members = _open(_named(members, links))
    links = contracted(links.union(_similar(_with_largest(members), found, size, percent)), ROUNDS)
    open_ = _open(_named(members, links)).filter("id != pivot")  # the pivot was compared with all of its part
    open_ = staged(open_.join(found.select("id", "n", "sketch"), "id"))
    left, right = (_side(open_, side, "key", "of", "n", "sketch") for side in "ab")
    both = (F.col("a_key") == F.col("b_key")) & (F.col("a") < F.col("b")) & (F.col("a_of") != F.col("b_of"))
    rest = left.join(right, both & _may_link(percent)).select("a", "b").distinct()
    for side in "ab":
        rest = rest.join(_side(found, side, "line"), side)
    links = links.union(_exactly(rest, size, percent))

    joined = staged(components(links)).withColumnRenamed("node", "id")
    named = staged(met.join(joined, "id"))
    firsts = staged(named.groupBy("component").agg(F.min("at").alias("first")))
    linked = named.join(firsts, "component").select("one", "two", "first")
    copied = classes.filter("copies > 1").select("id", "one", "two", F.col("at").alias("first")).join(joined, "id", "left_anti")
    of_class = staged(linked.unionByName(copied.drop("id")))
    out = lines.drop("bands").join(of_class, ["one", "two"], "left")
    first = F.when(F.col("blank") | F.col("first").isNull(), place).otherwise(F.col("first"))
    out = out.withColumn("first", first)
    return out.select(
        "doc_id", "text_key", "line_no", (F.col("first") == place).alias("kept"),
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"),
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in (piece for whole in batches for piece in _pieces(whole, ["text"], SLICE_BYTES)):
        texts = []
        for text, dropped in zip(batch.column("text").to_pylist(), batch.column("__dropped").to_pylist()):
            if dropped:
                gone = set(dropped)
                text = "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone)
            texts.append(text)
        kept = batch.drop_columns("__dropped")
        yield kept.set_column(kept.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the lines that :func:`line_components` does not keep, ``n_chars`` renewed.

    Documents that lose lines and keep no sign other than white space are left out; rows that
    repeat both doc_id and text are kept once.  Columns of the input keep their order.
    """
    lines = line_components(docs, **options)
    dropped = lines.filter("NOT kept").groupBy("text_key").agg(F.collect_set("line_no").alias("__dropped"))
    # two whole numbers as keys: a struct read from Parquet is another type than one made here, and the texts would be shuffled twice
    keys = ["__high", "__low"]
    dropped = staged(dropped.select(F.col("text_key.high").alias(keys[0]), F.col("text_key.low").alias(keys[1]), "__dropped"))
    made = _text_key()
    keyed = docs.withColumns({keys[0]: made.getField("high"), keys[1]: made.getField("low")}).join(dropped, keys, "left")
    out = keyed.dropDuplicates(keys).select(*docs.columns, "__dropped")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    was = F.col("__dropped").isNotNull()
    out = out.withColumn("__cut", was).mapInArrow(_without, f"{fields}, `__cut` boolean")
    out = out.filter(~(F.col("__cut") & (F.trim(F.regexp_replace("text", r"\s+", "")) == "")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.drop("__cut")
