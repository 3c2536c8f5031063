"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can be the last of its encoding.  An
automaton over the vocabulary lists the tokens that end at each byte, longest first; a token
is the one if its encoding together with the last token of the prefix before it is just
these two.  Back-pointers from the end give the ids.

Two tokens stay apart when no merge across their border comes before the merges that build
them.  Only the pieces that touch the border matter: the right edge of the first token and
the left edge of the second as they grow, in order of merge rank.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import repeat
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tablevet.llm.textcodes import held, list_column, slices

#: Fixed value: how the vocabulary's texts are cut before merging; alternatives that begin
#: with different characters may come in any order.
PIECES = regex.compile(
    r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?[^\p{White_Space}\p{L}\p{N}]+| ?\p{N}+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CACHED_WORDS = 250_000
_NEVER = 1 << 40


def _byte_of_char() -> dict[str, int]:
    """The vocabulary file writes printable bytes as themselves, the others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file, with its encoder.

    Words and token pairs that were met are kept in caches of bounded size.
    """

    def __init__(self, source: bytes, cached_words: int = CACHED_WORDS):
        self.most_words, self.most_pairs = cached_words, 2 * cached_words
        spec = json.loads(source)
        byte_of = _byte_of_char()
        raw = {"".join(chr(byte_of[c]) for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[int, int] = {}  # of the merge of two tokens, by left << 32 | right
        self.parts: dict[int, tuple[int, int, int]] = {}  # rank, left and right of the merge that makes a token
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            left, right = ("".join(chr(byte_of[c]) for c in t) for t in (left, right))
            a, b, whole = raw[left], raw[right], raw[left + right]
            self.rank.setdefault(a << 32 | b, rank)
            self.parts.setdefault(whole, (rank, a, b))
        self.endings = ahocorasick.Automaton()
        for text, i in raw.items():
            if len(text) == 1 or i in self.parts:
                self.endings.add_word(text, (i, len(text), {}))
        self.endings.make_automaton()
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size_of = {i: len(text) for text, i in raw.items()}
        self.after = [known for _, _, known in self.endings.values()]  # by second token: whether it may follow a first one
        self.known_pairs = 0
        self.piece_ids = lru_cache(cached_words)(self._packed_piece)
        self.words: dict[str, bytes] = {}  # ids of a space and the word, four bytes each
        self.older: dict[str, bytes] = {}
        self.edges: dict[int, tuple[list, list]] = {}

    def _edges(self, token: int) -> tuple[list, list]:
        """The token's left and right edge as it grows: (piece, rank at which it is merged on)."""
        found = self.edges.get(token)
        if found is None:
            found = ([], [])
            for side in (0, 1):
                piece, until = token, _NEVER
                while True:
                    found[side].append((piece, until))
                    if piece not in self.parts:
                        break
                    until, *halves = self.parts[piece]
                    piece = halves[side]
                found[side].reverse()
            self.edges[token] = found
        return found

    def _apart(self, first: int, second: int) -> bool:
        left, right = self._edges(first)[1], self._edges(second)[0]
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = left[i], right[j]
            across = self.rank.get(a << 32 | b, _NEVER)
            if across < a_until and across <= b_until and across != _NEVER:
                return False  # of equal ranks the leftmost pair is merged first
            if a_until == b_until == _NEVER:
                return True
            if a_until <= b_until:
                i += 1
            if b_until <= a_until:
                j += 1

    def compatible(self, first: int, second: int, known: dict[int, bool]) -> bool:
        if self.known_pairs >= self.most_pairs:
            for own in self.after:
                own.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        fits = known[first] = self._apart(first, second)
        return fits

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece if piece.isascii() else piece.encode().decode("latin-1")
        size = len(raw)
        last, done = [0] * size, -1  # the last token of every prefix
        for at, (token, length, known) in self.endings.iter(raw):
            if at == done:
                continue
            start = at - length
            if start >= 0:
                before = last[start]
                fits = known.get(before)
                if not (self.compatible(before, token, known) if fits is None else fits):
                    continue
            last[at], done = token, at
        ids, end, size_of = [], size - 1, self.size_of
        while end >= 0:
            ids.append(token := last[end])
            end -= size_of[token]
        ids.reverse()
        return ids

    def _packed_piece(self, piece: str) -> bytes:
        ids = self.encode_piece(piece)
        return pack(f"{len(ids)}i", *ids)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece_ids, PIECES.findall(text)))

    def _learn(self, words: list[str]) -> bool:
        """Take the words into the cache; false if one of them is not cut off by single spaces."""
        for word in set(words).difference(self.words):
            ids = self.older.get(word)
            if ids is None:
                if not word or word[0].isspace() or word[-1].isspace():
                    return False
                ids = self.piece_ids(" " + word) if word.isascii() and word.isalpha() else self._pieces(" " + word)
            self.words[word] = ids
        return True

    def _ids(self, text: str) -> bytes:
        """A piece never goes on over a space that has other signs on both sides."""
        head, *words = text.split(" ")
        if words and (not head or head[-1].isspace()):
            return self._pieces(text)
        if len(self.words) > self.most_words:
            self.words, self.older = {}, self.words
        if not self._learn(words):
            return self._pieces(text)
        return self._pieces(head) + b"".join(map(self.words.__getitem__, words))

    def packed(self, text: str) -> bytes:
        """Ids of a text, four bytes each; the strings of special tokens are those tokens."""
        if self.marks is None or not any(map(text.__contains__, self.special)):
            return self._ids(text)
        return b"".join(pack("i", self.special[x]) if x in self.special else self._ids(x) for x in self.marks.split(text))

    def encode(self, text: str) -> list[int]:
        """Ids of a text as :meth:`packed` gives them."""
        return np.frombuffer(self.packed(text), np.int32).tolist()


def token_bytes(source: bytes) -> dict[int, bytes]:
    """The bytes of every token of a vocabulary file; a special token is its text."""
    spec, byte_of = json.loads(source), _byte_of_char()
    out = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    return out | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def decode_ids(ids: list[int], bytes_of: dict[int, bytes]) -> str:
    """Text of a list of ids, special tokens included; broken UTF-8 gives U+FFFD."""
    return b"".join(map(bytes_of.get, ids, repeat(b""))).decode("utf-8", "replace")


def _encode(
    batches: Iterator[pa.RecordBatch], source: bytes, cached_words: int, decoded: bool = False
) -> Iterator[pa.RecordBatch]:
    vocabulary, bytes_of = held(("encode", source, cached_words), lambda: (Vocabulary(source, cached_words), token_bytes(source)))
    for batch in batches:
        rest = batch.drop_columns("text")
        for first, data, at in slices(batch.column("text")):
            raw, cuts = data.tobytes(), at.tolist()
            rows = [vocabulary.packed(raw[a:b].decode()) for a, b in zip(cuts, cuts[1:])]
            ids = np.frombuffer(b"".join(rows), np.int32)
            own = rest.slice(first, len(rows))
            columns, names = [*own.columns, list_column(ids, np.array([len(r) // 4 for r in rows]))], [*own.schema.names, "ids"]
            if decoded:
                columns.append(pa.array([decode_ids(np.frombuffer(r, np.int32).tolist(), bytes_of) for r in rows], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _decode(batches: Iterator[pa.RecordBatch], source: bytes) -> Iterator[pa.RecordBatch]:
    bytes_of = held(("decode", source), lambda: token_bytes(source))
    for batch in batches:
        column = batch.column("ids")
        for first in range(0, batch.num_rows, 256):
            own = batch.slice(first, 256)
            texts = pa.array([decode_ids(ids or [], bytes_of) for ids in column.slice(first, 256).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*own.columns, texts], names=[*own.schema.names, "decoded"])


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: bytes, cached_words: int = CACHED_WORDS) -> DataFrame:
    """``docs`` with ``ids array<int>`` in place of ``text``: its exact encoding, special tokens parsed.

    ``vocabulary`` is the content of a vocabulary file (:func:`read_vocabulary`), of a size that is
    fixed by the file.  A null text counts as empty and has no ids.  Every row is encoded
    on its own, so repeated rows give repeated results.  A worker keeps the ids of up to
    three times ``cached_words`` words and pieces, about 250 bytes each.  A column ``ids`` of the input is replaced.
    """
    kept = docs.drop("ids")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    return kept.mapInArrow(partial(_encode, source=vocabulary, cached_words=cached_words), f"{fields}, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: bytes, cached_words: int = CACHED_WORDS) -> DataFrame:
    """:func:`encode` followed by :func:`decode`, in one pass."""
    kept = docs.drop("ids", "decoded")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    task = partial(_encode, source=vocabulary, cached_words=cached_words, decoded=True)
    return kept.mapInArrow(task, f"{fields}, ids array<int>, decoded string")


def decode(encoded: DataFrame, vocabulary: bytes) -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ``ids``; null or no ids give an empty text."""
    kept = encoded.drop("decoded")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(partial(_decode, source=vocabulary), f"{fields}, decoded string")


def with_digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of an encoded and decoded table."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
