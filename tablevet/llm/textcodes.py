"""Texts of an Arrow batch as byte arrays: slices of bounded size, word hashes, byte grams.

Everything here works on one batch inside one task.  A slice holds at most ``SLICE_BYTES`` of
text, or a single text that is longer than that.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_held: dict = {}


def let_go() -> None:
    """Drop what earlier tasks of other operators left in this worker, and give the memory back.

    Every task function begins with this or with :func:`held`: workers outlive their tasks, and
    what one operator held would otherwise be carried through the next.
    """
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def held(name: object, build: Callable):
    """A large object that a worker keeps between tasks; asking for another one lets it go."""
    if name not in _held:
        let_go()
        _held[name] = build()
    return _held[name]


_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every output bit depends on every input bit."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SYMBOL = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=1)
def _slice_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, SLICE_BYTES), _powers(_INVERSE, SLICE_BYTES)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if n > SLICE_BYTES:
        return _powers(_BASE, n), _powers(_INVERSE, n)
    return _slice_powers()


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its texts; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def slices(column: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) for runs of texts of at most ``budget`` bytes."""
    raw, at = text_arrays(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + budget, side="right")) - 1)
        yield row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the factors that move a piece to position 0."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOL[data] * up[: len(data)], out=sums[1:])
    return sums, down


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice's texts, A-Z as a-z, and the texts' offsets among them."""
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    inner = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that begin no character
    lower = ((chars - np.uint32(65)) < 26).astype(np.uint32) << np.uint32(5)
    return chars + lower, at - np.searchsorted(inner, at)


def blanks(chars: np.ndarray) -> np.ndarray:
    return (chars == 32) | ((chars - np.uint32(9)) < 5)


_CHARACTER = mix(np.arange(1 << 16, dtype=np.uint64))


def character_hash(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`prefix_hash`, over code points."""
    signs = _CHARACTER[chars & 0xFFFF]
    if len(chars) and chars.max() >> 16:
        signs ^= (chars >> 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    up, down = powers(len(chars))
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(signs * up[: len(chars)], out=sums[1:])
    return sums, down


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts of a slice, and each text's first word.

    A word is a run of bytes other than ASCII white space; A-Z count as a-z.
    """
    data = LOWER[data]
    inside = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.r_[inside[1:], False]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    sums, down = prefix_hash(data)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of the whole sequence if it has fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out ^ words[i : i + n])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column of ``len(counts)`` rows that share out ``values`` in order."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch of lists holds more values than Arrow offsets can count")
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _crc32_steps() -> list[int]:
    """The 256 steps of the reflected CRC-32 with polynomial 0xEDB88320."""
    steps = list(range(256))
    for _ in range(8):
        steps = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in steps]
    return steps


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a string's UTF-8 bytes, for the SQL that queries are held against."""
    digits = f"upper(hex(encode({text})))"
    byte = "(instr('0123456789ABCDEF', substr({0}, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr({0}, 2 * i + 2, 1)) - 1"
    data = f"list_transform(range(0, strlen({text})), lambda i: CAST({byte.format(digits)} AS BIGINT))"
    step = f"xor(c >> 8, ({_crc32_steps()})[xor(c & 255, b) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: {step}), 4294967295)"
