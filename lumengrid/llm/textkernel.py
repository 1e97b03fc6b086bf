"""Vectorised passes over the UTF-8 bytes of a text column.

A batch is cut into chunks of a few MB, so that the temporaries of a pass stay small whatever the size of
the batch; a single longer text makes a chunk of its own. Nulls count as empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: [\x20\x09-\x0D] separate words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Keeps so many low bytes of a number; longer words than LONG bytes are hashed one by one.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
LONG = 64

_powers: dict[str, np.ndarray] = {}


class Chunk(NamedTuple):
    """Rows lo to hi of a batch: their bytes, one after the other, and where each row begins (one more for the end)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Byte ranges of words, and the first word of each row (one more for the end)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n - 1 of BASE or its inverse modulo 2**64; the longest table of up to 4 MB of text is kept."""
    name = "inverse" if inverse else "base"
    have = _powers.get(name)
    if have is None or len(have) < n:
        table = np.full(n, BASE_INVERSE if inverse else BASE, dtype=np.uint64)
        table[:1] = 1
        table = np.multiply.accumulate(table)
        if n > 2 * CHUNK_BYTES:
            return table
        _powers[name] = have = table
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums s such that range_hash() finds the hash of any range of values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:], dtype=np.uint64)
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of values[starts:ends], which depend on the values and their number alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = (sums[ends] - sums[starts]) * powers(len(sums), True)[starts]
    return mix(mix(h + np.uint64(seed)) ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(chunk: Chunk) -> Words:
    data, offsets = chunk.data, chunk.offsets
    if not len(data):
        return Words(*[np.zeros(0, np.int64)] * 2, np.zeros(len(offsets), np.int64))
    inside = ~IS_SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    at = offsets[:-1][full]
    begin[at] = inside[at]
    at = offsets[1:][full] - 1
    end[at] = inside[at]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, with zeros behind the end; a view, nothing is copied but the bytes."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,))


def word_hashes(chunk: Chunk, w: Words, lower: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words, mixed eight bytes at a time, so that no pattern of letters cancels out; another seed, another hash."""
    data = LOWER[chunk.data] if lower else chunk.data
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    size, eight = w.ends - w.starts, eights(data)
    h = mix(size.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
    h = mix(h ^ eight[w.starts] & _LOW[np.minimum(size, 8)])
    who = np.flatnonzero((size > 8) & (size <= LONG))
    for k in range(8, LONG, 8):
        if not len(who):
            break
        h[who] = mix(h[who] ^ eight[w.starts[who] + k] & _LOW[np.minimum(size[who] - k, 8)])
        who = who[size[who] > k + 8]
    for k in np.flatnonzero(size > LONG):
        word = data[w.starts[k] : w.ends[k]].tobytes()
        h[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return h


def window_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of size words (few: the sums are modulo 2**64), over row limits too; a caller leaves those out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return range_hash(prefix(hashes), at, at + size, seed)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
