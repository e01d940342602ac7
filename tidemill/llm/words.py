"""Vectorised words: tokenising and hashing whole Arrow batches of text with numpy.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. In UTF-8 every byte of a longer
character is above 0x7F, so working on bytes gives exactly the words of the code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of text handled at a time; bounds the temporary arrays (about 30 times as large).
CHUNK = 1 << 19

_POS = 64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(0, 2**64, size=_POS * 256, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**64, size=4096, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Some consecutive texts of a batch: their bytes, and for each word its bounds and text."""

    first: int  # row in the batch of the first text
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than texts
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # row in the chunk, for each word

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def word_bounds(self) -> np.ndarray:
        """For each text the index of its first word; one more at the end."""
        return np.searchsorted(self.doc, np.arange(self.n + 1))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, size: int = CHUNK, lower: bool = False) -> Iterator[Chunk]:
    """The texts of a column in pieces of about `size` bytes (a longer text is one piece)."""
    raw, offsets = texts_of(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        data = raw[offsets[at] : offsets[to]]
        yield split(at, LOWER[data] if lower else data, offsets[at : to + 1] - offsets[at])
        at = to


def split(first: int, data: np.ndarray, offsets: np.ndarray) -> Chunk:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Chunk(first, data, offsets, none, none, none)
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Chunk(first, data, offsets, starts, ends, np.searchsorted(offsets, starts, side="right") - 1)


def hash_words(c: Chunk) -> np.ndarray:
    """A 64-bit hash of each word: tabulation over (position, byte), then a finaliser."""
    if not len(c.starts):
        return np.zeros(0, np.uint64)
    lens = c.ends - c.starts
    at = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=at[1:])
    body = c.data[~SPACE[c.data]]
    pos = np.arange(at[-1], dtype=np.int64) - np.repeat(at[:-1], lens)
    val = _TABLE[((pos & (_POS - 1)) << 8) | body]
    if lens.max() > _POS:
        far = np.flatnonzero(pos >= _POS)
        val[far] = mix(val[far] * _ODD[(pos[far] >> 6) & 4095] + (pos[far] >> 18).astype(np.uint64))
    h = np.add.reduceat(val, at[:-1])
    return mix(h + lens.astype(np.uint64) * _ODD[4095])


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside one text, and the index of each one's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        acc += h[j : j + m] * _ODD[j]
    at = np.flatnonzero(doc[:m] == doc[n - 1 : n - 1 + m])
    return mix(acc[at]), at


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for each of n places that lies in one of the spans [start, end)."""
    d = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(d)[:n] > 0
