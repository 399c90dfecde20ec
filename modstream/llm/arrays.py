"""Batches of texts as byte arrays: words, their hashes, and byte trigrams, without a Python loop over words.

Used inside tasks on Arrow batches; nothing here knows Spark.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (a longer text goes alone).
PIECE = 1_000_000
CHUNK = 1 << 18

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every bit of ``x``."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as long as they are asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, base, dtype=U)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)


class Texts:
    """A batch of texts; null counts as empty. ``first[d]`` to ``first[d + 1]`` are the words of text d."""

    def __init__(self, column: pa.Array, lower: bool = False):
        """``lower``: A-Z become a-z."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        _, offsets, data = column.buffers()
        self.n = len(column)
        self.offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        low, high = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(data, dtype=np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
        self.data = _LOWER[self.data] if lower else self.data
        self.offsets = self.offsets - low
        self.solid = ~BLANK[self.data]
        before = np.zeros(len(self.data), dtype=bool)
        before[1:] = self.solid[:-1]
        before[self.offsets[:-1][self.offsets[:-1] < len(self.data)]] = False
        self.starts = np.flatnonzero(self.solid & ~before)
        after = np.zeros(len(self.data), dtype=bool)
        after[:-1] = self.solid[1:]
        after[self.offsets[1:][self.offsets[1:] > 0] - 1] = False
        self.ends = np.flatnonzero(self.solid & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.counts)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return np.diff(sums[self.offsets])

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        out = np.empty(len(self.starts), dtype=U)
        i = 0
        while i < len(out):
            low = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, low + CHUNK, side="right")))
            high = self.ends[j - 1]
            up, down = _BYTES(int(high - low) + 1)
            sums = np.zeros(int(high - low) + 1, dtype=U)
            np.cumsum(_BYTE[self.data[low:high]] * up[:-1], dtype=U, out=sums[1:])
            a, b = self.starts[i:j] - low, self.ends[i:j] - low
            out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U))
            i = j
        return out


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on, for all words that have n - 1 after them (in the whole batch)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U)
    up, down = _WORDS(len(hashes))
    sums = np.zeros(len(hashes) + 1, dtype=U)
    np.cumsum(hashes * up, dtype=U, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[:m])


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words from ``starts`` to ``ends``, exclusive."""
    up, down = _WORDS(max(1, len(hashes)))
    sums = np.zeros(len(hashes) + 1, dtype=U)
    np.cumsum(hashes * up[: len(hashes)], dtype=U, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and the next one may be of another kind."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each ``n`` neighbours, by doubling."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of ``batches`` of up to ``size`` bytes of text."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        i = 0
        while i < batch.num_rows:
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(i, j - i)
            i = j


# Byte trigrams. Bytes fall into 64 classes, so there are at most 64^3 trigrams: 0 is the edge of a word, then letters
# without case, digits, other ASCII, and folded parts of longer characters.
CLASSES = 64
_CODE = np.arange(256)
BYTE_CLASS = np.select(
    [BLANK, (_CODE >= 0x61) & (_CODE <= 0x7A), (_CODE >= 0x41) & (_CODE <= 0x5A), (_CODE >= 0x30) & (_CODE <= 0x39), _CODE < 0x80, _CODE < 0xC0],
    [0, _CODE - 0x60, _CODE - 0x40, 27, 28 + _CODE % 8, 36 + _CODE % 16],
    52 + _CODE % 12,
).astype(np.int32)


class WordTypes:
    """The different words of a batch: ``inverse`` leads from each word to its type."""

    def __init__(self, texts: Texts, key: np.ndarray | None = None):
        """``key``: a number for each word; words of different numbers are different types."""
        hashes = texts.hashes()
        if key is not None:
            hashes = mix(hashes + key.astype(U) * U(0x9E3779B97F4A7C15))
        _, self.index, self.inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.texts = texts

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Packed byte trigrams of all types, one for each byte and one for each end, and where each type's begin."""
        starts, sizes = self.texts.starts[self.index], self.texts.ends[self.index] - self.texts.starts[self.index]
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - starts, sizes + 1)
        at[bounds[1:] - 1] = 0
        c = BYTE_CLASS[self.texts.data[at]] if len(at) else np.zeros(0, np.int32)
        c[bounds[1:] - 1] = 0
        c1, c2 = np.zeros_like(c), np.zeros_like(c)
        c1[1:], c2[2:] = c[:-1], c[:-2]
        c2[c1 == 0] = 0
        return (c2 << 12) | (c1 << 6) | c, bounds


class CharGrams:
    """The ``n``-grams of characters of a batch of texts: words joined by one blank, with n - 1 blanks in front; one for each character.

    ``keys`` are their 64-bit hashes, salted by a number for each text; ``owner`` the text of each.
    """

    def __init__(self, texts: list[str], salts: np.ndarray, n: int):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(texts)), sizes)
        blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
        solid = np.flatnonzero(~blank)
        # A blank stays if it follows a character of its text and is not behind the last one.
        last = np.full(len(texts), -1, dtype=np.int64)
        last[owner[solid]] = solid
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1] & (owner[1:] == owner[:-1]) & (np.arange(1, len(codes)) < last[owner[1:]])
        at = np.flatnonzero(keep)
        self.owner = owner[at]
        place = np.arange(len(at)) + (n - 1) * (self.owner + 1)
        self.codes = np.full(len(at) + (n - 1) * (len(texts) + 1), 0x20, dtype=np.uint32)
        self.codes[place] = np.where(blank[at], 0x20, codes[at])
        self.place, self.n, self.sizes = place, n, np.bincount(self.owner, minlength=len(texts)).astype(np.int64)
        spread = mix(self.codes.astype(U) + U(1))
        sums = np.zeros(len(at), dtype=U)
        for k in range(n - 1, -1, -1):
            sums = sums * U(0x9E3779B97F4A7C15) + spread[place - k]
        self.keys = mix(sums + salts[self.owner])

    def code_points(self, which: np.ndarray) -> np.ndarray:
        """The n-grams at these indexes, a row each."""
        return self.codes[self.place[which][:, None] - np.arange(self.n - 1, -1, -1)]


def strings_of(codes: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    data = np.ascontiguousarray(codes).tobytes().decode("utf-32-le").encode()
    sizes = (1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).sum(axis=1)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(data)])
