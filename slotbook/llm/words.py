"""Words and word hashes of Arrow text batches, as numpy arrays.

A word is a maximal run of bytes that a 256-entry table marks; every separator
used here is ASCII, so bytes and characters give the same words.  Everything
below works on a slice of rows of bounded size (a single text may be longer).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64

_SPACE = [0x20, *range(0x09, 0x0E)]
#: words ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, bool)
SPACED[_SPACE] = False
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (of lower-cased text)
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

SLICE_BYTES = 4 << 20
SMALL_SLICE = 256 << 10  # for steps that hold many arrays a word and take rows one by one
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U)
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> U(30))
    x = x * _M2
    x ^= x >> U(27)
    x *= _M3
    x ^= x >> U(31)
    return x


def slices(batches, text: str, max_bytes: int = SLICE_BYTES):
    """Yield (rows, buf, off): row slices of about ``max_bytes`` of text, the
    text bytes and the ``len(rows) + 1`` offsets into them.  Null text is empty."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        arr = batch.column(batch.schema.get_field_index(text))
        if arr.null_count:
            arr = arr.fill_null("")
        kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
        off = np.frombuffer(arr.buffers()[1], kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
        data = arr.buffers()[2]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(arr):
            j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
            yield batch.slice(i, j - i), buf[off[i]:off[j]], off[i:j + 1] - off[i]
            i = j


def spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray = SPACED):
    """(starts, ends, word_off): byte ranges of all words, and each row's range of words."""
    w = table[buf]
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    first = w.copy()
    first[1:] &= ~w[:-1]
    cut = off[(off < n)]
    first[cut] = w[cut]
    last = w.copy()
    last[:-1] &= ~w[1:]
    cut = off[(off > 0)] - 1
    last[cut] = w[cut]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    size = ends - starts
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", pad, strides=(1,))  # the 8 bytes from each place on

    def chunk(at, left):
        return eight[at] & _MASK[np.minimum(left, 8)]

    h = mix(size.astype(U) * _M1 ^ chunk(starts, size)) if len(starts) else np.zeros(0, U)
    rest, at = np.flatnonzero(size > 8), 8
    while len(rest):
        left = size[rest] - at
        part = chunk(np.minimum(starts[rest] + at, len(buf)), left)
        h[rest] = mix(h[rest] * _M1 + part)
        at += 8
        rest = rest[left > 8]
    return h


class Prefix:
    """Hashes of word windows from prefix sums of ``hash * base**i`` mod 2**64."""

    _powers: dict = {}

    def __init__(self, h: np.ndarray, which: int = 0):
        up, self.down = self._table(which, len(h) + 1)
        self.sums = np.zeros(len(h) + 1, U)
        np.cumsum(h * up[:len(h)], out=self.sums[1:])

    @classmethod
    def _table(cls, which: int, n: int):
        have = cls._powers.get(which)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 16)
            base = _BASES[which]
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, U)
                p[0] = 1
                both.append(np.cumprod(p, dtype=U))
            have = cls._powers[which] = tuple(both)
        return have

    def window(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes of the word ranges [i, j)."""
        return mix((self.sums[j] - self.sums[i]) * self.down[i] + (j - i).astype(U) * _M1)


def starts_of(word_off: np.ndarray, size: int) -> np.ndarray:
    """Start of every window of ``size`` words that lies inside one row."""
    count = np.maximum(np.diff(word_off) - size + 1, 0)
    return ranges(word_off[:-1], count)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of start[k] .. start[k] + count[k] - 1."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of ``schema`` from arrays by name."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
