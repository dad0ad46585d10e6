"""Words of whole texts as numpy arrays, for the Arrow-batched operators.

A batch of texts is one run of UTF-8 bytes with offsets (the Arrow buffers themselves), so
words, lines and their 64-bit hashes come from a few vectorised passes and no Python loop
over words. Batches are cut into slices of about ``SLICE_BYTES`` whole texts, which bounds
the memory of a task whatever the batch size; one longer text is a slice of its own."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}

#: Words are runs of these bytes; every byte of a non-ASCII character is >= 0x80.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
EXACT = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        for key, base in (("p", _P), ("i", _PINV)):
            a = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            a[0] = 1
            _POW[key] = np.cumprod(a)
    return _POW["p"], _POW["i"]


class Texts:
    """Some whole texts: ``data`` (bytes) and ``offs`` (start of each text, then the end)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    def words(self, is_word: np.ndarray = NONSPACE) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each word, in order; words never span two texts."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = is_word[self.data]
        first, last = m.copy(), m.copy()
        first[1:] &= ~m[:-1]
        last[:-1] &= ~m[1:]
        lo, hi = self.offs[:-1], self.offs[1:]
        full = hi > lo
        first[lo[full]] = m[lo[full]]
        last[hi[full] - 1] = m[hi[full] - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
        """A 64-bit hash of each byte range, after ``fold`` of every byte."""
        n = len(self.data)
        p, inv = _powers(n + 1)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum((fold[self.data].astype(np.uint64) + np.uint64(1)) * p[:n], out=c[1:])
        return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * _PINV)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """Number of the text that each byte position lies in."""
        return np.searchsorted(self.offs, at, side="right") - 1


def texts_of(column: pa.Array) -> Texts:
    """The texts of an Arrow string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None and \
        column.buffers()[2].size else np.zeros(0, np.uint8)
    return Texts(data[offs[0]:offs[-1]], offs - offs[0])


#: What a worker keeps for the next task of the same operator, by operator.
HELD: dict[str, object] = {}


def give_back() -> None:
    """Gives free memory back to the system: a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES, keep: str = "") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Batches again, cut into slices of whole texts of about ``size`` bytes each. What another operator than ``keep`` left in the
    worker goes first."""
    others = [x for x in HELD if x != keep]
    for other in others:
        del HELD[other]
    if others:
        give_back()
    for batch in batches:
        t = texts_of(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < t.n:
            hi = max(lo + 1, int(np.searchsorted(t.offs, t.offs[lo] + size, side="right")) - 1)
            yield batch.slice(lo, hi - lo), Texts(t.data[t.offs[lo]:t.offs[hi]], t.offs[lo:hi + 1] - t.offs[lo])
            lo = hi
        del batch, t
    give_back()


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive entries (one per start; also across texts: mask those)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * _P + h[j:j + n]
    return mix(out)


def counts_per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, n).astype(np.int64)[:n] if len(owner) else np.zeros(n, np.int64)
