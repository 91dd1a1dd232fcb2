"""Vectorised word and shingle kernels over Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+``; only A-Z are lower-cased. A null text counts as empty.
Words and shingles are represented by 64-bit hashes computed for a whole slice of a
batch at once; texts are cut into slices of whole documents so that working memory
follows ``SLICE_BYTES`` and the longest single document, not the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPACE_OR_MARK = _SPACE.copy()
_SPACE_OR_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(salt)) | np.uint64(1)


@dataclass
class Slice:
    """Some whole documents: ``first`` is the row of the batch that ``doc == 0`` stands for."""

    first: int
    n_docs: int
    data: np.ndarray  # bytes, lower-cased
    start: np.ndarray  # of each word, into data
    end: np.ndarray
    doc: np.ndarray  # of each word, ascending

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hash of every word, or of its first ``prefix`` bytes."""
        n = len(self.data)
        if len(_powers[0]) <= n:
            for i, base in enumerate((_BASE, _BASE_INVERSE)):
                p = np.full(max(n + 1, SLICE_BYTES), base, np.uint64)
                p[0] = 1
                _powers[i] = np.multiply.accumulate(p)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=sums[1:])
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        return mix((sums[end] - sums[self.start]) * _powers[1][self.start])


def slices(texts: pa.Array, marks: bool = True) -> Iterator[Slice]:
    """The batch's texts, in order, as slices of whole documents; without ``marks``, ASCII punctuation counts as white space."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE_BYTES, side="right")) - 1)
        hi = min(hi, len(texts))
        yield _slice(lo, everything[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], _SPACE if marks else _SPACE_OR_MARK)
        lo = hi


def _slice(first: int, data: np.ndarray, offs: np.ndarray, space: np.ndarray) -> Slice:
    inside = ~space[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    if n:
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(offs, start, side="right") - 1
    return Slice(first, len(offs) - 1, _LOWER[data], start, end, doc)


def shingles(s: Slice, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word position in the slice, hash) of each run of ``size`` words of a document.

    A document of 1 to ``size - 1`` words has one shingle, its whole sequence; an empty one none.
    """
    h, n = s.hashes(), s.counts()
    by = seeds(size + 1, salt=size)
    total = len(h)
    first = np.cumsum(n) - n
    out = np.zeros(max(0, total - size + 1), np.uint64)
    for j in range(size):
        out += h[j : j + len(out)] * by[j]
    at = np.flatnonzero(s.doc[: len(out)] == s.doc[size - 1 :]) if len(out) else np.zeros(0, np.int64)
    docs, hashes = s.doc[at], mix(out[at])
    if len(short := np.flatnonzero((n > 0) & (n < size))):
        whole = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = n[short] > j
            whole[has] += h[first[short[has]] + j] * by[j]
        whole = mix(whole + n[short].astype(np.uint64) * by[size])
        docs, at, hashes = np.concatenate([docs, short]), np.concatenate([at, first[short]]), np.concatenate([hashes, whole])
        order = np.argsort(docs, kind="stable")
        docs, at, hashes = docs[order], at[order], hashes[order]
    return docs, at, hashes


def distinct_shingles(s: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash), distinct, sorted by document and hash."""
    docs, _, hashes = shingles(s, size)
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    keep = np.ones(len(docs), bool)
    keep[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[keep], hashes[keep]


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same, but memory that the task has freed goes back to the system: workers live on between tasks, beside the executor's heap."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
