"""Whitening of embeddings: components of their covariance by cyclic Jacobi rotations, to accurate small eigenvalues.

Entries are put on a grid of 1/64: x = floor(64 * c) + 1000000, as long. Each distinct vector of x counts once: they are the fit list, whose size and sums
are exact. Tasks multiply what they hold of it, centred first, and their scatter matrices (of the dimension's size) are added up entry by entry. The driver rotates the
covariance until nothing is left beside its diagonal, every pair of dimensions once a sweep, disjoint pairs at once; unit eigenvectors, by falling eigenvalue and over its
root, make the whitening matrix, which is broadcast (at most the dimension squared) and applied to every row.

Defined results: rows whose vector is null or has null, NaN or infinite entries have no result, nor those whose length isn't the table's most frequent (of equally frequent ones
the longest; an empty vector is none). Entries beyond 2^40 / 64 are taken as that. Repeated rows get a result each; a null id stays. A deviation that a long can't hold is null. A component
without variance (eigenvalue at most 1e-12 of the largest, as where there are fewer distinct vectors than dimensions) has null for ``whitened`` and stays out of the
identity error. Empty tables give no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import Scratch

SCALE, SHIFT = 64.0, 1_000_000
FURTHEST = 2.0**40
COMPONENTS = 16
FLAT = 1e-12
SLAB = 2048  # vectors multiplied at once


def on_grid(vectors: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a vector of finite entries (of length ``dim``, if given, else of any), and these on the grid: (rows, x), x flat."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()  # without null lists
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    c = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(size)), size)
    broken = np.bincount(owner, weights=missing | ~np.isfinite(c), minlength=len(size)) > 0
    good = ~broken & (size == dim if dim is not None else size > 0)
    x = np.floor(np.clip(c[good[owner]] * SCALE, -FURTHEST, FURTHEST)).astype(np.int64) + SHIFT
    return np.flatnonzero(good), x


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by cyclic Jacobi rotations in rounds of disjoint pairs.

    A pair is rotated unless its entry is negligible beside the two diagonal ones, so that small eigenvalues of a positive matrix keep their digits.
    """
    n = len(a)
    a, v = a.astype(np.float64).copy(), np.eye(n)
    ring = list(range(n + n % 2))  # an odd dimension rests one a round
    for _ in range(sweeps):
        rotated = False
        for _ in range(len(ring) - 1):
            pairs = [(min(p), max(p)) for p in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :]), strict=True)]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = (np.array(x) for x in zip(*[x for x in pairs if x[1] < n] or [(0, 0)], strict=True))
            off = a[p, q]
            keep = (p != q) & (np.abs(off) > 1e-17 * np.sqrt(np.abs(a[p, p] * a[q, q]))) & (off != 0)
            if not keep.any():
                continue
            rotated = True
            p, q, off = p[keep], q[keep], off[keep]
            theta = (a[q, q] - a[p, p]) / (2.0 * off)
            with np.errstate(over="ignore"):
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.sqrt(theta * theta + 1.0))
            c = 1.0 / np.sqrt(t * t + 1.0)
            s = t * c
            dp, dq = a[p, p] - t * off, a[q, q] + t * off
            for m in (a, v):
                mp, mq = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * mp - s * mq, s * mp + c * mq
            rp, rq = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * rp - s[:, None] * rq, s[:, None] * rp + c[:, None] * rq
            a[p, p], a[q, q], a[p, q], a[q, p] = dp, dq, 0.0, 0.0
        if not rotated:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


@dataclass
class Whitening:
    """``n`` vectors with sums ``total``; eigenvalues, falling, and eigenvectors in columns; ``error``: of the identity, None without components."""

    dim: int
    n: int
    total: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    error: float | None = None

    def matrix(self, components: int) -> np.ndarray:
        """Centred rows times this are whitened; NaN where a component has no variance."""
        e = self.values[:components]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(e > FLAT * max(self.values[0], 0.0), self.vectors[:, :components] / np.sqrt(np.maximum(e, 0.0)), np.nan)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - total / n, from whole numbers where they fit a double."""
        base = self.total // self.n
        return (x - base).astype(np.float64) - ((self.total - base * self.n) / self.n)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - total)^2, exact; None beyond a long."""
        gap = x - self.total // self.n  # n * gap - rest, the rest being under n
        rest = self.total - (self.total // self.n) * self.n
        if self.n * (float(np.abs(gap).max(initial=0)) + 1.0) < 2.0**31 / np.sqrt(max(self.dim, 1)):
            return ((self.n * gap - rest) ** 2).sum(axis=1).tolist()
        squares = self.n * self.n * _exact(gap, gap) - 2 * self.n * _exact(gap, np.broadcast_to(rest, gap.shape)) + int(sum(int(r) * int(r) for r in rest))
        return [d if d < 1 << 63 else None for d in squares]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row sums of products, as Python's whole numbers: factors are cut in halves of 21 bits, whose products' sums fit a long."""
    out = np.zeros(len(a), object)
    cut = 21
    for i, x in enumerate((a & ((1 << cut) - 1), (a >> cut) & ((1 << cut) - 1), a >> (2 * cut))):
        for j, y in enumerate((b & ((1 << cut) - 1), (b >> cut) & ((1 << cut) - 1), b >> (2 * cut))):
            out += (x * y).sum(axis=1).astype(object) * (1 << (cut * (i + j)))
    return out


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The entry-wise sum of rows of (row, entries), a matrix of ``size`` columns; it is as large as the dimension squared."""
    total = parts.select("row", F.posexplode("entries").alias("column", "entry")).groupBy("row", "column").agg(F.sum("entry").alias("entry"))
    out: dict[int, np.ndarray] = {}
    for r in total.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("column", "entry"))).alias("entries")).collect():
        out[r["row"]] = np.array([e["entry"] for e in r["entries"]], np.float64)
    return np.array([out[i] for i in sorted(out)]).reshape(-1, size)


def _scatter(fit: DataFrame, w: Whitening, by: np.ndarray | None) -> np.ndarray:
    """The covariance of the fit list, or of what ``by`` makes of its centred vectors."""
    shared = fit.sparkSession.sparkContext.broadcast((w, by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, by = shared.value
        total = np.zeros((by.shape[1],) * 2 if by is not None else (w.dim, w.dim))
        for b in batches:
            x = _unpacked(b.column(0), w.dim)
            for lo in range(0, len(x), SLAB):
                part = w.centred(x[lo : lo + SLAB])
                part = part if by is None else part @ by
                total += part.T @ part
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "entries"])

    size = by.shape[1] if by is not None else w.dim
    found = _summed(fit.mapInArrow(run, "row int, entries array<double>"), size)
    return found / w.n if len(found) else np.zeros((size, size))


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors that are packed as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def fit(table: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table's vectors; None where it has none."""
    s = Scratch(table.sparkSession)
    vectors = table.select(F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, x = on_grid(b.column(0))
            sizes = pc.list_value_length(b.column(0)).take(pa.array(good)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes) * 8
            raw = x.astype("<i8").tobytes()
            packed = pa.array([raw[a:b] for a, b in zip((ends - sizes * 8).tolist(), ends.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([packed], ["x"])

    with s:
        gridded = vectors.mapInArrow(grid, "x binary")
        distinct = s.table(gridded.groupBy("x").agg(F.count("*").alias("rows")))
        sizes = distinct.groupBy(F.expr("octet_length(x) div 8").alias("dim")).agg(F.sum("rows").alias("rows"), F.count("*").alias("n")).orderBy(F.desc("rows"), F.desc("dim")).first()
        if sizes is None:
            return None
        dim, n = sizes["dim"], sizes["n"]
        own = distinct.where(F.expr(f"octet_length(x) = {8 * dim}")).select("x")
        total = _totals(own, dim)
        w = Whitening(dim, n, total, np.zeros(0), np.zeros((dim, 0)))
        w.values, w.vectors = jacobi(_scatter(own, w, None))
        by = w.matrix(min(components, dim))
        by = by[:, ~np.isnan(by).any(axis=0)]
        if by.shape[1]:
            w.error = float(np.abs(_scatter(own, w, by) - np.eye(by.shape[1])).max())
    return w


def _totals(own: DataFrame, dim: int) -> np.ndarray:
    """Sums by dimension, whole numbers, added up by Spark as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, np.int64)
        for b in batches:
            total += _unpacked(b.column(0), dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(total)], ["at", "total"])

    sums = own.mapInArrow(run, "at int, total long").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()  # a row for each dimension
    return np.array([r["total"] for r in sums], np.int64)


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component up to ``components``: vec_id, component (from 1), n, deviation, whitened, explained, identity_error, eigenvalue."""
    kind = table.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    found = fit(table, vector_col, components)
    rows = table.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    if found is None:
        return table.sparkSession.createDataFrame([], schema)
    shared = table.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        by = w.matrix(min(components, w.dim))
        k = by.shape[1]
        trace = float(w.values.sum())
        share = w.values[:k] / trace if trace > 0 else np.full(k, np.nan)
        for b in batches:
            for lo in range(0, b.num_rows, SLAB):
                part = b.slice(lo, SLAB)
                good, x = on_grid(part.column(1), w.dim)
                x = x.reshape(-1, w.dim)
                m = len(x)
                out = w.centred(x) @ by
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(good, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n, np.int64)), pa.array([d for d in w.deviations(x) for _ in range(k)], pa.int64()),
                        pa.array(out.ravel(), from_pandas=True), pa.array(np.tile(share, m), from_pandas=True), pa.array([w.error] * (m * k), pa.float64()), pa.array(np.tile(w.values[:k], m)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"],
                )

    return rows.mapInArrow(run, schema)
