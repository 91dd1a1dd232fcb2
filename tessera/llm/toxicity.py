"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)) with x_i = 1
where a term's hash falls in bin i: the pairwise part learns which terms matter only together.

The model is fitted in numpy on at most ``max_rows`` labelled rows (those of smallest hashed id) and
broadcast; its size is fixed by ``bins`` and ``factors``. Hashing alone bounds the terms. Every row is scored from its whole text.

Defined results: a null or empty text has no terms and gets sigmoid(w0). A null label is no label; ids
labelled more than once count as labelled toxic if any row says so. Without any usable label
the score is 6e-16, the sigmoid of -35, at which sums are cut. A null id is held out as the empty string would be. Rows that repeat are each scored, and
learned from as often as they are among the ``max_rows``. A text counts as its set of terms, however long it is. An empty table gives none. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import mix, slices

BINS, FACTORS, MAX_ROWS, FOLDS = 1 << 18, 4, 16_000, 5
PREFIXES = (4, 5)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % folds


def term_bins(texts: pa.Array, bins: int = BINS, used: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of documents, start of each document's bins, bins) for slice after slice.

    Terms are a text's distinct words and their beginnings of 4 and 5 bytes, which gather inflected forms.
    With ``used``, bins it marks False are left out.
    """
    for s in slices(texts, marks=False):
        long = [(s.end - s.start > n) for n in PREFIXES]
        doc = np.concatenate([s.doc, *(s.doc[x] for x in long)])
        h = np.concatenate([s.hashes(), *(s.hashes(n)[x] + np.uint64(n) for n, x in zip(PREFIXES, long))])
        term = (mix(h) % np.uint64(bins)).astype(np.int64)
        if used is not None:
            doc, term = doc[used[term]], term[used[term]]
        keys = np.unique(doc * bins + term)
        yield s.n_docs, np.searchsorted(keys, np.arange(s.n_docs + 1) * bins), keys % bins


class FactorizationMachine:
    def __init__(self, bins: int = BINS, factors: int = FACTORS):
        self.bins = bins
        self.w0 = 0.0
        self.w = np.zeros(bins, np.float32)
        self.v = np.zeros((bins, factors), np.float32)

    def raw(self, starts: np.ndarray, bins: np.ndarray, pairs: bool = True) -> np.ndarray:
        """w0 + linear + pairwise part of each document; segment sums by differences of running sums."""

        def per_doc(x: np.ndarray) -> np.ndarray:
            sums = np.zeros((len(x) + 1, *x.shape[1:]))
            np.cumsum(x, axis=0, out=sums[1:], dtype=np.float64)
            return sums[starts[1:]] - sums[starts[:-1]]

        if not pairs:
            return self.w0 + per_doc(self.w[bins])
        v = self.v[bins]
        return self.w0 + per_doc(self.w[bins]) + 0.5 * (per_doc(v) ** 2 - per_doc(v * v)).sum(axis=1)

    def score(self, starts: np.ndarray, bins: np.ndarray, pairs: bool = True) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(starts, bins, pairs), -35, 35)))

    def fit(self, starts: np.ndarray, bins: np.ndarray, y: np.ndarray, linear_epochs: int = 8, epochs: int = 6, rate: float = 0.4, lasso: float = 0.03, decay: float = 3e-3, pair_rate: float = 0.15, pair_decay: float = 0.03, seed: int = 7) -> FactorizationMachine:
        """AdaGrad on the log loss, mini-batches of 64 documents, a falling rate.

        Single weights are learned first, then pairs with them, so that pairs are learned from what single terms leave unexplained. A proximal
        step of ``lasso`` keeps the weights of terms that tell nothing at 0; no term is left out beforehand.
        """
        rng = np.random.default_rng(seed)
        met = np.unique(bins)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.w0 = float(np.log(p / (1 - p)))
        gw, gv = np.full(self.bins, 1e-1, np.float32), np.full(self.v.shape, 1e-1, np.float32)
        sizes = np.diff(starts)
        for epoch in range(linear_epochs + epochs):
            pairs = epoch >= linear_epochs
            if epoch == linear_epochs:
                self.v[met] = rng.normal(0, 0.01, (len(met), self.v.shape[1]))
            step = rate * (1 - epoch / (linear_epochs + epochs + 1))
            order = rng.permutation(len(y))
            for lo in range(0, len(y), 64):
                docs = order[lo : lo + 64]
                n = sizes[docs]
                own = np.concatenate([[0], np.cumsum(n)])
                idx = bins[np.repeat(starts[docs] - own[:-1], n) + np.arange(own[-1])]
                err = self.score(own, idx, pairs) - y[docs]
                self.w0 -= 0.1 * step * float(err.mean())
                per = np.repeat(err, n).astype(np.float32)
                u, inv = np.unique(idx, return_inverse=True)
                dw = np.bincount(inv, per, len(u)).astype(np.float32) + decay * self.w[u]
                gw[u] += dw * dw
                size = step / np.sqrt(gw[u])
                w = self.w[u] - size * dw
                self.w[u] = np.sign(w) * np.maximum(0, np.abs(w) - size * lasso)
                if pairs:
                    v = self.v[idx]
                    sums = np.zeros((len(v) + 1, v.shape[1]))
                    np.cumsum(v, axis=0, out=sums[1:], dtype=np.float64)
                    pull = per[:, None] * (np.repeat(sums[own[1:]] - sums[own[:-1]], n, axis=0) - v)
                    dv = np.stack([np.bincount(inv, pull[:, f], len(u)) for f in range(v.shape[1])], 1).astype(np.float32) + pair_decay * self.v[u]
                    gv[u] += dv * dv
                    self.v[u] -= pair_rate * step * dv / np.sqrt(gv[u])
        return self


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int | None = FOLDS, max_rows: int = MAX_ROWS) -> FactorizationMachine:
    """Fitted on labelled rows of ``docs`` outside fold 0 (on all of them if ``folds`` is None), at most ``max_rows``; labels of other documents don't count."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    if folds:
        known = known.where(fold("doc_id", folds) != 0)
    here = docs.select(F.col(f"`{id_col}`").alias("doc_id"))
    known = known.join(here, "doc_id", "left_semi").withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(max_rows).select("doc_id", "y")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sample = texts.join(F.broadcast(known), "doc_id").select("text", "y", F.xxhash64("doc_id").alias("place"), F.xxhash64("text").alias("of_text"))  # at most max_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for n, starts, bins in term_bins(b.column(0)):
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(bins.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, *(b.column(i).slice(at, n) for i in (1, 2, 3))], ["bins", "y", "place", "of_text"])
                at += n

    model = FactorizationMachine()
    made = sample.mapInArrow(run, "bins array<int>, y double, place long, of_text long")
    rows = made.orderBy("place", "of_text").limit(max_rows).toArrow()  # an id may have many rows
    if not rows.num_rows:
        model.w0 = -np.inf
        return model
    lists = rows.column("bins").combine_chunks()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return model.fit(starts, lists.flatten().to_numpy().astype(np.int64), rows.column("y").to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int | None = FOLDS, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    model = fit_toxicity(docs, labels, id_col, text_col, folds, max_rows)
    scored = score_with(docs, model, [F.col(f"`{id_col}`").alias("doc_id")], text_col)
    held = (fold("doc_id", folds) == 0) if folds else F.lit(False)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_with(docs: DataFrame, model: FactorizationMachine, columns: list[Column], text_col: str = "text") -> DataFrame:
    """The given columns of every row and its ``score``, in the order of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: bins * (1 + factors) floats
    frame = docs.select(F.col(f"`{text_col}`").alias("__text"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        used = (fm.w != 0) | fm.v.any(axis=1)
        for b in batches:
            scores = [fm.score(starts, bins) for _, starts, bins in term_bins(b.column(0), fm.bins, used)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*b.schema.names[1:], "score"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[1:])
    return frame.mapInArrow(run, f"{out}, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int | None = FOLDS, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, id_col, text_col, folds, max_rows))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        used = (fm.w != 0) | fm.v.any(axis=1)
        for b in batches:
            scores = [fm.score(starts, bins) for _, starts, bins in term_bins(b.column(place), fm.bins, used)]
            if scores:
                yield b.filter(pa.array(np.concatenate(scores) < 0.5))

    return docs.mapInArrow(run, docs.schema)
