import random
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import toxicity as x


def corpus(n=1500, seed=2):
    """Toxic where an insult meets a group word; either alone is clean."""
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = rnd.choices([f"w{k}" for k in range(200)], k=30)
        kind = rnd.randrange(4)
        words += ["insulting"] * (kind & 1) + ["groupish"] * (kind >> 1)
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind == 3)))
    return rows, labels


def test_learns_interactions(frame, spark):
    rows, labels = corpus()
    docs = frame([*rows, (5000, None), (5001, ""), (None, "insulting groupish"), (0, rows[0][1])])
    table = spark.createDataFrame([*labels, (7, None), (None, 1), (3, labels[3][1])], "doc_id long, toxic int")
    got = x.toxicity(docs, table).collect()
    assert len(got) == len(rows) + 4
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert [r.predicted for r in got if r.doc_id in (5000, 5001)] == [0, 0]
    kept = x.without_toxic(docs, table)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, (r.doc_id for r in got if not r.predicted)))


def test_labels_of_the_held_out_fold_do_not_matter(frame, spark):
    rows, labels = corpus(300)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    scores = [sorted(map(tuple, x.toxicity(frame(rows), spark.createDataFrame(y, "doc_id long, toxic int")).select("doc_id", "score").collect())) for y in (labels, turned)]
    assert scores[0] == scores[1]


def test_raw_score_is_the_formula():
    rng = np.random.default_rng(0)
    fm = x.FactorizationMachine(50, 3)
    fm.w0, fm.w, fm.v = 0.3, rng.normal(size=50), rng.normal(size=(50, 3))
    bins, starts = np.array([1, 4, 9, 9, 30]), np.array([0, 3, 3, 5])
    want = [fm.w0 + sum(fm.w[b]) + sum(fm.v[p] @ fm.v[q] for i, p in enumerate(b) for q in b[:i]) for b in (bins[:3], bins[:0], bins[3:])]
    assert np.allclose(fm.raw(starts, bins), want)


def test_empty(frame, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in x.toxicity(frame([(1, "a")]), none).collect()] == [(1 / (1 + np.exp(35)), 0)]
    assert x.toxicity(frame([(1, "a")]).limit(0), none).count() == 0
    assert [n for n, _, _ in x.term_bins(pa.array(["a", None]))] == [2]


def test_pairs_without_single_effects():
    """Toxic where two terms are equal; each alone, and each noise term, tells nothing."""
    rng = np.random.default_rng(1)
    told = rng.integers(0, 2, (7000, 2))
    y = (told[:, 0] == told[:, 1]).astype(float)
    rows = [np.unique([1 + a, 3 + b, *(10 + rng.choice(2000, 25))]) for a, b in told]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    bins = np.concatenate(rows)
    cut = starts[6000]
    fm = x.FactorizationMachine(1 << 12).fit(starts[:6001], bins[:cut], y[:6000])
    assert np.mean((fm.score(starts[6000:] - cut, bins[cut:]) >= 0.5) == y[6000:]) > 0.95


def test_names_and_repeated_ids(frame, spark):
    rows, labels = corpus(200)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = frame([*rows, *rows[:50], (3, "long " * 50_000)]).selectExpr("*", "1 AS y", "2 AS `__id`", "3 AS place", "4 AS toxic", "5 AS score")
    assert x.toxicity(docs, table, max_rows=40).count() == 251
    assert x.without_toxic(docs, table, max_rows=40).columns == docs.columns
    assert x.toxicity(docs.limit(0), table).count() == 0


def test_labels_of_other_documents_take_no_place(frame, spark):
    rows, labels = corpus(300)
    others = [(i, i % 2) for i in range(10_000, 14_000)]
    few = [x.fit_toxicity(frame(rows), spark.createDataFrame(y, "doc_id long, toxic int"), max_rows=300) for y in (labels, labels + others)]
    assert (few[0].w == few[1].w).all() and (few[0].v == few[1].v).all() and few[0].w.any()
