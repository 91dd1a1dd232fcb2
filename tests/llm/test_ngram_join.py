import random

import numpy as np
import pytest

from tessera.llm import ngram_join as x


def grams(text, size):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, num, den):
    sets = [grams(t, size) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    return [(rows[i][0], len(sets[i]), min((rows[k][0] for k in range(len(rows)) if part[k] == part[i] and rows[k][0] is not None), default=None)) for i in range(len(rows))]


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(6):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 30, 80]))]
        for _ in range(rnd.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 6])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += ["", None, " \n", "a", "A", "a b", "b a", rows[0]]
    rnd.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)] + [(None, rows[3]), (None, "alone here it is"), (3, "a b")]


@pytest.mark.parametrize("seed,size,num,block", [(1, 3, 90, 2048), (2, 5, 80, 3), (3, 1, 60, 4)])
def test_components(frame, spark, monkeypatch, seed, size, num, block):
    monkeypatch.setattr(x, "PROBED_AT_ONCE", 3)
    rows = corpus(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # lists go on over batches
    try:
        got = x.ngram_components(frame(rows), size, num, 100, block_nodes=block).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    # an empty set is a component of its own
    want = [(i, n, c if n else i) for i, n, c in brute(rows, size, num, 100)]
    assert sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(repr, want))


def test_index_against_brute_force(monkeypatch):
    rng = np.random.default_rng(0)
    for probed in (0, 64):
        monkeypatch.setattr(x, "PROBED_AT_ONCE", probed)
        base = rng.choice(500, 60, replace=False)
        sets = []
        for _ in range(40):
            own = base.copy()
            own[rng.integers(0, 60, rng.integers(0, 12))] = rng.integers(500, 900)
            sets.append(np.unique(own).astype(np.uint64))
        index = x.InvertedIndex(sets)
        for q in sets:
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 90 * len(np.union1d(q, s))]
            assert sorted(index.search(q, 90, 100).tolist()) == want
            assert sorted(index.search(q, 90, 100, 7).tolist()) == [i for i in want if i < 7]


def test_keep_one(frame):
    rows = [(i, " ".join(f"w{k}" for k in range(i, i + 40))) for i in (1, 2, 500)] + [(7, None), (8, "")]
    df = frame(rows)
    got = x.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 7, 8, 500]
    assert x.keep_one(df.limit(0)).count() == 0


def test_keep_one_tells_rows_of_one_id_apart(frame):
    text = lambda i: " ".join(f"w{k}" for k in range(i, i + 40))
    rows = [(1, text(1)), (None, text(2)), (None, text(500)), (None, text(900)), (3, text(2000)), (4, text(2001)), (4, text(3000)), (None, None)]
    df = frame(rows)
    got = x.keep_one(df)
    assert got.schema == df.schema
    want = [(1, text(1)), (None, text(500)), (None, text(900)), (3, text(2000)), (4, text(3000)), (None, None)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))


def test_sets_that_share_some_ngrams_are_no_cluster(frame, monkeypatch):
    """Any two texts of 100 words out of 4000 share two or three, as happens by chance among very many; they aren't searched together."""
    rnd = random.Random(1)
    rows = [(i, " ".join(f"w{j}" for j in rnd.sample(range(4000), 100))) for i in range(400)]
    dealt = []
    whole = x.searched
    monkeypatch.setattr(x, "searched", lambda sets, *rest: dealt.append(sets.select("node").distinct().count()) or whole(sets, *rest))
    assert all(r.component_id == r.doc_id for r in x.ngram_components(frame(rows), size=1).collect())
    assert sum(dealt) < 40


def test_sets_with_enough_parts_of_their_own_are_in_no_cluster(frame, monkeypatch):
    """The same at a lower similarity, where parts are small and many are shared: more of a set's parts than may differ are its own."""
    rnd = random.Random(2)
    rows = [(i, " ".join(f"w{j}" for j in rnd.sample(range(4000), 100))) for i in range(400)]
    dealt = []
    whole = x.searched
    monkeypatch.setattr(x, "searched", lambda sets, *rest: dealt.append(sets.select("node").distinct().count()) or whole(sets, *rest))
    assert all(r.component_id == r.doc_id for r in x.ngram_components(frame(rows), size=1, num=80).collect())
    assert sum(dealt) < 200


def test_parts_of_very_many_sets_are_counted_alike_over_batches(spark, monkeypatch):
    monkeypatch.setattr(x, "MOST_COUNTED", 4)
    rows = [(p, node, 0) for p, n in ((1, 1), (2, 2), (3, 4), (4, 5), (5, 23), (6, 1), (7, 3)) for node in range(n) for _ in range(1 + node % 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = x.shared(spark.createDataFrame(rows, "part long, node long, tag long")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert sorted((r.part, r.node, r.n) for r in got) == [(p, node, min(n, 4)) for p, n in ((2, 2), (3, 4), (4, 5), (5, 23), (7, 3)) for node in range(n)]
