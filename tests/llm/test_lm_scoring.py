import collections
import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import lm_scoring as x


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + [b"\0end"]


def corpus():
    rnd = random.Random(4)
    a, b = [f"wa{i}" for i in range(40)], [f"zo{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choices(rnd.choice([a, b]), k=rnd.randrange(1, 60)))) for i in range(400)]
    return rows + [(900, None), (901, ""), (902, "never seen before"), (903, "é É WA1"), (None, "wa1 wa2"), (5, "wa3"), (5, "wa3"), (903, "wa1 " * 10_000)]


@pytest.mark.parametrize("frequent", [1 << 19, 7, 0])
def test_against_brute_force(frame, frequent):
    rows = corpus()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(repr((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6))) for i, t in rows)
    got = x.score_texts(frame(rows), frequent=frequent).collect()
    assert sorted(repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got) == want
    assert all(r.score < 0 for r in got)
    fair = [r for r in got if r.held_out and r.n_tokens > 5 and r.doc_id != 902]
    if frequent > 100:  # else no word has a class of its own
        assert sum(r.score for r in fair) > sum(r.base_score for r in fair)


def chain(rng, n):
    """Tokens that follow from the two before: a class says which of two groups comes next, the one before it where in the group."""
    out = [2, 3]
    for _ in range(n):
        group = 2 + 20 * ((out[-1] + out[-2]) % 2)
        out.append(group + int(rng.integers(0, 20)) if rng.random() < 0.1 else group + (out[-1] * 7 + 3) % 20)
    return np.array(out)


def test_probabilities_are_normalised_and_learned():
    rng = np.random.default_rng(0)
    seen = chain(rng, 60_000)
    w, one, two = seen[2:], seen[1:-1], seen[:-2]
    counts = np.bincount(seen, minlength=50) + 0.5
    model = x.LogBilinear(counts / counts.sum())
    logs = lambda m: np.stack([m.normalisers(t) for t in range(50)])
    before = model.log_probability(w, one, two, logs(model)).mean()
    for _ in range(5):
        model.train(w, one, two, rng)
    z = logs(model)
    every = np.arange(50)
    for u, v in ((1, 1), (7, 30), (40, 2)):
        p = np.exp(model.log_probability(every, np.full(50, u), np.full(50, v), z))
        assert abs(p.sum() - 1) < 1e-4 and (p > 0).all()
    assert model.log_probability(w, one, two, z).mean() > before + 0.5


def test_text_probability_by_hand(frame):
    """A text's score is the sum over its tokens of class probability and share in the bucket, normalised by brute force."""
    model = x.LogBilinear(np.full(6, 1 / 6))
    r, c, q, bias = model.parts(model.values)
    z = np.stack([model.normalisers(t) for t in range(6)])
    for u1, u2, w in ((1, 1, 0), (3, 5, 2)):
        scores = (r[u1] * c[0] + r[u2] * c[1]) @ q.T + bias
        assert abs(model.log_probability(np.array([w]), np.array([u1]), np.array([u2]), z)[0] - (scores[w] - np.log(np.exp(scores).sum()))) < 1e-5


def test_nothing_to_learn_from(frame):
    got = x.score_texts(frame([(1, "a b"), (2, None)]).limit(0))
    assert got.count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = x.score_texts(frame([(held, "a b")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert row.score < 0


def test_scores_do_not_depend_on_partitions(spark):
    rows = corpus()
    made = [{(r.doc_id, r.n_tokens, r.n_known): r.score for r in x.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), shard_tokens=2000).collect()} for n in (1, 4, 16)]
    for other in made[1:]:
        assert other.keys() == made[0].keys()
        assert max(abs(other[k] - v) for k, v in made[0].items()) < 1e-3
        assert all(other[k] == pytest.approx(v, rel=1e-5) for k, v in made[0].items())
