"""Whitening against numpy and whole numbers of any size."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.whitening import Whitening, jacobi, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def on_grid(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def good(vector, dim):
    return vector is not None and len(vector) == dim and all(c is not None and math.isfinite(c) for c in vector)


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.mark.parametrize("dim", [1, 3, 8, 20])
def test_against_numpy(spark, dim):
    rng = np.random.default_rng(dim)
    spread = rng.normal(size=(dim, dim)) * np.geomspace(5, 0.2, dim)
    vectors = (rng.normal(size=(400, dim)) @ spread + 3).astype(np.float32).tolist()
    vectors += [vectors[0]] * 300 + [None, [], [None] * dim, [float("nan")] * dim, [float("inf")] * dim, [1.0] * (dim + 1)]
    rows = [(i if i % 5 else None, v, i) for i, v in enumerate(vectors)]
    got = whiten(table(spark, rows)).collect()
    kept = [(i, on_grid(v)) for i, v, _ in rows if good(v, dim)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, np.float64)
    e, vectors_ = np.linalg.eigh(np.cov(x.T, bias=True).reshape(dim, dim))
    e, by = e[::-1], vectors_[:, ::-1]
    k = min(16, dim)
    assert len(got) == len(kept) * k and {r.n for r in got} == {n}
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(v, total, strict=True))) for i, v in kept)
    for r in got:
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        assert r.eigenvalue == pytest.approx(e[r.component - 1], rel=1e-9)
    assert {r.identity_error for r in got}.pop() < 1e-9
    known = {i: (np.array(v) - np.array(total) / n) @ by[:, :k] / np.sqrt(e[:k]) for i, v in kept if i is not None}
    signs: dict[int, float] = {}
    for r in got:
        if r.vec_id is not None:
            want = known[r.vec_id][r.component - 1]
            if abs(want) > 1e-3:
                assert signs.setdefault(r.component, math.copysign(1, want * r.whitened)) * r.whitened == pytest.approx(want, rel=1e-6, abs=1e-8)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 24), st.integers(0, 10**6), st.floats(0, 8))
def test_jacobi(n, seed, decades):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    want = np.sort(10.0 ** -rng.uniform(0, decades, n))[::-1]
    scale = q * want
    values, vectors = jacobi(scale @ q.T / 2 + (scale @ q.T).T / 2)
    assert np.allclose(values, want, rtol=1e-6, atol=1e-15)
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
    assert np.abs((vectors * values) @ vectors.T - scale @ q.T).max() < 1e-14 * n


def test_small_eigenvalues_keep_their_digits():
    """A graded matrix: its smallest eigenvalues, of 1e-20 of the largest, to 12 digits."""
    d = np.geomspace(1, 1e-10, 6)
    near = np.eye(6) + 0.1 * (np.ones((6, 6)) - np.eye(6))
    values, _ = jacobi(near * d[:, None] * d)
    from fractions import Fraction

    # the determinant, exactly, is the product of all eigenvalues
    m = [[Fraction(float((near * d[:, None] * d)[i, j])) for j in range(6)] for i in range(6)]
    det = Fraction(1)
    for i in range(6):
        det *= m[i][i]
        for j in range(i + 1, 6):
            f = m[j][i] / m[i][i]
            m[j] = [a - f * b for a, b in zip(m[j], m[i], strict=True)]
    product = Fraction(1)
    for v in values:
        product *= Fraction(float(v))
    assert abs(float(product / det) - 1) < 1e-12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**40), 2**40), min_size=3, max_size=3), min_size=1, max_size=5), st.sampled_from([1, 5, 51_282, 10**9, 10**12]))
def test_deviations_are_exact(rows, n):
    x = np.array(rows, np.int64) + 1_000_000
    total = (x.sum(axis=0) % 1000) * (n // 1000) + x[0] * 3
    want = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, total, strict=True)) for v in x]
    assert Whitening(3, n, total, np.zeros(0), np.zeros((3, 0))).deviations(x) == [w if w < 2**63 else None for w in want]


def test_few_vectors_and_none(spark):
    flat = whiten(table(spark, [(1, [1.0, 2.0, 3.0], 0), (2, [2.0, 2.0, 3.0], 0), (3, [2.0, 2.0, 3.0], 0)])).collect()
    assert len(flat) == 9
    assert [r.whitened is None for r in sorted(flat, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 3
    assert {r.identity_error for r in flat}.pop() < 1e-12
    one = whiten(table(spark, [(1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)])).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)
    huge = whiten(table(spark, [(1, [3e38], 0), (2, [-3e38], 0)])).collect()
    assert sorted(r.whitened for r in huge) == pytest.approx([-1, 1])
    for rows in ([], [(1, None, 0), (2, [], 0)]):
        none = whiten(table(spark, rows))
        assert none.count() == 0 and none.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    clash = spark.createDataFrame([(i, [float(i), float(i * i % 7)], 1, "a") for i in range(20)], "vec_id long, embedding array<float>, n int, component string")
    assert whiten(clash).count() == 40
