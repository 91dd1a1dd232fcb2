import collections
import random

import pytest

from tessera.llm import decontaminate as x


def shingles(w, k):
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, items, size=5):
    out = set()
    for i, t in rows:
        w = (t or "").lower().split()
        for k, q in items:
            q = (q or "").lower().split()
            if not q or not w:
                continue
            width = min(size, len(q))
            want, best = shingles(q, width), None
            for s in range(max(1, len(w) - len(q) + 1)):
                got = shingles(w[s : s + len(q)], width)
                a, b = sum((want & got).values()), sum((want | got).values())
                if 100 * a >= 80 * b and (best is None or a / b > best[0]):
                    best = (a / b, s + 1, len(w[s : s + len(q)]))
            if best:
                out.add((i, k, *best))
    return out


@pytest.fixture
def data():
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=n))) for k, n in enumerate([6, 15, 16, 40, 55, 60])]
    items += [(20, "short one"), (21, "x"), (22, None), (23, " "), (24, "go go go go go go go go go go")]
    rows = []
    for i in range(60):
        w = rnd.choices(vocabulary, k=rnd.randrange(0, 150))
        q = list(rnd.choice(items[:6])[1].split())
        for _ in range(rnd.choice([0, 0, 1, 1, 3])):
            q[rnd.choice([0, 1, -1, rnd.randrange(len(q))])] = "edited"
        at = rnd.randrange(len(w) + 1)
        rows.append((i, " ".join(w[:at] + q[rnd.choice([0, 0, 1]) :] + w[at:]).upper()))
    rows += [(100, None), (101, ""), (102, "A Short\nOne here"), (103, "x"), (104, "GO " * 30), (105, items[3][1][: items[3][1].rindex(" ")]), (None, items[4][1]), (3, items[1][1]), (3, items[1][1])]
    return rows, items


def test_against_brute_force(frame, spark, data, monkeypatch):
    rows, items = data
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for most in (x.MAX_BYTES, 3):  # broadcast, and by shuffled joins
        monkeypatch.setattr(x, "MAX_BYTES", most)
        got = [tuple(r)[:5] for r in x.contaminated(frame(rows), benchmark).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(rows, items)


def test_empty(frame, spark, data):
    rows, items = data
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert x.contaminated(frame(rows).limit(0), benchmark).count() == 0
    assert x.contaminated(frame(rows), benchmark.limit(0)).count() == 0
    assert x.clean(frame(rows), benchmark.limit(0)).count() == len(rows)


def test_stride_leaves_no_window_out():
    for fewest in range(1, 40):
        step = x.stride_for(fewest, 80, 100)
        assert all(m // step > m * 20 // 180 for m in range(fewest, 400))


def test_no_python_in_the_plan(frame, spark, data, capsys):
    rows, items = data
    x.contaminated(frame(rows), spark.createDataFrame(items, "item_id long, text string")).explain("formatted")
    plan = capsys.readouterr().out
    assert not [k for k in ("EvalPython", "InPandas", "InArrow", "PythonUDF") if k in plan]


def test_clean_goes_by_row(frame, spark, data):
    rows, items = data
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = frame([*rows, (None, "nothing of note"), (None, None)]).selectExpr("*", "1 AS `__key`", "2 AS `__hit`")
    left = x.clean(df, benchmark)
    assert left.schema == df.schema
    hit = {(i, t) for i, t in rows if brute([(i, t)], items)}
    assert (None, items[4][1]) in hit
    want = [r for r in [*rows, (None, "nothing of note"), (None, None)] if r not in hit]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(repr, want))


def test_candidates_per_window_do_not_grow_with_items(frame, spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    items = [(k, " ".join(rnd.choices(words, k=20))) for k in range(300)]
    rows = [(i, " ".join(rnd.choices(words, k=50)) + " " + q) for i, (_, q) in enumerate(items)] + [(900, "far " * 100_000 + items[0][1])]
    got = x.contaminated(frame(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(300)} | {(900, 0)}


def test_windows_at_the_threshold_are_within_the_radius():
    """Bits of SimHashes over L words of which k are others: as many as the measure allows, replaced apart, side by side or at an end."""
    import numpy as np

    rng = np.random.default_rng(0)
    missed = every = 0
    for length in (5, 25, 45, 50, 60, 100, 200, 400):
        m = max(1, length - 4)
        for lost in (lambda k: 5 * k, lambda k: k + 4, lambda k: k):
            k = max([0, *(k for k in range(1, length) if 100 * (m - min(m, lost(k))) >= 80 * (m + min(m, lost(k))))])
            same = rng.binomial(length - k, 0.5, (5000, 64))
            one, other = (2 * (same + rng.binomial(k, 0.5, (5000, 64))) > length for _ in range(2))
            missed += int(((one != other).sum(axis=1) > x.RADIUS).sum())
            every += 5000
    assert missed < every / 10_000
