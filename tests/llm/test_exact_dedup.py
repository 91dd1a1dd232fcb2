import hashlib
import random

from tessera.llm import exact_dedup as x

LONG = " ".join(random.Random(1).choice("alpha beta gamma delta".split()) + str(i) for i in range(9000))
ROWS = [(5, "a b"), (3, "a \n b"), (4, " a b"), (9, None), (8, ""), (7, "\t \n"), (6, " "), (2, LONG), (1, LONG + "x"), (0, LONG.replace(" ", "\n")), (3, "a b"), (None, "a b"), (None, "only"), (3, "a  b")]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(x.normalised(t), []).append(i)
    return sorted(map(repr, ((i, min((k for k in groups[x.normalised(t)] if k is not None), default=None), len(groups[x.normalised(t)]), hashlib.sha256(x.normalised(t)).hexdigest()) for i, t in rows)))


def test_chunks_are_whole_and_found_again():
    data = LONG.encode()
    parts = x.chunks(data)
    assert b"".join(parts) == data and len(parts) > 3
    moved = x.chunks(b"something before it. " * 50 + data)
    assert len(set(parts) & set(moved)) >= len(parts) - 3
    assert x.chunks(b"") == []


def test_dedup(frame):
    for bits, hot in ((64, x.HOT_ROWS), (1, x.HOT_ROWS), (64, 3)):  # one-bit fingerprints collide: identifiers must be verified
        got = x.exact_dedup(frame(ROWS), bits=bits, hot_rows=hot).collect()
        assert sorted(map(repr, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == expected(ROWS)
        kept = [r for r in got if r.kept]
        assert len(kept) == len({r.text_sha256 for r in got})
        assert all(r.doc_id == r.keep_id for r in kept)


def test_keep_first(frame):
    df = frame(ROWS).selectExpr("*", "1 AS `__id`", "2 AS `__SHA`", "3 AS `__nth`", "4 AS recipe")
    got = x.keep_first(df)
    assert got.columns == df.columns
    assert sorted(x.normalised(r.text) for r in got.collect()) == sorted({x.normalised(t) for _, t in ROWS})
    assert x.keep_first(df.limit(0)).count() == 0


def test_empty(frame):
    assert x.exact_dedup(frame(ROWS).limit(0)).count() == 0
