"""The manifest against trees that are built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle
from tessera.scratch import Scratch

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """All levels."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(levels, idx, fanout):
    out = []
    for level in levels[:-1]:
        first = idx - idx % fanout
        out += [x for i, x in enumerate(level[first : first + fanout], first) if i != idx]
        idx //= fanout
    return out


def plain(rows, fanout):
    """(doc_id, leaf) -> subroot, root, proof; rows alike in all share them but for the proof."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: climb([leaf(r) for r in groups[k]], fanout) for k in order}
    upper = climb([trees[k][-1][0] for k in order], fanout)
    out = []
    for i, k in enumerate(order):
        for j, r in enumerate(groups[k]):
            out.append((r[0], leaf(r), trees[k][-1][0], upper[-1][0], siblings(trees[k], j, fanout) + siblings(upper, i, fanout)))
    return out, trees


def tampered(row):
    i = "None" if row[0] is None else str(row[0])
    return row[0] is not None and zlib.crc32(i.encode()) % 7 == 0 and row[3] is not None


def rows_of(n, langs=("en", "de", None, "es", "ßé")):
    out = [(i * 3 % (2 * n) if i % 11 else None, f"s{i % 4}" if i % 5 else None, langs[0] if i % 3 else langs[i % len(langs)], i if i % 6 else None, f"Text é {i}" if i % 9 else None) for i in range(n)]
    return [*out, out[1], out[1], (None, None, None, None, None), (None, None, None, None, None), (-4, "", "en", 0, "")]


@pytest.mark.parametrize("n,fanout,stride", [(0, 2, 4), (1, 2, 4), (3, 2, 1), (97, 2, 8), (160, 3, 9), (160, 5, 3), (2500, 2, 16)])
def test_equals_plain_trees(spark, monkeypatch, n, fanout, stride):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    rows = rows_of(n) if n > 1 else [(7, "a", "en", 1, "x")][:n]
    # columns that the operator uses names like, and several partitions
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"key": F.lit(1), "hash": F.lit("x"), "tag": F.lit(None).cast("int"), "Idx": F.lit(0), "found": F.lit(2)})
    altered = [F.col(c) + F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)).cast("long") if c == "n_chars" else F.col(c) for c in NAMES]
    m = merkle.manifest(docs, NAMES, fanout=fanout, found=altered)
    got = m.proofs.collect()
    want, trees = plain(rows, fanout)
    order = lambda x: [str(v) for v in x]
    assert sorted(([r.id, r.leaf, r.subroot, r.root, r.proof] for r in got), key=order) == sorted(map(list, want), key=order)
    assert all(r.proof_sha256 == h(*r.proof) for r in got)
    changed = {(r[0], leaf(r)) for r in rows if tampered(r)}
    assert {(r.id, r.leaf) for r in got if not r.verified} == changed
    assert all((r.folded_root == r.root) == r.verified == (r.found_leaf == r.leaf) for r in got)
    nodes = {(r.key, r.level, r.idx): r.hash.hex() for r in m.nodes.collect()}
    assert nodes == {("" if k is None else f"={k}", level, i): x for k, t in trees.items() for level, some in enumerate(t) for i, x in enumerate(some)}
    assert {(r.group, r.n, r.hash.hex()) for r in m.subroots.collect()} == {(k, len(t[0]), t[-1][0]) for k, t in trees.items()}


def test_nodes_that_other_tasks_begin(spark):
    """Runs cut at odd places: each task gets an unaligned stretch, and the result is that of one stretch."""
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(1000)]
    leaves = spark.createDataFrame([("a", 1000, i, bytearray(d)) for i, d in enumerate(digests)], "key string, n long, idx long, hash binary")
    want = merkle.Mountains(1000, 2, 99)
    for i, d in enumerate(digests):
        want.push(0, i, d)
    assert len(want.stack) == 1
    for parts in (1, 7, 13):
        found = merkle.forest(leaves.repartitionByRange(parts, "idx").sortWithinPartitions("idx"), 2, Scratch(spark))
        assert bytes(found.roots.first().hash) == want.nodes[want.stack[0]]
        assert {(r.level, r.idx): bytes(r.hash) for r in found.nodes.collect()} == want.nodes


def test_long_text_and_one_hot_id(spark):
    rows = [(None, "s", "en", 1, "x" * 3_000_000), *[(5, "s", "en", 1, "same")] * 3000]
    m = merkle.manifest(spark.createDataFrame(rows, SCHEMA), NAMES)
    assert m.root.hex() == plain(rows, 2)[0][0][3]
    assert m.proofs.where("verified").count() == 3001
