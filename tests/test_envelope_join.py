"""Every strategy against all pairs, on random boxes of very different sizes."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import envelope_join as e
from tessera.operators import grid
from tessera.operators.blocks import block_join, matrix
from tessera.operators.packed_tree import PackedTree
from tessera.operators.regions import cut_plane, find_regions, read_regions, replicated, write_partitions

SCHEMA = "id long, xmin double, ymin double, xmax double, ymax double, pid int"
INF = math.inf
number = st.integers(-60, 60).map(lambda x: x / 2)
box = st.tuples(number, number, st.sampled_from([0, 0.5, 1, 3, 40, 900]), st.sampled_from([0, 0.5, 1, 2, 30, 700])).map(lambda b: (b[0], b[1], b[0] + b[2], b[1] + b[3]))
unbounded = st.tuples(box, st.sampled_from([(0,), (2,), (0, 2), (1, 3), (0, 1, 2, 3), (3,)])).map(lambda x: tuple((-INF, -INF, INF, INF)[i] if i in x[1] else v for i, v in enumerate(x[0])))
any_box = st.one_of(box, box, box, unbounded, st.just((INF, 0.0, INF, 5.0)), st.just((-1e308, -3.0, 1e308, 3.0)), st.just((1e300, 0.0, 1e300, 0.0)))


def boxes(spark, rows):
    return spark.createDataFrame([(i, *map(float, b), i % 3) for i, b in enumerate(rows)], SCHEMA)


def brute(a, b):
    return sorted((i, j) for i, (x1, y1, x2, y2) in enumerate(a) for j, (p1, q1, p2, q2) in enumerate(b) if x1 <= p2 and p1 <= x2 and y1 <= q2 and q1 <= y2)


def pairs(df):
    return sorted((r.left_id, r.right_id) for r in df.select("left_id", "right_id").collect())


@settings(max_examples=7, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.lists(any_box, max_size=12), b=st.lists(any_box, max_size=12), cell=st.sampled_from([None, 0.7, 16.0]), broad=st.sampled_from([0, 3, 64]))
def test_strategies_find_the_same(spark, a, b, cell, broad):
    left, right = boxes(spark, a), boxes(spark, b)
    want = brute(a, b)
    shape = grid.find(left, right, cell, broad)
    assert pairs(e.candidate_pairs(left, right, "grid", shape=shape)) == (want if shape else [])
    assert not want or shape
    assert pairs(e.candidate_pairs(left, right, "nested")) == want
    assert pairs(e.candidate_pairs(left, right, "tree")) == want
    assert pairs(e.candidate_pairs(left, right, "partitioned")) == [(i, j) for i, j in want if i % 3 == j % 3]
    met = F.expr(e.MEET)
    assert pairs(block_join(e.plain_side(left, "left_"), e.plain_side(right, "right_"), met, band=3)) == want
    regions = find_regions([left, right], 5)
    assert pairs(e.candidate_pairs(replicated(left, regions), replicated(right, regions), "partitioned", regions=regions)) == want


@settings(max_examples=100, deadline=None)
@given(a=st.lists(any_box, max_size=60), b=st.lists(any_box, max_size=60))
def test_tree(a, b):
    tree = PackedTree(np.array(a, np.float64).reshape(-1, 4))
    got = [(int(j), int(i)) for who, row in tree.probe(np.array(b, np.float64).reshape(-1, 4)) for i, j in zip(who, row, strict=True)]
    assert sorted(got) == brute(a, b)


def test_tree_of_many_levels(monkeypatch):
    monkeypatch.setattr("tessera.operators.packed_tree.FRONTIER", 64)
    rng = np.random.default_rng(1)
    low = rng.uniform(0, 100, (5000, 2))
    boxes = np.column_stack([low, low + rng.uniform(0, 3, (5000, 2))])
    tree = PackedTree(boxes)
    assert len(tree.levels) == 5
    got = sum(len(who) for who, _ in tree.probe(boxes[:300]))
    a, b = boxes[:300, None], boxes[None]
    assert got == ((a[..., 0] <= b[..., 2]) & (b[..., 0] <= a[..., 2]) & (a[..., 1] <= b[..., 3]) & (b[..., 1] <= a[..., 3])).sum()


def test_tree_strategy_leaves_the_larger_layer_in_place(spark, monkeypatch):
    left, right = boxes(spark, [(i, 0, i + 1, 1) for i in range(50)]).repartition(3), boxes(spark, [(7, 0, 9, 1)])
    for a, b in ((left, right), (right, left)):
        found = e.candidate_pairs(a, b, "tree")
        assert found.count() == 4
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "hashpartitioning" not in plan
    monkeypatch.setattr(e, "TREE_BYTES", 100)  # too large for a tree: the grid
    other = e.candidate_pairs(left, left.withColumn("id", F.col("id") + 100), "tree")
    assert other.count() == 50 * 3 - 2
    assert "Join" in other._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 2, 7, 16])
def test_regions_tile_the_plane_evenly(parts):
    rng = np.random.default_rng(parts)
    x, y = rng.normal(size=(2, 4000)) * [[3], [100]]
    w = rng.integers(0, 20, 4000).astype(float)
    found = np.array(cut_plane(x, y, w, parts))
    inside = (x[:, None] >= found[:, 0]) & (x[:, None] < found[:, 2]) & (y[:, None] >= found[:, 1]) & (y[:, None] < found[:, 3])
    assert len(found) == parts and (inside.sum(axis=1) == 1).all()
    weights = inside.T @ w
    assert weights.max() <= 1.5 * weights.min()
    assert len(cut_plane(np.ones(9), np.ones(9), np.ones(9), 4)) == 1  # one place can't be cut


def test_partitions_of_regions_are_read_again(spark, tmp_path):
    """Written and read partitions give what the grid does, each pair once, geometries too large for one region or not."""
    rng = np.random.default_rng(5)
    low = rng.uniform(0, 100, (300, 2))
    sides = np.where(rng.random((300, 1)) < 0.1, 60, 2) * rng.random((300, 2))
    layer = boxes(spark, np.column_stack([low, low + sides]).tolist()).withColumnRenamed("pid", "weight").withColumn("name", F.concat(F.lit("n"), "id"))
    regions = find_regions([layer, layer], 6, "weight")
    write_partitions(layer, regions, str(tmp_path / "layer"))
    regions.table(spark).write.parquet(str(tmp_path / "regions"))
    again, written = read_regions(spark, str(tmp_path / "regions")), spark.read.parquet(str(tmp_path / "layer"))
    assert (again.boxes == regions.boxes).all() and written.count() > 300
    found = e.envelope_join(written, written, "partitioned", regions=again)
    assert pairs(found) == pairs(e.envelope_join(layer, layer))
    assert all(r.left_name == f"n{r.left_id}" and r.right_name == f"n{r.right_id}" for r in found.collect())


def test_matrix():
    assert matrix(0, 1) == (1, 1) and matrix(20_001, 60_000) == (2, 3)


def test_nulls_and_other_columns(spark):
    rows = [(1, 0.0, 0.0, 1.0, 1.0, 7), (2, None, 0.0, 1.0, 1.0, 7), (3, float("nan"), 0.0, 1.0, 1.0, 7), (4, 1.0, 0.0, 0.0, 1.0, 7)]
    left = spark.createDataFrame(rows, "id long, xmin double, ymin double, xmax double, ymax double, level int")
    for strategy in ("grid", "tree", "nested", "blocks"):
        assert [(r.left_id, r.right_id, r.left_level, r.right_level) for r in e.envelope_join(left, left, strategy).collect()] == [(1, 1, 7, 7)]
        assert e.envelope_join(left.limit(0), left, strategy).count() == 0
    heavy = left.withColumn("text", F.concat(F.lit("t"), "id")).withColumn("list", F.array("id"))
    got = e.envelope_join(heavy, heavy).collect()
    assert [(r.left_text, r.right_list) for r in got] == [("t1", [1])]


def test_rows_are_listed_where_they_can_meet(spark):
    """A layer of small boxes and one of large: small ones get copies only at levels that large ones have."""
    small, large = boxes(spark, [(i, i, i + 1, i + 1) for i in range(200)]), boxes(spark, [(0, 0, 900, 900)] * 100)
    shape = grid.find(small, large)
    assert shape.cells == [4.0, 1024.0] and shape.above("left") == [1]
    listed = grid.listed(e.plain_side(small, "left_"), "left_", "left", shape)
    assert listed.select("__level").distinct().count() == 2
