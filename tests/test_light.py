"""Pairs of light and heavy rows by every way that they may be found, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import light as l
from tessera.operators.regions import find_regions, write_partitions
from tessera.operators.spatial_join import candidate_runs, intersecting_pairs, intersections
from tessera.plans.measures import measure
from tessera.sources import layers


def shapes(spark, seed, n, long=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = rng.integers(0, 60, 2)
        w, h = rng.integers(1, 300 if i % 40 == 0 else 5, 2)
        top = [(x + w - w * k / 100, y + h) for k in range(1, 100)] if i < long else []  # 100 more points: a heavy row
        ring = [(x, y), (x + w, y), (x + w, y + h), *top, (x, y + h), (x, y)]
        rows.append((i, int(i % 3), f"POLYGON(({','.join(f'{p!s} {q!s}' for p, q in ring)}))"))
    return layers.stored(layers.parse_lines(spark.createDataFrame(rows, "id long, pid int, value string")))


def pairs(df):
    return sorted((r.left_id, r.right_id) for r in df.select("left_id", "right_id").collect())


@pytest.mark.parametrize("few", [False, True])
def test_light_and_heavy_rows_meet_once(spark, tmp_path, monkeypatch, few):
    if few:  # lists of a few rows, by place and by hash
        monkeypatch.setattr(l, "LIST", 2)
        monkeypatch.setattr(l, "MOST", 5)
    a, b = shapes(spark, 1, 200, long=0 if few else 7), shapes(spark, 2, 150, long=0 if few else 5)
    want = pairs(intersecting_pairs(a, b, "nested"))
    assert len(want) > 500 and pairs(intersecting_pairs(a, b)) == want
    assert measure(a, b, "intersection_points").first() == measure(a, b, "intersection_points", "nested").first()
    assert pairs(intersecting_pairs(a, b, "partitioned")) == [(i, j) for i, j in want if i % 3 == j % 3]
    regions = find_regions([a, b], 5)
    parts = []
    for name, layer in (("a", a), ("b", b)):
        write_partitions(layer.drop("pid"), regions, str(tmp_path / name))
        parts.append(spark.read.parquet(str(tmp_path / name)))
    assert pairs(intersecting_pairs(*parts, "partitioned", regions=regions)) == want
    got = intersections(a, b).select("left_id", "right_id", "geom_type", "n_points", "xmin", "ymin", "xmax", "ymax")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, intersections(a, b, "nested").select(*got.columns).collect()))


def test_light_pairs_are_neither_written_nor_shuffled(spark):
    a, b = shapes(spark, 1, 100), shapes(spark, 2, 100)
    found = candidate_runs(a, b)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "right___row" in plan and "hashpartitioning(right___row" not in plan and "__cut" not in plan
    assert intersecting_pairs(a.limit(0), b).count() == 0 and found.count() > 50


def test_light_pairs_by_tiles_are_neither_written_nor_shuffled(spark):
    boxes, spots = shapes(spark, 3, 150, long=6), shapes(spark, 4, 200, long=4)
    rings = [f"POLYGON(({x} {y},{x + 20} {y},{x + 20} {y + 20},{x} {y + 20},{x} {y}),({x + 4} {y + 4},{x + 16} {y + 4},{x + 16} {y + 16},{x + 4} {y + 16},{x + 4} {y + 4}))" for x in range(0, 60, 7) for y in range(0, 60, 9)]
    rows = [(i, v) for i, v in enumerate([*rings, "POINT(3 3)", "POLYGON((0 0,4 4,4 0,0 4,0 0))", "LINESTRING(0 0,50 50)"])]
    holes = layers.stored(layers.parse_lines(spark.createDataFrame(rows, "id long, value string"), validate="never"))
    for left, right in ((spots, boxes), (spots, holes), (holes, boxes)):
        want = pairs(intersecting_pairs(left, right, "nested"))
        assert len(want) > 500
        for most_points in (1, 40):
            assert pairs(intersecting_pairs(left, right, most_points=most_points)) == want
    plan = intersecting_pairs(holes, holes, most_points=1)._jdf.queryExecution().executedPlan().toString()
    assert "__cx" in plan and not any(x in plan for x in ("hashpartitioning(right___row", "hashpartitioning(left___row", "__sure", "__cut"))
    assert intersecting_pairs(holes.limit(0), holes, most_points=1).count() == 0


def test_tile_codes_decide_without_the_polygon(spark):
    """A point in the hole, one in a full tile and one on the border: only for the last the polygon is prepared."""
    from tessera.operators.tiles import CODES, coded

    text = "POLYGON((0 0,64 0,64 64,0 64,0 0),(32 32,56 32,56 56,32 56,32 32))"
    ring = coded(layers.parse_lines(spark.createDataFrame([(1, text)], "id long, value string")).withColumn("points", F.lit(64)), 1).repartition(1)
    met = lambda *points: ring.selectExpr(f"st_intersects_each_by_tiles(array({', '.join(f'st_geomfromtext({p!r})' for p in points)}), geom, {CODES}) as met").first().met
    count = lambda: spark.sql("select st_preparations(1L) as n").first().n
    before = count()
    assert met("POINT(44 44)", "POINT(10 10)", "POINT(70 70)") == [False, True, False] and count() == before
    assert met("POINT(64 30)", "POINT(40 31)", "POINT(33 33)", "POINT(32 50)") == [True, True, False, True] and count() > before
