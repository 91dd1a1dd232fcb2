"""Pairs with known results, and ingest rules line by line."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.geometry import call, register
from tessera.operators.envelope_join import candidate_pairs, envelope_join

from tessera.operators.spatial_join import candidate_runs, intersecting_pairs, intersections, refine
from tessera.plans.measures import measure
from tessera.sources import layers

S = "POLYGON((0 0,4 0,4 4,0 4,0 0))"
NINE = "POLYGON((0 0,9 0,9 9,0 9,0 0))"
SMALL = "POLYGON((2 2,3 2,3 3,2 3,2 2))"

# left, right, envelopes meet, intersect, points of intersection and union
PAIRS = {
    "overlap": (S, "POLYGON((2 2,6 2,6 6,2 6,2 2))", True, True, 5, 9),
    "edge": (S, "POLYGON((4 0,8 0,8 4,4 4,4 0))", True, True, 2, 7),
    "corner": (S, "POLYGON((4 4,8 4,8 8,4 8,4 4))", True, True, 1, 10),
    "disjoint": ("POLYGON((0 0,1 0,1 1,0 1,0 0))", "POLYGON((5 5,6 5,6 6,5 6,5 5))", False, False, 0, 10),
    "contained": (NINE, SMALL, True, True, 5, 5),
    "in a hole": ("POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,8 1,8 8,1 8,1 1))", SMALL, True, False, 0, 15),
    "envelopes only": ("POLYGON((0 0,4 0,0 4,0 0))", "POLYGON((3 3,5 3,5 5,3 5,3 3))", True, False, 0, 9),
    "line and box": ("LINESTRING(-1 2,5 2)", S, True, True, 2, 11),
    "crossing lines": ("LINESTRING(0 0,4 4)", "LINESTRING(0 4,4 0)", True, True, 1, 8),
    "collinear lines": ("LINESTRING(0 0,4 0)", "LINESTRING(2 0,6 0)", True, True, 2, 6),
    "point in box": ("POINT(1 1)", S, True, True, 1, 5),
    "equal points": ("POINT(1 1)", "POINT(1 1)", True, True, 1, 1),
    "equal boxes": (S, S, True, True, 5, 5),
    "multipoint": ("MULTIPOINT((1 1),(9 9))", S, True, True, 1, 6),
}


def layer(spark, *texts, validate="never"):
    return layers.parse_lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, value string"), validate=validate)


def numbered_pairs(spark, side):
    """One side of all pairs in a layer, each in a partition of its own."""
    lines = spark.createDataFrame([(i, i, pair[side]) for i, pair in enumerate(PAIRS.values())], "id long, pid int, value string")
    return layers.stored(layers.parse_lines(lines, validate="never"))


def test_pairs(spark):
    a, b = numbered_pairs(spark, 0), numbered_pairs(spark, 1)
    met = {i for i, pair in enumerate(PAIRS.values()) if pair[2]}
    points = {i: pair[4] for i, pair in enumerate(PAIRS.values())}
    assert {r.left_pid for r in envelope_join(a, b, "partitioned").collect()} == met
    assert {r.left_id for r in envelope_join(a, b, "nested").where("left_id = right_id").collect()} == met
    assert {r.left_pid for r in intersecting_pairs(a, b, "partitioned").collect()} == {i for i, pair in enumerate(PAIRS.values()) if pair[3]}
    shared = {r.left_pid: r.n_points for r in intersections(a, b, "partitioned").collect()}
    assert shared == {i: points[i] for i in met}
    assert {r.left_pid for r in intersections(a, b, "partitioned", keep_empty=False).collect()} == {i for i in met if points[i]}
    assert measure(a, b, "intersection_points", "partitioned").first().value == sum(points[i] for i in met)
    assert measure(a, b, "union_points", "partitioned").first().value == sum(pair[5] for pair in PAIRS.values() if pair[2])
    assert measure(a, b, "nonempty", "partitioned").first().value == sum(points[i] > 0 for i in met)
    assert measure(a, b, "intersects", "partitioned").first().value == sum(pair[3] for pair in PAIRS.values())
    both = a.select("id", F.col("geom").alias("l")).join(b.select("id", F.col("geom").alias("r")), "id")
    computed = both.select("id", call("st_npoints", call("st_union", "l", "r")), call("st_intersects", "l", "r"), call("st_npoints", call("st_intersection", "l", "r"))).collect()
    assert {tuple(r) for r in computed} == {(i, pair[5], pair[3], pair[4]) for i, pair in enumerate(PAIRS.values())}


def test_failed_pair_is_skipped(spark):
    bow_tie = layer(spark, "POLYGON((0 0,4 4,4 0,0 4,0 0))")
    got = measure(bow_tie, layer(spark, "POLYGON((1 0,3 0,3 4,1 4,1 0))"), "intersection_points").first()
    assert (got.value, got.skipped) == (0, 1)


def test_lines(spark):
    nested = "GEOMETRYCOLLECTION(MULTIPOLYGON(((0 0,1 0,1 1,0 0))),POINT(1 1))"
    lines = ["", "abcde", "POLYGON((0 0,1 0,1 1))", "MULTIPOINT((1 1),(2 2))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", nested, "POLYGON EMPTY", "POINT Z(1 2 3)", None]
    got = layer(spark, *lines).orderBy("id", "part").collect()
    assert [(r.id, r.geom_type) for r in got] == [(3, "MultiPoint"), (4, "Polygon"), (4, "Polygon"), (5, "MultiPolygon"), (5, "Point"), (6, "Polygon"), (7, "Point")]
    assert got[5].xmin is None and (got[6].xmin, got[6].ymax) == (1.0, 2.0)
    everything = layer(spark, NINE)
    assert envelope_join(layer(spark, "POLYGON EMPTY"), everything).count() == 0


@pytest.mark.parametrize("n,kept", [(199, 199), (200, 199)])
def test_validity_starts_at_200_lines(spark, n, kept):
    texts = ["POLYGON((0 0,4 4,4 0,0 4,0 0))"] + [S] * (n - 1)
    assert layer(spark, *texts, validate="auto").count() == kept
    assert layer(spark, *texts, validate="always").count() == n - 1
    assert layer(spark, *texts, validate="never").count() == n


def test_files(spark, tmp_path):
    register(spark)
    (tmp_path / "a.txt").write_text(f"{S}\nshort\n{NINE}\n")
    assert layers.read_wkt(spark, str(tmp_path / "a.txt")).count() == 2
    hexes = [r[0] for r in layer(spark, S, "POINT(1 1)").select(F.hex("geom")).collect()]
    (tmp_path / "h.txt").write_text("\n".join([*hexes, "00zz00zz"]))
    assert layers.read_wkb_hex(spark, str(tmp_path / "h.txt")).count() == 2
    (tmp_path / "e.txt").write_text("1 2 3 4 \n1 2 3\n5 6 7 8 \n")
    assert sorted(tuple(r) for r in layers.read_envelopes(spark, str(tmp_path / "e.txt")).collect()) == [(1, 2, 3, 4), (5, 6, 7, 8)]
    (tmp_path / "w.txt").write_text("1 2 3 4 9\n1 2 3 4 x\n")
    assert [tuple(r) for r in layers.read_envelopes(spark, str(tmp_path / "w.txt"), weighted=True).collect()] == [(1, 2, 3, 4, 9)]
    for i in (0, 1):
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "p" / f"part{i}").write_text(f"{S}\n{NINE}\n")
    parts = layers.read_partitioned(spark, str(tmp_path / "p"))
    assert sorted((r.pid, r.xmax) for r in parts.collect()) == [(0, 4.0), (0, 9.0), (1, 4.0), (1, 9.0)]
    # replicated geometries count once for each shared partition, but once in a grid join
    assert measure(parts, parts, "intersects", "partitioned").first().value == 8
    assert measure(layer(spark, S), layer(spark, NINE), "intersects").first().value == 1


def test_stream(spark, tmp_path):
    from tessera.streaming.probe import probe_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("POINT(1 1)\nPOINT(20 20)\n")
    lines = spark.readStream.text(str(tmp_path / "in")).withColumn("id", F.crc32(F.col("value").cast("binary")))
    found = probe_stream(layers.parse_lines(lines), layer(spark, S, NINE), cell=4.0)
    query = found.select("left_xmin", "right_id").writeStream.format("memory").queryName("probed").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("probed").collect()) == [(1.0, 0), (1.0, 1)]


def preparations(spark):
    register(spark)
    return spark.range(1).select(call("st_preparations", "id")).first()[0]


def test_geometries_stay_out_of_the_cells(spark):
    a, b = layers.stored(layer(spark, S, SMALL, NINE)), layers.stored(layer(spark, NINE, S))
    pairs = candidate_pairs(a, b)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not any("geom#" in line for line in plan.splitlines() if "Relation" not in line)
    plan = intersections(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("st_intersection_each(") == 1
    assert candidate_runs(a, b).count() == 2


def test_a_right_geometry_is_prepared_once_a_run(spark):
    many = layers.stored(layer(spark, *[f"POINT({i % 9} {i % 7})" for i in range(400)]))
    square = lambda low, high: f"POLYGON(({low} {low},{high} {low},{high} {high},{low} {high},{low} {low}))"
    few = layers.stored(layer(spark, square(-0.5, 9), square(-1, 12), square(-0.25, 4)))  # which no other test has prepared
    n = candidate_runs(many, few).count()
    before = preparations(spark)
    met = intersecting_pairs(many, few).count()
    assert met == 400 + 400 + sum(i % 9 <= 4 and i % 7 <= 4 for i in range(400))
    assert 3 <= preparations(spark) - before <= n
    assert refine(candidate_runs(many, few), "st_intersects_each", "met").count() == met


def test_runs_have_a_share_of_the_cost(spark, monkeypatch):
    from tessera.operators import fetch

    monkeypatch.setattr(fetch, "RUN_COST", 1)
    ring = ",".join(f"{x} {y}" for x, y in [(i / 10, 0) for i in range(5000)] + [(500, 5), (0, 5), (0, 0)])
    heavy = layers.stored(layer(spark, f"POLYGON(({ring}))", *[S] * 20))
    many = layers.stored(layer(spark, *[f"POINT({i % 400} 1)" for i in range(3000)]))
    found = candidate_pairs(many, heavy)
    cut = fetch.cut(found, tasks=8)
    total = cut.agg(F.sum("__cost")).first()[0]
    runs = cut.groupBy(fetch.RIGHT_ROW, "__cut").agg(F.sum("__cost").alias("cost"), F.count("*").alias("n"))
    most = runs.agg(F.max("cost"), F.sum("n"), F.max("n")).first()
    largest = cut.agg(F.max("__cost")).first()[0]
    assert most[0] <= 2 * total / (8 * fetch.RUNS_A_TASK) + largest
    assert most[1] == found.count() and most[2] <= 2 * fetch.RUN_PAIRS
    monkeypatch.setattr(fetch, "RUN_COST", 1 << 20)
    monkeypatch.setattr(fetch, "RUN_PAIRS", 3)
    assert fetch.cut(found, 8).groupBy(fetch.RIGHT_ROW, "__cut").count().agg(F.avg("count")).first()[0] <= 3.2
    assert intersecting_pairs(many, heavy).count() == intersecting_pairs(many, heavy, "nested").count() == 3000 + 20 * sum(i % 400 <= 4 for i in range(3000))


def test_tasks_cost_about_the_same(spark):
    """One polygon of 100,000 points that meets everything, beside small ones: costs of the tasks that compare."""
    import math

    from tessera.operators.fetch import runs

    n = 100_000
    circle = ring([(50 + 60 * math.cos(2 * math.pi * i / n), 50 + 60 * math.sin(2 * math.pi * i / n)) for i in range(n)])
    large = layers.stored(layer(spark, f"POLYGON({circle})", *[f"POLYGON(({i} 0,{i + 1} 0,{i + 1} 100,{i} 100,{i} 0))" for i in range(100)]))
    many = layers.stored(layer(spark, *[f"POINT({i % 100} {i // 100})" for i in range(5000)]))
    found = runs(candidate_pairs(many, large), many, large, tasks=8)
    cost = F.expr("aggregate(lefts, 0D, (sum, x) -> sum + (x.left_points + 16D) * (right_points + 16D))")
    costs = sorted(r[1] for r in found.groupBy(F.spark_partition_id()).agg(F.sum(cost)).collect())
    assert len(costs) == 8 and costs[-1] <= 3 * costs[4]


def ring(points):
    return "(" + ",".join(f"{x!r} {y!r}" for x, y in [*points, points[0]]) + ")"


def test_tiles_decide_as_whole_geometries_do(spark):
    """A wavy polygon with holes, a multipolygon and small shapes, against points, boxes and lines on and off their edges."""
    import math

    def wave(n, r, cx, cy):
        return [(cx + (r + math.sin(9 * a) * r / 5) * math.cos(a), cy + (r + math.sin(9 * a) * r / 5) * math.sin(a)) for a in (2 * math.pi * i / n for i in range(n))]

    one, hole, star = wave(3000, 40, 50, 50), wave(500, 9, 45, 52), wave(800, 20, 130, 40)
    texts = [f"POLYGON({ring(one)},{ring(hole)})", f"MULTIPOLYGON(({ring(star)}),((0 0,3 0,3 3,0 3,0 0)))", NINE, "POLYGON((0 0,200 0,200 0.5,0 0.5,0 0))", "LINESTRING(0 0,150 90)", "POLYGON((0 0,4 4,4 0,0 4,0 0))"]
    edge = [f"POINT({x!r} {y!r})" for x, y in [*one[::300], *hole[::90], *star[::100]]]
    spots = [f"POINT({x} {y})" for x in range(0, 160, 9) for y in range(0, 100, 9)]
    boxes = [f"POLYGON(({x} {y},{x + 6} {y},{x + 6} {y + 6},{x} {y + 6},{x} {y}))" for x in range(0, 160, 17) for y in range(0, 100, 13)]
    many = layers.stored(layer(spark, *edge, *spots, *boxes, "LINESTRING(44 52,46 52)", "MULTIPOINT((45 52),(500 500))", "POLYGON EMPTY"))
    large = layers.stored(layer(spark, *texts))
    pairs = lambda df: sorted((r.left_id, r.right_id, r.right_part, r.left_xmin, r.right_xmax, r.right_geom_type) for r in df.collect())
    want = pairs(intersecting_pairs(many, large))
    assert pairs(intersecting_pairs(many, large, most_points=32)) == want
    assert pairs(intersecting_pairs(many, large, "tree", most_points=1)) == want and len(want) == 186
    from tessera.operators.tiles import decided, tiled

    tiles = tiled(large, 32)
    assert tiles.count() > 150 and tiles.where("__full").count() > 50
    met = decided(candidate_pairs(many, tiles))
    of_points = lambda df, x="true": df.where(f"right_id = 0 and left_points = 1 and {x}").count()
    tried, every = of_points(met, "not __sure"), of_points(candidate_pairs(many, large))
    assert tried + of_points(met, "__sure") < every and tried <= every / 2  # of a wavy edge, and points on it


def test_files_of_other_partitions_are_not_opened(spark, tmp_path):
    for i in (0, 1, 11, 21, 3):
        (tmp_path / f"a{i}.txt").write_text(f"POINT({i} {i})\n")
    folder = str(tmp_path)
    assert sorted(r.pid for r in layers.read_partitioned(spark, folder).collect()) == [0, 1, 3, 11, 21]
    (tmp_path / "a4.txt.gz").write_bytes(b"broken: whoever opens it fails")
    with pytest.raises(Exception, match="gzip|GZIP"):
        layers.read_partitioned(spark, folder).collect()
    some = layers.read_partitioned(spark, folder, pids=[1, 3])
    assert sorted((r.pid, r.xmin) for r in some.collect()) == [(1, 1.0), (3, 3.0)]
    assert layers.read_partitioned(spark, folder, pids=[]).count() == 0
    (tmp_path / "odd.txt").write_text("POINT(1 1)\n")
    with pytest.raises(Exception, match="no partition number"):
        layers.read_partitioned(spark, folder, pids=[1]).collect()
    import numpy as np

    from tessera.operators.regions import Regions

    inf = float("inf")
    assert Regions(np.array([[-inf, -inf, 0, inf], [0, -inf, inf, 5], [0, 5, inf, inf]])).meeting(0, 6, 9, 9) == [0, 2]
