"""Queries over layers of boxes derived from the tables, and the same in SQL by closed forms."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.geometry import call, register
from tessera.operators.envelope_join import Strategy, candidate_pairs
from tessera.operators.regions import Regions, find_regions, write_partitions
from tessera.operators.spatial_join import intersecting_pairs, intersections
from tessera.plans.measures import measure
from tessera.scratch import Scratch
from tessera.sources.layers import parse_envelopes, parse_lines, read_partitioned, read_wkb_hex, read_wkt, stored

# The two box layers, in SQL that Spark and DuckDB read alike.
LAYER_A = """SELECT p_partkey AS id, (p_partkey * p_partkey * 31 + p_partkey * 17) % 1009 AS x1, (p_partkey * p_partkey * p_partkey * 13 + p_partkey * 5) % 1013 AS y1,
    1 + p_size % 7 AS w, 1 + p_size % 5 AS h, CAST(p_partkey % 8 AS INT) AS pid FROM part"""
LAYER_B = """SELECT c_custkey AS id, (c_custkey * c_custkey * 43 + c_custkey * 19) % 1009 AS x1, (c_custkey * c_custkey * c_custkey * 7 + c_custkey * 23) % 1013 AS y1,
    1 + c_nationkey % 9 AS w, 1 + c_nationkey % 6 AS h, CAST(c_custkey % 8 AS INT) AS pid FROM customer"""


def _boxes(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    """The layer's rows. Keys are reduced before they are multiplied, as cubes of large ones don't fit a long; a remainder has its key's sign, so ``x1`` and ``y1`` come out the same."""
    for key in ("p_partkey", "c_custkey"):
        sql = re.sub(rf"\(({key} \* [^()]*)\) % (\d+)", lambda m: f"({m[1].replace(key, f'({key} % {m[2]})')}) % {m[2]}", sql)
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _spread(rows: DataFrame) -> DataFrame:
    """The rows of a table of few files, which few tasks read, dealt to more: parsing takes longer."""
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, 12)
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def _box_wkt(x1: str = "x1", y1: str = "y1") -> str:
    a, b, c, d = f"({x1})", f"({y1})", f"({x1} + w)", f"({y1} + h)"
    ring = [(a, b), (c, b), (c, d), (a, d), (a, b)]
    return "concat('((', " + ", ',', ".join(f"{x}, ' ', {y}" for x, y in ring) + ", '))')"


def layer(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Layer a (from part) or b (from customer), parsed from WKT."""
    register(spark)
    table, sql = {"a": ("part", LAYER_A), "b": ("customer", LAYER_B)}[which]
    lines = _spread(_boxes(spark, sf_dir, table, sql)).selectExpr("id", "pid", f"concat('POLYGON', {_box_wkt()}) AS value")
    return parse_lines(lines)


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both layers, parsed once and stored, side by side."""
    parsed = [layer(spark, sf_dir, which) for which in "ab"]
    with ThreadPoolExecutor(2) as pool:
        return tuple(pool.map(stored, parsed))


def _lines(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Lines of a layer, each with its partition number: boxes of WKT."""
    table, sql = {"a": ("part", LAYER_A), "b": ("customer", LAYER_B)}[which]
    return _boxes(spark, sf_dir, table, sql).selectExpr("pid", f"concat('POLYGON', {_box_wkt()}) AS value")


def _written(spark: SparkSession, lines: DataFrame, name: str | None = None) -> str:
    """A folder of text files; with a name, one file for each ``pid``, named with its number."""
    folder = Scratch(spark).folder(keep=True)
    if name is None:
        lines.select("value").write.text(folder)
        return folder
    lines.repartition("pid").write.partitionBy("pid").text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in files.listStatus(path(folder)):
        at = part.getPath()
        if at.getName().startswith("pid="):
            for f in files.listStatus(at):
                if f.getPath().getName().startswith("part-"):
                    files.rename(f.getPath(), path(at.getParent(), f"{name}{at.getName().removeprefix('pid=')}"))
            files.delete(at, True)
    return folder


_GEOMETRY = ("geom_type", "xmin", "ymin", "xmax", "ymax")


def read_wkt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WKT files read in parallel, validity as the number of lines says: here there are 200 and more, so bow ties are dropped."""
    bow_ties = "SELECT 0 AS pid, 'POLYGON((0 0,4 4,4 0,0 4,0 0))' AS value"
    return read_wkt(spark, _written(spark, _lines(spark, sf_dir, "a").unionByName(spark.sql(bow_ties))), validate="auto").select(*_GEOMETRY)


def read_few_wkt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under 200 lines, so invalid geometries stay: a bow tie for each nation."""
    lines = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("concat('POLYGON((', n_nationkey, ' 0,', n_nationkey + 4, ' 4,', n_nationkey + 4, ' 0,', n_nationkey, ' 4,', n_nationkey, ' 0))') AS value")
    return read_wkt(spark, _written(spark, lines), validate="auto").select(*_GEOMETRY)


def read_wkb_hex_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return read_wkb_hex(spark, _written(spark, _lines(spark, sf_dir, "b").selectExpr("hex(st_geomfromtext(value)) AS value"))).select(*_GEOMETRY)


def join_partition_files_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of numbered partition files, joined within equal numbers."""
    a, b = (stored(read_partitioned(spark, _written(spark, _lines(spark, sf_dir, which), which))) for which in "ab")
    return measure(a, b, "intersection_points", "partitioned")


def _shapes_and_rings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points, level lines and pairs of points, by turns; boxes that have a hole."""
    register(spark)
    shape = "CASE id % 3 WHEN 0 THEN concat('POINT(', x1, ' ', y1, ')') WHEN 1 THEN concat('LINESTRING(', x1, ' ', y1, ',', x1 + w, ' ', y1, ')') ELSE concat('MULTIPOINT((', x1, ' ', y1, '),(', x1 + w, ' ', y1, '))') END"
    shapes = parse_lines(_spread(_boxes(spark, sf_dir, "part", LAYER_A)).selectExpr("id", f"{shape} AS value"))
    outer = "(x1, ' ', y1, ',', x1 + 20, ' ', y1, ',', x1 + 20, ' ', y1 + 20, ',', x1, ' ', y1 + 20, ',', x1, ' ', y1)"
    hole = "(x1 + 4, ' ', y1 + 4, ',', x1 + 16, ' ', y1 + 4, ',', x1 + 16, ' ', y1 + 16, ',', x1 + 4, ' ', y1 + 16, ',', x1 + 4, ' ', y1 + 4)"
    rings = parse_lines(_spread(_boxes(spark, sf_dir, "customer", LAYER_B)).selectExpr("id", f"concat('POLYGON((', concat{outer}, '),(', concat{hole}, '))') AS value"))
    return stored(shapes), stored(rings)


def join_shapes_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intersecting_pairs(*_shapes_and_rings(spark, sf_dir)).select("left_id", "right_id")


def join_tiles_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by tiles of the boxes: what lies in the hole, or wholly beside it, is decided on envelopes."""
    return intersecting_pairs(*_shapes_and_rings(spark, sf_dir), most_points=1).select("left_id", "right_id")


def envelope_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_pairs(*_layers(spark, sf_dir)).select("left_id", "right_id")


def _candidates(strategy: Strategy) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: candidate_pairs(*_layers(spark, sf_dir), strategy).select("left_id", "right_id")


def _in_regions(spark: SparkSession, sf_dir: str, parts: int, weight: str | None = None) -> tuple[DataFrame, DataFrame, Regions]:
    """Both layers written in regions' partitions, and read again."""
    layers = [layer.withColumnRenamed("pid", "weight") for layer in _layers(spark, sf_dir)]
    regions = find_regions(layers, parts, weight)
    paths = [Scratch(spark).folder(keep=True) for _ in layers]
    for layer, path in zip(layers, paths, strict=True):
        write_partitions(layer, regions, path)
    a, b = (spark.read.parquet(path) for path in paths)
    return a, b, regions


def join_regions_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers written in 16 regions of about as many rows, joined within equal regions."""
    a, b, regions = _in_regions(spark, sf_dir, 16)
    return measure(a, b, "intersection_points", "partitioned", regions=regions)


def join_weighted_regions_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the rows' weight, as numbers that come with envelopes say it."""
    a, b, regions = _in_regions(spark, sf_dir, 9, "weight")
    return intersecting_pairs(a, b, "partitioned", regions=regions).select("left_id", "right_id")


def join_intersects_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intersecting_pairs(*_layers(spark, sf_dir)).select("left_id", "right_id")


def join_intersection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intersections(*_layers(spark, sf_dir)).select("left_id", "right_id", "geom_type", "n_points", "xmin", "ymin", "xmax", "ymax")


def _measured(what: str, strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: measure(*_layers(spark, sf_dir), what, strategy)


def join_partitioned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intersecting_pairs(*_layers(spark, sf_dir), "partitioned").select("left_id", "right_id", F.col("left_pid").alias("pid"))


def ingest_wkt_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every kind: boxes, pairs of boxes as one multipolygon, collections, short lines and lines that don't parse."""
    two = f"concat('MULTIPOLYGON(', {_box_wkt()}, ',', {_box_wkt('x1 + 50')}, ')')"
    mixed = f"concat('GEOMETRYCOLLECTION(POINT(', x1, ' ', y1, '),POLYGON', {_box_wkt()}, ')')"
    line = f"CASE id % 7 WHEN 1 THEN {two} WHEN 2 THEN {mixed} WHEN 3 THEN 'abcde' WHEN 4 THEN concat('POLYGON((', x1, ' ', y1, '))') WHEN 5 THEN concat('MULTIPOINT((', x1, ' ', y1, '),(', x1 + w, ' ', y1 + h, '))') ELSE concat('POLYGON', {_box_wkt()}) END"
    return parse_lines(_boxes(spark, sf_dir, "part", LAYER_A).selectExpr("id", f"{line} AS value")).select("id", "part", "geom_type", "xmin", "ymin", "xmax", "ymax")


def ingest_wkb_hex_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    text = _boxes(spark, sf_dir, "customer", LAYER_B).selectExpr("id", f"hex(st_geomfromtext(concat('POLYGON', {_box_wkt()}))) AS value")
    return parse_lines(text, parser="st_geomfromwkbhex", validate="never").select("id", "geom_type", "xmin", "ymin", "xmax", "ymax", call("st_npoints", "geom").alias("n_points"))


def ingest_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_envelopes(_boxes(spark, sf_dir, "part", LAYER_A).selectExpr("id", "concat(x1, ' ', x1 + w, ' ', y1, ' ', y1 + h, ' ') AS value"))


def ingest_envelope_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_envelopes(_boxes(spark, sf_dir, "part", LAYER_A).selectExpr("id", "concat(x1, ' ', x1 + w, ' ', y1, ' ', y1 + h, ' ', pid) AS value"), weighted=True)


def geometry_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar function, on layer b."""
    own = layer(spark, sf_dir, "b")
    moved = own.withColumn("other", call("st_geomfromtext", F.concat(F.lit("POINT("), F.col("xmax").cast("long"), F.lit(" "), F.col("ymax").cast("long"), F.lit(")"))))
    return moved.select(
        "id", call("st_isvalid", "geom").alias("valid"), call("st_npoints", "geom").alias("n_points"), call("st_numgeometries", "geom").alias("n_parts"), call("st_geometrytype", "geom").alias("geom_type"),
        call("st_intersects", "geom", "other").alias("touches_corner"), call("st_astext", call("st_intersection", "geom", "other")).alias("corner"), call("st_npoints", call("st_union", "geom", "other")).alias("union_points"), F.size(call("st_dump", "geom")).alias("n_dumped"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "envelope_join_pairs": envelope_join_pairs,
    "join_intersects_pairs": join_intersects_pairs,
    "join_intersection_rows": join_intersection_rows,
    "join_intersection_points": _measured("intersection_points", "grid"),
    "join_intersects_count": _measured("intersects", "grid"),
    "join_union_points": _measured("union_points", "grid"),
    "join_nonempty_count": _measured("nonempty", "grid"),
    "join_partitioned_pairs": join_partitioned_pairs,
    "join_partitioned_points": _measured("intersection_points", "partitioned"),
    "join_partitioned_intersects": _measured("intersects", "partitioned"),
    "join_partitioned_union_points": _measured("union_points", "partitioned"),
    "ingest_wkt_layer": ingest_wkt_layer,
    "ingest_wkb_hex_layer": ingest_wkb_hex_layer,
    "ingest_envelopes": ingest_envelopes,
    "ingest_envelope_weights": ingest_envelope_weights,
    "geometry_functions": geometry_functions,
    "read_wkt_files": read_wkt_files,
    "read_few_wkt_lines": read_few_wkt_lines,
    "read_wkb_hex_files": read_wkb_hex_files,
    "join_partition_files_points": join_partition_files_points,
    "join_shapes_pairs": join_shapes_pairs,
    "join_tiles_pairs": join_tiles_pairs,
    "join_tree_pairs": _candidates("tree"),
    "join_blocks_pairs": _candidates("blocks"),
    "join_tree_points": _measured("intersection_points", "tree"),
    "join_regions_points": join_regions_points,
    "join_weighted_regions_pairs": join_weighted_regions_pairs,
}

_PAIRS = f"""WITH a AS (SELECT id AS left_id, pid AS apid, x1 AS ax1, x1 + w AS ax2, y1 AS ay1, y1 + h AS ay2 FROM ({LAYER_A})),
    b AS (SELECT id AS right_id, pid AS bpid, x1 AS bx1, x1 + w AS bx2, y1 AS by1, y1 + h AS by2 FROM ({LAYER_B})),
    met AS (SELECT *, least(ax2, bx2) - greatest(ax1, bx1) AS dx, least(ay2, by2) - greatest(ay1, by1) AS dy FROM a JOIN b ON ax1 <= bx2 AND bx1 <= ax2 AND ay1 <= by2 AND by1 <= ay2),
    inside AS (SELECT *, CAST(ax1 > bx1 AND ax1 < bx2 AS INT) + CAST(ax2 > bx1 AND ax2 < bx2 AS INT) AS axi, CAST(ay1 > by1 AND ay1 < by2 AS INT) + CAST(ay2 > by1 AND ay2 < by2 AS INT) AS ayi,
        CAST(bx1 > ax1 AND bx1 < ax2 AS INT) + CAST(bx2 > ax1 AND bx2 < ax2 AS INT) AS bxi, CAST(by1 > ay1 AND by1 < ay2 AS INT) + CAST(by2 > ay1 AND by2 < ay2 AS INT) AS byi,
        CAST(ax1 = bx1 AS INT) + CAST(ax1 = bx2 AS INT) + CAST(ax2 = bx1 AS INT) + CAST(ax2 = bx2 AS INT) AS xm, CAST(ay1 = by1 AS INT) + CAST(ay1 = by2 AS INT) + CAST(ay2 = by1 AS INT) + CAST(ay2 = by2 AS INT) AS ym FROM met),
    pairs AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 1 WHEN dx = 0 OR dy = 0 THEN 2 ELSE 5 END AS np_i,
        CASE WHEN dx = 0 AND dy = 0 THEN 10 ELSE 9 - axi * ayi - bxi * byi - xm * ym + axi * byi + bxi * ayi END AS np_u FROM inside)
    """


def _total(of: str, where: str = "true") -> str:
    return _PAIRS + f"SELECT CAST(coalesce(sum({of}), 0) AS BIGINT) AS value, CAST(0 AS BIGINT) AS skipped FROM pairs WHERE {where}"


_A = f"(SELECT *, CAST(x1 AS DOUBLE) AS xmin, CAST(y1 AS DOUBLE) AS ymin, CAST(x1 + w AS DOUBLE) AS xmax, CAST(y1 + h AS DOUBLE) AS ymax FROM ({LAYER_A}))"
_B = f"(SELECT *, CAST(x1 AS DOUBLE) AS xmin, CAST(y1 AS DOUBLE) AS ymin, CAST(x1 + w AS DOUBLE) AS xmax, CAST(y1 + h AS DOUBLE) AS ymax FROM ({LAYER_B}))"

ORACLES: dict[str, str] = {
    "envelope_join_pairs": _PAIRS + "SELECT left_id, right_id FROM pairs",
    "join_intersects_pairs": _PAIRS + "SELECT left_id, right_id FROM pairs",
    "join_intersection_rows": _PAIRS + """SELECT left_id, right_id, CASE np_i WHEN 1 THEN 'Point' WHEN 2 THEN 'LineString' ELSE 'Polygon' END AS geom_type, np_i AS n_points,
        CAST(greatest(ax1, bx1) AS DOUBLE) AS xmin, CAST(greatest(ay1, by1) AS DOUBLE) AS ymin, CAST(least(ax2, bx2) AS DOUBLE) AS xmax, CAST(least(ay2, by2) AS DOUBLE) AS ymax FROM pairs""",
    "join_intersection_points": _total("np_i"),
    "join_tree_pairs": _PAIRS + "SELECT left_id, right_id FROM pairs",
    "join_blocks_pairs": _PAIRS + "SELECT left_id, right_id FROM pairs",
    "join_tree_points": _total("np_i"),
    "join_regions_points": _total("np_i"),
    "join_weighted_regions_pairs": _PAIRS + "SELECT left_id, right_id FROM pairs",
    "join_intersects_count": _total("1"),
    "join_union_points": _total("np_u"),
    "join_nonempty_count": _total("1"),
    "join_partitioned_pairs": _PAIRS + "SELECT left_id, right_id, apid AS pid FROM pairs WHERE apid = bpid",
    "join_partitioned_points": _total("np_i", "apid = bpid"),
    "join_partitioned_intersects": _total("1", "apid = bpid"),
    "join_partitioned_union_points": _total("np_u", "apid = bpid"),
    "ingest_wkt_layer": f"""SELECT id, 0 AS part, CASE id % 7 WHEN 2 THEN 'Point' WHEN 5 THEN 'MultiPoint' ELSE 'Polygon' END AS geom_type, xmin, ymin, CASE id % 7 WHEN 2 THEN xmin ELSE xmax END AS xmax, CASE id % 7 WHEN 2 THEN ymin ELSE ymax END AS ymax
            FROM {_A} WHERE id % 7 NOT IN (3, 4)
        UNION ALL SELECT id, 1, 'Polygon', xmin + CASE id % 7 WHEN 1 THEN 50 ELSE 0 END, ymin, xmax + CASE id % 7 WHEN 1 THEN 50 ELSE 0 END, ymax FROM {_A} WHERE id % 7 IN (1, 2)""",
    "ingest_wkb_hex_layer": f"SELECT id, 'Polygon' AS geom_type, xmin, ymin, xmax, ymax, 5 AS n_points FROM {_B}",
    "ingest_envelopes": f"SELECT id, xmin, xmax, ymin, ymax FROM {_A}",
    "ingest_envelope_weights": f"SELECT id, xmin, xmax, ymin, ymax, pid AS weight FROM {_A}",
    "geometry_functions": f"SELECT id, true AS valid, 5 AS n_points, 1 AS n_parts, 'Polygon' AS geom_type, true AS touches_corner, 'POINT (' || (x1 + w) || ' ' || (y1 + h) || ')' AS corner, 5 AS union_points, 1 AS n_dumped FROM {_B}",
    "read_wkt_files": f"SELECT 'Polygon' AS geom_type, xmin, ymin, xmax, ymax FROM {_A}",
    "read_few_wkt_lines": "SELECT 'Polygon' AS geom_type, CAST(n_nationkey AS DOUBLE) AS xmin, CAST(0 AS DOUBLE) AS ymin, CAST(n_nationkey + 4 AS DOUBLE) AS xmax, CAST(4 AS DOUBLE) AS ymax FROM nation",
    "read_wkb_hex_files": f"SELECT 'Polygon' AS geom_type, xmin, ymin, xmax, ymax FROM {_B}",
    "join_partition_files_points": _total("np_i", "apid = bpid"),
    # A point or a level line meets a box with a hole where it meets the box and isn't inside the hole; of two points one has to.
    "join_shapes_pairs": f"""WITH s AS (SELECT id AS left_id, id % 3 AS kind, x1 AS sx, x1 + w AS ex, y1 AS sy FROM ({LAYER_A})), r AS (SELECT id AS right_id, x1 AS rx, y1 AS ry FROM ({LAYER_B})),
        met AS (SELECT *, sx BETWEEN rx AND rx + 20 AND NOT (sx > rx + 4 AND sx < rx + 16 AND sy > ry + 4 AND sy < ry + 16) AS first, ex BETWEEN rx AND rx + 20 AND NOT (ex > rx + 4 AND ex < rx + 16 AND sy > ry + 4 AND sy < ry + 16) AS last
            FROM s JOIN r ON sx <= rx + 20 AND ex >= rx AND sy BETWEEN ry AND ry + 20)
        SELECT left_id, right_id FROM met WHERE CASE kind WHEN 0 THEN first WHEN 2 THEN first OR last ELSE NOT (sx > rx + 4 AND ex < rx + 16 AND sy > ry + 4 AND sy < ry + 16) END""",
}
ORACLES["join_tiles_pairs"] = ORACLES["join_shapes_pairs"]
