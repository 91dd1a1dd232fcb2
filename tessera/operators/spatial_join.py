"""Joins of two layers by exact geometry: envelope candidates on plain columns, then refinement run by run; light rows are refined within their cells. A pair that cannot be computed is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import call, register
from tessera.operators import grid
from tessera.operators.envelope_join import ENVELOPE, KNOWN, MEET, Strategy, candidate_pairs
from tessera.operators.fetch import ROW, each_pair, fetched, numbered, runs
from tessera.operators.light import cell_runs, light
from tessera.operators.regions import Regions
from tessera.operators.tiles import CODES, coded, decided, tiled
from tessera.scratch import Scratch


def candidate_runs(left: DataFrame, right: DataFrame, strategy: Strategy = "grid", cell: float | None = None, regions: Regions | None = None, bare: bool = False) -> DataFrame:
    """Candidates as runs of a right row and some of its left ones, with their geometries; ``bare`` runs have no other columns but row numbers and points.

    By grid or partitions, pairs of light rows are run within their cells (``operators.light``); all others are found on plain columns and fetched for, see ``fetch.runs``.
    """
    register(left.sparkSession)
    left, right = numbered(left), numbered(right)
    if bare:
        left, right = (layer.select(*[c for c in (ROW, "points", *ENVELOPE, "pid", "geom") if c in layer.columns]) for layer in (left, right))
    if strategy not in ("grid", "partitioned"):
        return _fetched_runs(left, right, strategy, cell, regions, bare)
    (light_left, heavy_left), (light_right, heavy_right) = (_by_weight(layer) for layer in (left, right))
    found = [_light_runs(light_left, light_right, strategy, cell, regions, bare)]
    found += [_fetched_runs(a, b, strategy, cell, regions, bare) for a, b in ((heavy_left, right), (light_left, heavy_right)) if a is not None and b is not None]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more.select(*[F.col(f"`{c}`") for c in out.columns if c != "lefts"], F.transform("lefts", lambda x: F.struct(*[x[f.name].alias(f.name) for f in out.schema["lefts"].dataType.elementType])).alias("lefts")))
    return out


def _by_weight(layer: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The layer's light rows, and the others if there are any."""
    is_light = light(layer)
    others = layer.where(f"not ({is_light})")
    return (layer, None) if others.isEmpty() else (layer.where(is_light), others)


def _light_runs(left: DataFrame, right: DataFrame, strategy: Strategy, cell: float | None, regions: Regions | None, bare: bool) -> DataFrame:
    left, right = left.where(KNOWN), right.where(KNOWN)
    shape = grid.find(left.select(*ENVELOPE), right.select(*ENVELOPE), cell, most_broad=0)
    wanted = tuple([c for c in layer.columns if not bare or c in (ROW, "points", "geom")] for layer in (left, right))
    return cell_runs(left, right, shape, MEET, strategy == "partitioned", regions, wanted)


def _fetched_runs(left: DataFrame, right: DataFrame, strategy: Strategy, cell: float | None, regions: Regions | None, bare: bool) -> DataFrame:
    pairs = candidate_pairs(left, right, strategy, cell, regions)
    if bare:
        pairs = pairs.select(*[c for p in ("left_", "right_") for c in (f"{p}{ROW}", f"{p}points") if c in pairs.columns])
        left, right = (layer.select(ROW, "geom") for layer in (left, right))
    return runs(pairs, left, right)


def refine(found: DataFrame, function: str, result: str) -> DataFrame:
    """The pairs of runs with ``result``, a function of a run's left geometries and its right one, which is computed once for each run."""
    return each_pair(found.withColumn(result, call(function, F.col("lefts.left_geom"), F.col("right_geom"))), result)


def _without_rows(pairs: DataFrame) -> DataFrame:
    return pairs.drop(f"left_{ROW}", f"right_{ROW}")


def intersecting_pairs(left: DataFrame, right: DataFrame, strategy: Strategy = "grid", cell: float | None = None, regions: Regions | None = None, most_points: int | None = None) -> DataFrame:
    """Pairs whose geometries intersect, with both layers' columns.

    With ``most_points``, right polygons of more points are held against in tiles first (``operators.tiles``); heavy ones are fetched only for pairs that tiles don't decide.
    """
    if most_points is not None:
        return _by_tiles(left, right, strategy, cell, most_points)
    pairs = refine(candidate_runs(left, right, strategy, cell, regions), "st_intersects_each", "__met")
    return _without_rows(pairs.where("__met").drop("__met"))


def _by_tiles(left: DataFrame, right: DataFrame, strategy: Strategy, cell: float | None, most_points: int) -> DataFrame:
    if strategy == "partitioned":
        raise ValueError("tiles are for strategies that meet each pair, not for partitions")
    register(left.sparkSession)
    left, right = numbered(left), numbered(right)
    if strategy != "grid":
        return _without_rows(_fetched_by_tiles(left, right, strategy, cell, most_points))
    (light_left, heavy_left), (light_right, heavy_right) = (_by_weight(layer) for layer in (left, right))
    near = _light_runs(light_left, coded(light_right, most_points), strategy, cell, None, False)
    met = call("st_intersects_each_by_tiles", F.col("lefts.left_geom"), F.col("right_geom"), F.col(f"right_{CODES}"))
    out = each_pair(near.withColumn("__met", met).drop(f"right_{CODES}"), "__met").where("__met").drop("__met")
    for a, b in ((heavy_left, right), (light_left, heavy_right)):
        if a is not None and b is not None:
            out = out.unionByName(_fetched_by_tiles(a, b, strategy, cell, most_points))
    return _without_rows(out)


def _fetched_by_tiles(left: DataFrame, right: DataFrame, strategy: Strategy, cell: float | None, most_points: int) -> DataFrame:
    tiles = Scratch(left.sparkSession).table(tiled(right, most_points), keep=True)
    met = Scratch(left.sparkSession).table(decided(candidate_pairs(left, tiles, strategy, cell)), keep=True)
    sure = fetched(met.where("__sure").drop("__sure"), left, right)
    tried = refine(runs(met.where("not __sure").drop("__sure"), left, right), "st_intersects_each", "__met").where("__met").drop("__met")
    return sure.unionByName(tried)


def intersections(left: DataFrame, right: DataFrame, strategy: Strategy = "grid", cell: float | None = None, keep_empty: bool = True, regions: Regions | None = None) -> DataFrame:
    """All candidates with what their geometries share: ``geom``, ``geom_type``, ``n_points`` and its envelope; an empty result is a row unless ``keep_empty`` is False."""
    pairs = refine(candidate_runs(left, right, strategy, cell, regions), "st_intersection_each", "__shared").where("__shared is not null")
    out = _without_rows(pairs).select("*", "__shared.*").drop("__shared")
    return out if keep_empty else out.where("n_points > 0")
