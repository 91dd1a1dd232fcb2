"""Large polygons as many rows: tiles that decide most pairs on envelopes alone.

A polygon's envelope is quartered, and its quarters again, as deep as its number of points asks for. Quarters that the polygon doesn't meet are left out, and those
that lie in it whole are full. A pair of a row and a polygon then needs the polygon itself only where the row's envelope meets border tiles and lies in no full one: if it
meets no tile the pair doesn't intersect, and if it lies in a full one it does. Both tests are of boxes with the polygon as it is, nothing is clipped, so results are those of the whole geometries.

Light polygons aren't made rows: their tiles are a few bytes that go with them into the cells (``coded``), where pairs are decided without being written or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import register
from tessera.operators.fetch import LEFT_ROW, RIGHT_ROW, is_plain

ENVELOPE = ("xmin", "ymin", "xmax", "ymax")
DEEPEST = 7  # quarterings, 16384 tiles at most
CODES = "__tiles"


def _depth(most_points: int) -> str:
    return f"cast(least({DEEPEST}, greatest(0, ceil(log(greatest(points, 1) / {float(most_points)}D) / log(4D)))) as int)"


def tiled(layer: DataFrame, most_points: int) -> DataFrame:
    """A numbered layer's plain columns, a row for each tile: its envelope in place of the geometry's, which is kept as ``__own_...``, and ``__full``.

    A geometry of up to ``most_points`` is one tile; beyond that tiles are as small as gives each about so many points if they were spread evenly.
    """
    register(layer.sparkSession)
    plain = [f.name for f in layer.schema if is_plain(f) and f.name not in ENVELOPE]
    own = [f"{c} as __own_{c}" for c in ENVELOPE]
    # a broken geometry is its envelope
    found = f"coalesce(st_tiles(geom, {_depth(most_points)}), array(named_struct('xmin', xmin, 'ymin', ymin, 'xmax', xmax, 'ymax', ymax, 'full', false)))"
    large = layer.where(f"points > {most_points}").selectExpr(*[f"`{c}`" for c in plain], *own, f"inline({found})").withColumnRenamed("full", "__full")
    small = layer.where(f"points <= {most_points} or points is null").selectExpr(*[f"`{c}`" for c in plain], *own, *ENVELOPE, "false as __full")
    return large.unionByName(small)


def coded(layer: DataFrame, most_points: int) -> DataFrame:
    """The layer with ``CODES``, the same tiles in a few bytes; null where the geometry is to be held against as it is."""
    register(layer.sparkSession)
    return layer.withColumn(CODES, F.expr(f"if(points > {most_points}, st_tile_codes(geom, {_depth(most_points)}), null)"))


def decided(pairs: DataFrame) -> DataFrame:
    """Pairs of rows and tiles as pairs of rows, once each, with ``__sure``: whether the left row's envelope lies in a full tile. The right envelope is the geometry's again."""
    inside = "right___full and left_xmin >= right_xmin and left_xmax <= right_xmax and left_ymin >= right_ymin and left_ymax <= right_ymax"
    others = [c for c in pairs.columns if c not in (LEFT_ROW, RIGHT_ROW, "right___full", *(f"right_{c}" for c in ENVELOPE))]
    # a pair's rows differ by tile only, so any one of them has its columns
    once = pairs.groupBy(LEFT_ROW, RIGHT_ROW).agg(F.expr(f"bool_or({inside}) as __sure"), *[F.expr(f"first(`{c}`) as `{c}`") for c in others])
    return once.withColumnsRenamed({f"right___own_{c}": f"right_{c}" for c in ENVELOPE})
