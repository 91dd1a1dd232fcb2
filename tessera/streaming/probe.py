"""A stream of geometries held against a static layer: stateless, so nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import call, register
from tessera.operators import grid
from tessera.operators.envelope_join import KNOWN, MEET


def probe_stream(stream: DataFrame, layer: DataFrame, cell: float | None = None) -> DataFrame:
    """Pairs of a streamed row and a row of the layer that intersect, by the layer's grid.

    The stream's rows are clamped to the layer's extent, so that each is listed in few cells, at the levels that the layer has. Geometries are compared only
    where envelopes meet, once.
    """
    register(layer.sparkSession)
    a, b = (df.where(KNOWN).select(*[F.col(f"`{c}`").alias(f"{p}{c}") for c in df.columns]) for p, df in (("left_", stream), ("right_", layer)))
    shape = grid.for_any(layer.where(KNOWN), cell)
    if shape is None:
        return a.join(b, F.lit(False))
    keys = ["__level", "__cx", "__cy"]
    met = grid.listed(a, "left_", "left", shape).join(grid.listed(b, "right_", "right", shape), keys).where(MEET).where(grid.met_once(shape)).drop(*keys, "__left_level", "__right_level")
    # a generated column: the comparison can't move into the join, before the envelopes' test
    return met.select("*", F.explode(F.array(call("st_intersects", "left_geom", "right_geom"))).alias("__met")).where("__met").drop("__met")
