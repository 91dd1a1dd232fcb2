"""Measures: a join of two layers reduced to one number, ``value``; ``skipped`` counts the pairs that could not be computed.

``intersection_points``  points of all candidates' intersections
``intersects``           pairs that intersect
``union_points``         points of all candidates' unions, of pairs that don't intersect too
``nonempty``             candidates whose intersection isn't empty
"""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import call
from tessera.operators.envelope_join import Strategy
from tessera.operators.regions import Regions
from tessera.operators.spatial_join import candidate_runs

Measure = Literal["intersection_points", "intersects", "union_points", "nonempty"]
_FUNCTION = {"intersection_points": "st_intersection_npoints_each", "intersects": "st_intersects_each", "union_points": "st_union_npoints_each", "nonempty": "st_intersection_npoints_each"}


def measure(left: DataFrame, right: DataFrame, what: Measure = "intersection_points", strategy: Strategy = "grid", cell: float | None = None, regions: Regions | None = None) -> DataFrame:
    """One row: ``value`` and ``skipped``, both long."""
    each = candidate_runs(left, right, strategy, cell, regions, bare=True).select(F.explode(call(_FUNCTION[what], F.col("lefts.left_geom"), F.col("right_geom"))).alias("m"))
    m = F.col("m")
    value = (m > 0).cast("long") if what == "nonempty" else m.cast("long")
    return each.agg(F.coalesce(F.sum(value), F.lit(0)).alias("value"), F.count_if(m.isNull()).alias("skipped"))
