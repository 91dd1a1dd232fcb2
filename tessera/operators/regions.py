"""Regions: the plane cut by a k-d tree of a sample, for writing layers in partitions that a join reads by equal numbers.

The sample's middles are halved by weight, again and again, along the axis that is longer there, until there are as many parts as asked for; outer regions are unbounded,
so the regions tile the plane. A row is in every region that its envelope touches, and so is listed in each: what replication doubles, a join leaves out by the region that
holds the lower left corner of what a pair shares, lower edges being part of a region and upper edges not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.fetch import ROW
from tessera.operators.packed_tree import PackedTree

SAMPLE = 200_000  # rows of both layers that the cuts are made from
ENVELOPE = ("xmin", "ymin", "xmax", "ymax")


@dataclass
class Regions:
    """``boxes``: (n, 4) of xmin, ymin, xmax, ymax; the region numbered i is row i."""

    boxes: np.ndarray

    def meeting(self, xmin: float, ymin: float, xmax: float, ymax: float) -> list[int]:
        """Numbers of the regions that a box meets: those partitions hold whatever can intersect it."""
        b = self.boxes
        return np.flatnonzero((b[:, 0] <= xmax) & (b[:, 2] >= xmin) & (b[:, 1] <= ymax) & (b[:, 3] >= ymin)).tolist()

    def table(self, spark: SparkSession, prefix: str = "") -> DataFrame:
        rows = [(i, *map(float, b)) for i, b in enumerate(self.boxes)]
        return spark.createDataFrame(rows, ", ".join(["pid int", *(f"{prefix}{c} double" for c in ENVELOPE)]))


def read_regions(spark: SparkSession, path: str) -> Regions:
    """Regions whose ``table`` was written as Parquet, beside the partitions that they number."""
    rows = spark.read.parquet(path).orderBy("pid").select(*ENVELOPE).collect()  # a row for each region
    return Regions(np.array([tuple(r) for r in rows], np.float64).reshape(-1, 4))


def _sampled(layer: DataFrame, most: int, weight: str | None) -> DataFrame:
    """At most about ``most`` rows, each with its middle and weight, by a hash of the envelope and row so that it is the same each time."""
    known = layer.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in ENVELOPE))
    n = known.count()
    middles = known.select((F.col("xmin") / 2 + F.col("xmax") / 2).alias("x"), (F.col("ymin") / 2 + F.col("ymax") / 2).alias("y"), (F.expr(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    return middles if n <= most else middles.sample(fraction=most / n, seed=7)


def find_regions(layers: list[DataFrame], parts: int, weight: str | None = None, sample: int = SAMPLE) -> Regions:
    """``parts`` regions of about equal weight (of a row, in SQL; 1 by default) by a sample of at most about ``sample`` rows of the layers together."""
    each = [_sampled(layer, sample // len(layers), weight).toArrow() for layer in layers]  # bounded by ``sample``
    x, y, w = (np.concatenate([t.column(c).to_numpy() for t in each]) for c in ("x", "y", "w"))
    return Regions(np.array(cut_plane(x, y, np.maximum(np.nan_to_num(w), 0.0), parts)).reshape(-1, 4))


def cut_plane(x: np.ndarray, y: np.ndarray, w: np.ndarray, parts: int) -> list[tuple[float, float, float, float]]:
    """Boxes that tile the plane; fewer than ``parts`` where places are too few to be told apart."""
    done = []
    waiting = [(np.arange(len(x)), parts, (-np.inf, -np.inf, np.inf, np.inf))]
    while waiting:
        rows, n, box = waiting.pop()
        cuts = []
        if n > 1 and len(rows) > 1:
            spans = [np.ptp(x[rows]), np.ptp(y[rows])]
            cuts = [axis for axis in np.argsort(spans)[::-1] if spans[axis] > 0]
        if not cuts:
            done.append(box)
            continue
        axis, at = int(cuts[0]), (x, y)[int(cuts[0])]
        order = rows[np.argsort(at[rows], kind="stable")]
        share = np.cumsum(w[order]) if w[order].sum() > 0 else np.arange(1.0, len(order) + 1)
        low = n // 2
        place = int(np.searchsorted(share, share[-1] * low / n))
        values = at[order]
        # the edge lies between two different places, as near to the share as there are any
        steps = np.flatnonzero(np.diff(values) > 0) + 1
        k = int(steps[np.argmin(np.abs(steps - (place + 1)))])
        edge = float(values[k])
        first, second = list(box), list(box)
        first[axis + 2] = second[axis] = edge
        waiting += [(order[:k], low, tuple(first)), (order[k:], n - low, tuple(second))]
    return done


def replicated(layer: DataFrame, regions: Regions) -> DataFrame:
    """The layer's rows with ``pid``, once for each region that their envelope touches; rows without an envelope are in none."""
    shared = layer.sparkSession.sparkContext.broadcast(PackedTree(regions.boxes))  # as large as the number of regions
    kept = [f for f in layer.schema if f.name not in ("pid", ROW)]  # a row number would name several rows
    schema = T.StructType([*kept, T.StructField("pid", T.IntegerType())])
    known = layer.where(" and ".join(f"{c} is not null and not isnan({c})" for c in ENVELOPE)).select(*[F.col(f"`{f.name}`") for f in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            boxes = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ENVELOPE])
            for rows, regions in tree.probe(boxes):
                for lo in range(0, len(rows), 4096):
                    part = batch.take(pa.array(rows[lo : lo + 4096]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(regions[lo : lo + 4096].astype(np.int32))], schema.names)

    return known.mapInArrow(run, schema)


def write_partitions(layer: DataFrame, regions: Regions, path: str) -> None:
    """The layer's rows, numbered, in each of their regions, as Parquet in a folder for each ``pid``."""
    replicated(layer, regions).repartition("pid").withColumn(ROW, F.monotonically_increasing_id()).write.partitionBy("pid").parquet(path)


def met_in_own(pairs: DataFrame, regions: Regions) -> DataFrame:
    """The pairs whose ``left_pid`` is the region that holds the lower left corner of what their envelopes share."""
    bounds = regions.table(pairs.sparkSession, "__region_").withColumnRenamed("pid", "left_pid")
    inside = F.lit(True)
    for axis in "xy":
        corner, low, high = F.greatest(f"left_{axis}min", f"right_{axis}min"), F.col(f"__region_{axis}min"), F.col(f"__region_{axis}max")
        inside &= (corner >= low) & ((corner < high) | (high == F.lit(float("inf"))))
    return pairs.join(F.broadcast(bounds), "left_pid").where(inside).select(*[F.col(f"`{c}`") for c in pairs.columns])  # a row for each region
