"""Candidate pairs of two layers: rows whose envelopes intersect, touching included.

Strategies find the same pairs:

``grid``         an equi-join on grid cells (``operators.grid``), which Spark shuffles, sorts and splits where cells are crowded. The few widest geometries, at most
                 ``BROAD``, are held against the whole other layer instead, so that they bring no level of wide cells about.
``tree``         a packed R-tree of the smaller layer's envelopes is broadcast and probed by the larger one, which isn't shuffled. Where
                 the smaller layer's envelopes measure more than ``TREE_BYTES``, the grid takes its place.
``partitioned``  the grid within equal ``pid``; keeps what replication doubles, unless it is told the regions that ``pid`` numbers (``operators.regions``).
``blocks``       a matrix of blocks, each pair of rows met in one of them (``operators.blocks``): for layers whose envelopes nearly all overlap.
``nested``       compares all pairs: for small layers and for tests.

Only row numbers, envelopes and other plain columns are joined. What is heavy (binary, text, nested columns) is fetched by row number for the pairs found: see ``operators.fetch``.
Rows without an envelope (null or NaN bounds, or a lower bound above the upper) are in no pair; unbounded envelopes are as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import grid
from tessera.operators.blocks import block_join
from tessera.operators.fetch import ROW, fetched, is_plain, numbered
from tessera.operators.packed_tree import PackedTree
from tessera.operators.regions import Regions, met_in_own

Strategy = Literal["grid", "tree", "partitioned", "blocks", "nested"]
ENVELOPE = ("xmin", "ymin", "xmax", "ymax")
TREE_BYTES = 64 << 20
KNOWN = " and ".join([*(f"{c} is not null and not isnan({c})" for c in ENVELOPE), "xmin <= xmax", "ymin <= ymax"])


def plain_side(layer: DataFrame, prefix: str) -> DataFrame:
    """The layer's plain columns under a prefix, rows without an envelope left out."""
    return layer.where(KNOWN).selectExpr(*[f"`{f.name}` as `{prefix}{f.name}`" for f in layer.schema if is_plain(f)])


MEET = "left_xmin <= right_xmax and right_xmin <= left_xmax and left_ymin <= right_ymax and right_ymin <= left_ymax"


def _grid_pairs(a: DataFrame, b: DataFrame, shape: grid.Shape | None, same_pid: bool) -> DataFrame:
    meet = f"{MEET} and left_pid = right_pid" if same_pid else MEET
    if shape is None:
        return a.join(b, F.lit(False))
    parts = []
    if shape.broad is not None:
        wide = {p: f"{grid.width(p)} >= double('{shape.broad!r}')" for p in ("left_", "right_")}
        parts = [F.broadcast(a.where(wide["left_"])).join(b, F.expr(meet)), a.where(f"not ({wide['left_']})").join(F.broadcast(b.where(wide["right_"])), F.expr(meet))]  # at most BROAD rows of plain columns
        a, b = a.where(f"not ({wide['left_']})"), b.where(f"not ({wide['right_']})")
    left, right = grid.listed(a, "left_", "left", shape), grid.listed(b, "right_", "right", shape)
    keys = ["__level", "__cx", "__cy"]
    if same_pid:
        left, right = left.withColumn("__pid", F.col("left_pid")), right.withColumn("__pid", F.col("right_pid"))
        keys = ["__pid", *keys]
    near = left.join(right, keys).where(MEET).where(grid.met_once(shape)).drop(*keys, "__left_level", "__right_level")
    for x in parts:
        near = near.unionByName(x)
    return near


def _measured(side: DataFrame) -> int:
    """Bytes of a side of plain columns, at most: no plain value takes more than 16."""
    return side.count() * 17 * len(side.columns)


def _tree_pairs(a: DataFrame, b: DataFrame) -> DataFrame | None:
    """Pairs by a tree of the smaller side; None where it measures too much."""
    size_a, size_b = _measured(a), _measured(b)
    small, large, flip = (a, b, False) if size_a <= size_b else (b, a, True)
    if min(size_a, size_b) > TREE_BYTES:
        return None
    names = {"left_": a.columns, "right_": b.columns}
    inner, outer = ("right_", "left_") if flip else ("left_", "right_")
    held = small.toArrow().combine_chunks()  # at most TREE_BYTES
    boxes = np.column_stack([held.column(f"{inner}{c}").to_numpy(zero_copy_only=False) for c in ENVELOPE]) if held.num_rows else np.zeros((0, 4))
    tree = PackedTree(boxes)
    shared = a.sparkSession.sparkContext.broadcast((tree, held))
    schema = T.StructType([*a.schema.fields, *b.schema.fields])
    wanted = [*names["left_"], *names["right_"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = shared.value
        for batch in batches:
            boxes = np.column_stack([batch.column(batch.schema.get_field_index(f"{outer}{c}")).to_numpy(zero_copy_only=False) for c in ENVELOPE])
            for mine, theirs in tree.probe(boxes):
                for lo in range(0, len(mine), 1 << 16):
                    own, other = batch.take(pa.array(mine[lo : lo + (1 << 16)])), held.take(pa.array(theirs[lo : lo + (1 << 16)]))
                    columns = {**dict(zip(batch.schema.names, own.columns, strict=True)), **{c: other.column(c).combine_chunks() for c in held.column_names}}
                    yield pa.RecordBatch.from_arrays([columns[c] for c in wanted], wanted)

    return large.mapInArrow(run, schema)


def candidate_pairs(left: DataFrame, right: DataFrame, strategy: Strategy = "grid", cell: float | None = None, regions: Regions | None = None, shape: grid.Shape | None = None) -> DataFrame:
    """Every pair of rows whose envelopes intersect, with both layers' plain columns, prefixed with ``left_`` and ``right_``.

    ``cell`` is the width of the grid's lowest cells and ``shape`` all of the grid; both are found from the layers if not given.
    """
    a, b = plain_side(left, "left_"), plain_side(right, "right_")
    if strategy == "nested":
        return a.join(b, F.expr(MEET))
    if strategy == "blocks":
        return block_join(a, b, F.expr(MEET))
    if strategy == "tree":
        found = _tree_pairs(a, b)
        if found is not None:
            return found
    if shape is None:
        bare = lambda side, p: side.selectExpr(*[f"{p}{c} as {c}" for c in ENVELOPE])
        shape = grid.find(bare(a, "left_"), bare(b, "right_"), cell)
    pairs = _grid_pairs(a, b, shape, strategy == "partitioned")
    return met_in_own(pairs, regions) if regions is not None and strategy == "partitioned" else pairs


def envelope_join(left: DataFrame, right: DataFrame, strategy: Strategy = "grid", cell: float | None = None, regions: Regions | None = None) -> DataFrame:
    """Candidate pairs with all columns of both layers. A layer with heavy columns that isn't numbered is written first, see ``fetch.numbered``."""
    left, right = (layer if all(map(is_plain, layer.schema)) else numbered(layer) for layer in (left, right))
    pairs = candidate_pairs(left, right, strategy, cell, regions)
    order = [f"{p}{c}" for p, layer in (("left_", left), ("right_", right)) for c in layer.columns if c != ROW]
    return fetched(pairs, left, right).select(*[F.col(f"`{c}`") for c in order])
