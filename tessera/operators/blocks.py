"""A join of all rows with all rows in the blocks of a matrix, for layers whose envelopes nearly all overlap.

Each layer's rows are dealt to bands by a hash; a left row is sent to every block of its band's row of the matrix, a right row to every block of
its column. So a row is copied as often as the other layer has bands, each pair meets in exactly one block, and no task has more than a band of each layer.
Within a block the right band probes a packed tree of the left one, so pairs whose envelopes don't meet aren't tried one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.packed_tree import PackedTree

BAND = 20_000  # rows of a layer that a block is meant to hold


def matrix(n_left: int, n_right: int, band: int = BAND) -> tuple[int, int]:
    """Bands of the two layers, one at least."""
    return max(1, math.ceil(n_left / band)), max(1, math.ceil(n_right / band))


def block_join(a: DataFrame, b: DataFrame, meet: Column, band: int = BAND) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` whose envelopes meet and for which ``meet`` holds; each pair is found once."""
    rows, columns = matrix(a.count(), b.count(), band)
    left = _dealt(a, "left___row", "__band_a", rows, "__band_b", columns)
    right = _dealt(b, "right___row", "__band_b", columns, "__band_a", rows)
    both = left.withColumn("__left", F.lit(True)).unionByName(right.withColumn("__left", F.lit(False)), allowMissingColumns=True)
    names_a, names_b = a.columns, b.columns

    def boxes(side: pa.Table, prefix: str) -> np.ndarray:
        return np.column_stack([side.column(f"{prefix}{c}").to_numpy() for c in ("xmin", "ymin", "xmax", "ymax")])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for batch in batches:
            is_left = batch.column("__left")
            sides[0].append(batch.filter(is_left).select(names_a))
            sides[1].append(batch.filter(pc.invert(is_left)).select(names_b))
        mine, theirs = (pa.Table.from_batches(x).combine_chunks() for x in sides)
        if not mine.num_rows or not theirs.num_rows:
            return
        for i, j in PackedTree(boxes(mine, "left_")).probe(boxes(theirs, "right_")):
            for lo in range(0, len(i), 1 << 16):
                found = [*theirs.take(pa.array(i[lo : lo + (1 << 16)])).columns, *mine.take(pa.array(j[lo : lo + (1 << 16)])).columns]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in found], [*names_b, *names_a])

    schema = T.StructType([*b.schema.fields, *a.schema.fields])
    return both.groupBy("__band_a", "__band_b").applyInArrow(run, schema).where(meet).select(*[F.col(f"`{c}`") for c in (*names_a, *names_b)])


def _dealt(side: DataFrame, row: str, own: str, bands: int, other: str, copies: int) -> DataFrame:
    """Rows with their band, by row number or else by all that they hold, once for each band of the other layer."""
    names = f"`{row}`" if row in side.columns else ", ".join(f"`{c}`" for c in side.columns)
    return side.selectExpr("*", f"pmod(xxhash64({names}), {bands}L) as {own}", f"explode(sequence(0L, {copies - 1}L)) as {other}")
