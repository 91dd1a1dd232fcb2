"""Runs of pairs of light rows, made within the grid's cells: nothing is written, sorted or shuffled for each pair.

To bring a geometry in by row number costs a shuffle of each pair, which for geometries of a few points is far more than the pair's own computation. So rows whose heavy columns take
at most ``LIGHT`` bytes go into the cells as they are. A cell's left rows are packed into lists: one for the cell, or, where it is crowded, one for each small place in it (and in very crowded
ones several, by a hash of the row). A right row reads the lists of its cells whose bounds it meets and keeps of each the left rows that it meets there: that is a run.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import grid
from tessera.operators.fetch import ROW, is_plain
from tessera.operators.regions import Regions

LIGHT = 1024  # bytes
LIST = 64  # left rows of a cell that are one list
PLACES = 4  # places of a crowded cell along each axis
MOST = 8192  # left rows of a list, about, if all are in one place: LIGHT times as many bytes
ENVELOPE = ("xmin", "ymin", "xmax", "ymax")


def light(layer: DataFrame) -> str:
    """Whether a row is light, in SQL."""
    heavy = [f for f in layer.schema if not is_plain(f)]
    sizes = [f"coalesce(octet_length({f'`{f.name}`' if isinstance(f.dataType, (T.StringType, T.BinaryType)) else f'cast(`{f.name}` as string)'}), 0)" for f in heavy]
    return f"{' + '.join(sizes or ['0'])} <= {LIGHT}"


def cell_runs(left: DataFrame, right: DataFrame, shape: grid.Shape | None, meet: str, same_pid: bool, regions: Regions | None, wanted: tuple[list[str], list[str]]) -> DataFrame:
    """Each right row with ``lefts``, some of the left rows whose envelopes it meets, as ``fetch.runs`` has them but with the ``wanted`` columns of each only. Each pair is in one run. The shape has no broad rows."""
    mine, theirs = ", ".join(f"l.`a_{c}` as `left_{c}`" for c in wanted[0]), [f"`b_{c}` as `right_{c}`" for c in wanted[1]]
    if shape is None:
        return right.where("false").select(*[F.col(f"`{c}`").alias(f"b_{c}") for c in right.columns]).selectExpr(*theirs, f"cast(null as array<struct<{', '.join(f'`left_{c}`: {left.schema[c].dataType.simpleString()}' for c in wanted[0])}>>) as lefts")
    keys = ["__level", "__cx", "__cy"]
    a, b = (layer.select(*[F.col(f"`{c}`").alias(f"{p}{c}") for c in layer.columns]) for layer, p in ((left, "a_"), (right, "b_")))
    a, b = grid.listed(a, "a_", "left", shape), grid.listed(b, "b_", "right", shape)
    tests = [meet, grid.met_once(shape)]
    if same_pid:
        a, b = a.withColumn("__pid", F.col("a_pid")), b.withColumn("__pid", F.col("b_pid"))
        keys = ["__pid", *keys]
    if same_pid and regions is not None:
        b = b.join(F.broadcast(regions.table(right.sparkSession, "__region_").withColumnRenamed("pid", "__pid")), "__pid")  # a row for each region
        for x in "xy":
            corner = f"greatest(left_{x}min, right_{x}min)"
            tests.append(f"{corner} >= __region_{x}min and ({corner} < __region_{x}max or __region_{x}max = double('infinity'))")
    packed = _lists(a, [f"a_{c}" for c in left.columns], shape, keys)
    inside = re.sub(r"\b(a_\w+|__a_level)\b", r"l.\1", _named(" and ".join(f"({t})" for t in tests)))
    # right rows stream, so that one comes with all lists of its cell
    near = b.join(packed, keys).where(_named(meet).replace("a_", "__all_"))
    # in a generator, which is no part of the join and is computed once
    met = near.selectExpr(*[f"`b_{c}`" for c in right.columns], f"explode(array(filter(__lefts, l -> {inside}))) as __met").where("size(__met) > 0")
    return met.selectExpr(*theirs, f"transform(__met, l -> struct({mine})) as lefts")


def _named(test: str) -> str:
    return test.replace("left_", "a_").replace("right_", "b_")


def _lists(left: DataFrame, names: list[str], shape: grid.Shape, keys: list[str]) -> DataFrame:
    """Lists of the cells' left rows, ``__lefts``, with the bounds of each, ``__all_...``."""
    crowded = left.groupBy(*keys).agg(F.count("*").alias("__n")).where(f"__n > {LIST}")
    row = f"`a_{ROW}`" if f"a_{ROW}" in names else ", ".join(f"`{c}`" for c in names)
    places = [f"if(__n is null, 0L, {grid.cell_of(f'{PLACES} * {grid.within(f"a_{x}min", x, shape)}', '__level', shape)}) as __p{x}" for x in "xy"]
    placed = left.join(crowded, keys, "left").selectExpr("*", *places, f"coalesce(pmod(xxhash64({row}), cast(ceil(__n / {MOST}D) as long)), 0L) as __part")
    each = [*keys, "__px", "__py", "__part"]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = ", ".join(f"`{c}`" for c in [*names, "__a_level"])
    bounds = [F.expr(f"{c[1:]}(a_{c}) as __all_{c}") for c in ENVELOPE]  # min or max, as the bound is
    # dealt by list, so that a crowded cell is many tasks' work here; in the join adaptive execution splits it
    return placed.repartition(tasks, *each).groupBy(*each).agg(F.expr(f"collect_list(struct({held})) as __lefts"), *bounds).drop("__px", "__py", "__part")
