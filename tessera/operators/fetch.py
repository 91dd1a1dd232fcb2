"""Heavy columns for pairs that were found on plain ones: late materialisation by row number.

A layer with binary, text or nested columns gets a number for each row, once, as it is written to the shared folder. Joins carry the number; for the pairs they find, ``fetched``
brings each side's heavy columns in, pair by pair, and ``runs`` does so for refinement: a run is a right row and some of its candidates, so that whatever is prepared for the right
geometry serves them all, and runs are cut by what they cost, not by how many pairs they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.scratch import Scratch

ROW = "__row"
LEFT_ROW, RIGHT_ROW = f"left_{ROW}", f"right_{ROW}"
_PLAIN = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)
RUNS_A_TASK = 8  # of the greatest cost; many small ones even out
RUN_COST = 1 << 20  # a run isn't cut below that, some milliseconds
RUN_PAIRS = 512
RUN_POINTS = 1 << 20  # of the left geometries, 16 bytes each


def is_plain(field: T.StructField) -> bool:
    return isinstance(field.dataType, _PLAIN)


def numbered(layer: DataFrame) -> DataFrame:
    """The layer with row numbers: as it is if it has them, else written to the shared folder and read again."""
    if ROW in layer.columns:
        return layer
    return Scratch(layer.sparkSession).table(layer.withColumn(ROW, F.monotonically_increasing_id()), keep=True)


def heavy(layer: DataFrame, prefix: str) -> DataFrame | None:
    """The layer's row numbers and heavy columns under a prefix, None without any."""
    names = [f.name for f in layer.schema if not is_plain(f)]
    if not names:
        return None
    return layer.selectExpr(f"{ROW} as {prefix}{ROW}", *[f"`{c}` as `{prefix}{c}`" for c in names])


def fetched(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs with both layers' heavy columns, each brought in by a join on row numbers."""
    for prefix, layer in (("left_", left), ("right_", right)):
        extra = heavy(layer, prefix)
        if extra is not None:
            pairs = pairs.join(extra, f"{prefix}{ROW}")
    return pairs


def cut(pairs: DataFrame, tasks: int) -> DataFrame:
    """The pairs, written, with ``__cost`` (points left times right, beside what any pair takes) and ``__cut``, which together with the right row names a run.

    A right row's candidates are one run, unless their cost is more than a share (of all cost, for ``tasks``), or there are too many pairs or left points
    to be held: these are dealt to as many runs as it takes by a hash of the left row.
    """
    s = Scratch(pairs.sparkSession)
    points = [f"cast(coalesce({p}points, 1) as double)" if f"{p}points" in pairs.columns else "1D" for p in ("left_", "right_")]
    seen = Observation()
    found = s.table(pairs.selectExpr("*", f"({points[0]} + 16) * ({points[1]} + 16) as __cost").observe(seen, F.sum("__cost").alias("total")), keep=True)
    total = seen.get["total"] or 1.0
    share = max(total / (tasks * RUNS_A_TASK), RUN_COST)
    lists = found.groupBy(RIGHT_ROW).agg(F.expr(f"greatest(sum(__cost) / {float(share)!r}D, count(*) / {RUN_PAIRS}D, sum({points[0]}) / {RUN_POINTS}D) as __runs"))
    long = lists.where("__runs > 1")  # few: each has a share of the cost or many pairs
    names = [f"`{c}`" for c in found.columns]
    return found.join(long, RIGHT_ROW, "left").selectExpr(*names, f"coalesce(pmod(xxhash64({LEFT_ROW}), cast(ceil(__runs) as long)), 0L) as __cut")


def runs(pairs: DataFrame, left: DataFrame, right: DataFrame, tasks: int | None = None) -> DataFrame:
    """Runs: the right row's columns and ``lefts``, an array of its candidates' columns, dealt to tasks by a hash of the run.

    A right geometry is sent once to each run, a left one once to each of its pairs. Runs have about a share of the cost at most, so that tasks come out about equal however
    large a single geometry or its list of candidates is.
    """
    spark = pairs.sparkSession
    tasks = tasks or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marked = cut(pairs, tasks).drop("__cost")
    theirs = [c for c in marked.columns if c.startswith("right_") and c != RIGHT_ROW]
    keys = [RIGHT_ROW, "__cut"]
    extra = heavy(left, "left_")
    full = marked if extra is None else marked.join(extra, LEFT_ROW)
    mine = [c for c in full.columns if c.startswith("left_")]
    grouped = full.repartition(tasks, *keys).groupBy(*keys).agg(*[F.expr(f"first(`{c}`) as `{c}`") for c in theirs], F.expr(f"collect_list(struct({', '.join(f'`{c}`' for c in mine)})) as lefts"))
    other = heavy(right, "right_")
    if other is None:
        return grouped.drop("__cut")
    wanted = marked.select(*keys).distinct().join(other, RIGHT_ROW).repartition(tasks, *keys)
    return grouped.join(wanted.hint("shuffle_merge"), keys).drop("__cut")


def each_pair(refined: DataFrame, result: str) -> DataFrame:
    """Runs with an array column ``result``, one entry for each of ``lefts``, as pairs with that entry."""
    others = [f"`{c}`" for c in refined.columns if c not in ("lefts", result)]
    pairs = refined.selectExpr(*others, f"explode(arrays_zip(lefts, {result})) as pair")
    return pairs.selectExpr("pair.lefts.*", *others, f"pair.{result} as {result}")
