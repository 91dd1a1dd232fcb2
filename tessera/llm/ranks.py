"""Places of rows in the order of their group, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.broadcasts import light
from tessera.scratch import Scratch


def ranked(table: DataFrame, group: str, order: list[str], s: Scratch, rank: str = "rank", total: str | None = None) -> DataFrame:
    """``table``, which is written and whose ``group`` has no nulls, with each row's place, from 0, among its group's rows in ``order``, and with the group's size.

    Rows are partitioned by ranges of group and order together, so a group of a third of all rows is cut in many; ``order`` should tell rows apart. The result reads a
    table that is kept, whose files hold rows in order.
    """
    columns = [F.col(f"`{c}`") for c in table.columns]
    ordered = table.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ordered = s.table(ordered.select(*columns, F.monotonically_increasing_id().alias("__at"), F.spark_partition_id().alias("__part")), keep=True)
    # a row for each partition and one more for each group, at most
    counts = ordered.groupBy(group, "__part").agg(F.min("__at").alias("__low"), F.count("*").alias("__n"))
    every = Window.partitionBy(group).orderBy("__part")
    before = F.sum("__n").over(every.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    size = F.sum("__n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    begins = s.table(counts.select(group, "__part", (before - F.col("__low")).alias("__shift"), size.alias("__total")), keep=True)
    out = ordered.join(light(begins), [group, "__part"])
    return out.select(*columns, (F.col("__at") + F.col("__shift")).alias(rank), *([F.col("__total").alias(total)] if total else []))
