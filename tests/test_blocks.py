"""Blocks don't try each pair of rows one by one."""

from pyspark.sql import functions as F

from tessera.operators import envelope_join as e
from tessera.operators.blocks import block_join


def test_blocks_look_up_envelopes_in_trees(spark):
    grid = "cast(id % 40 as double) as xmin, cast(id % 40 + 1 as double) as xmax, cast(id div 40 as double) as ymin, cast(id div 40 + 1 as double) as ymax"
    layer = spark.range(1600).selectExpr("id", grid.split(",")[0], *grid.split(",")[1:])
    a, b = e.plain_side(layer, "left_"), e.plain_side(layer, "right_")
    found = block_join(a, b, F.expr(e.MEET), band=300)
    assert found.columns == [*a.columns, *b.columns]
    assert sorted(map(tuple, found.select("left_id", "right_id").collect())) == sorted(map(tuple, a.join(b, F.expr(e.MEET)).select("left_id", "right_id").collect()))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
