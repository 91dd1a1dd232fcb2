"""A join that comes to one number carries no columns that the number doesn't need."""

from pyspark.sql import functions as F

from tessera.plans.measures import measure
from tessera.sources.layers import parse_lines, stored


def test_measures_carry_no_other_columns(spark):
    lines = spark.range(50).select("id", F.format_string("POLYGON((%d 0,%d 0,%d 1,%d 1,%d 0))", "id", F.col("id") + 1, F.col("id") + 1, "id", "id").alias("value"))
    a, b = stored(parse_lines(lines)), stored(parse_lines(lines))
    found = measure(a, b, "intersects")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "left_xmin" not in plan and "left_id" not in plan
    assert found.first().asDict() == {"value": 50 + 2 * 49, "skipped": 0}
