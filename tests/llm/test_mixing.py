import math

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as x

SCHEMA = "doc_id long, text string, source string"
ROWS = [(i, f"text {i}", f"s{i % 3 if i % 2 else 0}") for i in range(3000)] + [(None, None, None), (7, "text 7", "s1"), (5000, "", None)]


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_copies(frame, spark):
    df = frame(ROWS, SCHEMA)
    weights = spark.createDataFrame([("s0", 0.2), ("s1", 0.5), (None, 0.3), ("absent", 1.0), ("s2", 0.0)], "source string, weight double")
    got = x.mix_sources(df, weights, target_rows=4000, seed=3)
    assert got.columns == [*df.columns, "copy", "shuffle_key"]
    rows = got.collect()
    u = {r.doc_id: r.u for r in df.select("doc_id", x.uniform(F.lit("3"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("u")).collect()}
    size = {s: sum(r[2] == s for r in ROWS) for s in ("s0", "s1", "s2", None)}
    rate = {"s0": 0.2 * 4000 / size["s0"], "s1": 0.5 * 4000 / size["s1"], None: 0.3 * 4000 / size[None]}
    want = sorted(repr((i, k)) for i, _, s in ROWS if s in rate for k in range(1, poisson(rate[s], u[i]) + 1))
    assert sorted(repr((r.doc_id, r["copy"])) for r in rows) == want
    assert rate[None] > 500  # two rows, many copies each
    keys = [r.shuffle_key for r in rows]
    assert keys == sorted(keys)
    share = sum(r.source == "s1" for r in rows) / 4000
    assert abs(share - 0.5) < 0.05


def test_join_beyond_the_broadcast_bound(frame, spark, monkeypatch):
    df = frame(ROWS, SCHEMA)
    first = x.mix_sources(df, x.temperature_weights(df)).select("doc_id", "copy").collect()
    monkeypatch.setattr(x, "MAX_BYTES", 1)
    again = x.mix_sources(df.repartition(7), x.temperature_weights(df)).select("doc_id", "copy").collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))


def test_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "s", 9)], "doc_id long, text string, source string, copy int")
    assert x.mix_sources(df, x.temperature_weights(df)).columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    assert x.mix_sources(df.limit(0), x.temperature_weights(df)).count() == 0
    assert x.mix_sources(df, x.temperature_weights(df.limit(0))).count() == 0


@pytest.mark.parametrize("rate", [0.01, 1.0, 30.0, 900.0])
def test_distribution_function(spark, rate):
    cdf = spark.range(1).select(x.poisson_cdf(F.lit(rate))).first()[0]
    assert cdf == sorted(cdf) and abs(cdf[-1] - 1) < 1e-9
    mean = sum(1 - c for c in cdf)
    assert abs(mean - rate) < 1e-6 * max(1, rate)


def test_no_python_in_the_plan(frame, capsys):
    df = frame(ROWS, SCHEMA)
    x.mix_sources(df, x.temperature_weights(df)).explain("formatted")
    plan = capsys.readouterr().out
    assert not [x for x in ("EvalPython", "InPandas", "InArrow", "PythonUDF") if x in plan]
