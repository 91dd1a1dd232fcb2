"""Layers of keys whose cubes don't fit a long, as larger tables have, against Python's integers; SQL overflows there."""

import pytest

from tessera import queries

KEYS = [0, 7, 891_000, 1_199_999, 2_000_000_000, -1_300_000]


def remainder(x, m):
    return abs(x) % m * (1 if x >= 0 else -1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("keys"))
    spark.createDataFrame([(k, 3) for k in KEYS], "p_partkey long, p_size int").write.parquet(f"{out}/part.parquet")
    spark.createDataFrame([(k, 3) for k in KEYS], "c_custkey long, c_nationkey int").write.parquet(f"{out}/customer.parquet")
    return out


def test_layers_of_large_keys(spark, folder):
    for table, sql, exact in (
        ("part", queries.LAYER_A, lambda k: (k, remainder(k * k * 31 + k * 17, 1009), remainder(k**3 * 13 + k * 5, 1013), 4, 4, remainder(k, 8))),
        ("customer", queries.LAYER_B, lambda k: (k, remainder(k * k * 43 + k * 19, 1009), remainder(k**3 * 7 + k * 23, 1013), 4, 4, remainder(k, 8))),
    ):
        assert sorted(map(tuple, queries._boxes(spark, folder, table, sql).collect())) == sorted(map(exact, KEYS))


@pytest.mark.parametrize("name", ["ingest_envelopes", "join_intersects_pairs"])
def test_queries_on_large_keys(spark, folder, name):
    found = queries.QUERIES[name](spark, folder).collect()
    if name == "ingest_envelopes":
        assert sorted(r.id for r in found) == sorted(KEYS)
    else:
        assert {r.left_id for r in found} <= set(KEYS)
