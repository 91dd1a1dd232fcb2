"""The stages against brute force on a small corpus; skipped where the pipeline isn't."""

import random
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    item = make(40)
    rows, fate = [], {}

    def add(text, what):
        fate[len(rows)] = what
        rows.append((len(rows), text, "en", f"s{len(rows) % 3}", len(text)))

    for _ in range(300):
        add(make(60), "stays")
    for i in range(200):
        add(make(30) + " dreadful insult " + make(20), "toxic")
    for i in range(20):
        add(rows[i][1].replace(" ", " \n"), "exact")
    for i in range(20, 40):
        words = rows[i][1].split()
        words[30] = "changed"
        add(" ".join(words), "near")
    for i in range(10):
        add(make(20) + " " + item + " " + make(20), "leak")
    add("", "stays")
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(what == "toxic")) for i, what in fate.items() if i % 2 or what != "toxic"]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item), (1, make(30))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), fate


def test_stages(spark, folder):
    at, fate = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    gone = set()
    for (name, stage), what in zip(pipeline.STAGES, ["toxic", "exact", "near", "leak"]):
        out = stage(spark, docs, at)
        assert out.schema.names == docs.schema.names
        out.write.parquet(path := f"{at}/{name}")
        docs = spark.read.parquet(path)
        gone |= {i for i, w in fate.items() if w == what}
        assert sorted(r.doc_id for r in docs.collect()) == sorted(set(fate) - gone), name
    mixed = pipeline.STAGES[-1][1](spark, docs, at).collect()
    assert {r.doc_id for r in mixed} <= set(fate) - gone
    whole = pipeline.run(spark, at).collect()
    assert Counter((r.doc_id, r["copy"]) for r in whole) == Counter((r.doc_id, r["copy"]) for r in mixed)


def test_empty_tables(spark, folder, tmp_path):
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, at)
        docs.write.parquet(path := f"{tmp_path}/{name}")
        docs = spark.read.schema(docs.schema).parquet(path)
        assert docs.count() == 0


def test_nulls(spark, folder, tmp_path):
    at, _ = folder
    rows = [(None, None, None, None, None), (1, None, None, "s", None), (None, "some text here", None, None, 3), (1, None, None, "s", None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, at)
        docs.write.parquet(path := f"{tmp_path}/n-{name}")
        docs = spark.read.schema(docs.schema).parquet(path)


def test_leaks_go_by_row(spark, folder):
    at, _ = folder
    item = spark.read.parquet(f"{at}/benchmark.parquet").where("item_id = 0").first().text
    rows = [(None, item, "en", "s", 1), (None, "some text here", "en", "s", 2), (1, item, "en", "s", 3), (1, "some other text", "en", "s", 4)]
    left = pipeline.drop_leaks(spark, spark.createDataFrame(rows, SCHEMA), at)
    assert sorted(r.n_chars for r in left.collect()) == [2, 4]
