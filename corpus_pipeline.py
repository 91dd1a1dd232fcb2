"""Cleans and mixes the corpus: toxic documents go, then exact copies, near copies and benchmark leaks; sources are mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
Documents that a stage has nothing against stay. Null ids and texts are documents as any: a null text counts as empty, and empty texts are copies of each other. Rows that repeat each count, one of
them stays. Texts are read whole, however long. An empty table gives an empty one. Further columns of ``documents`` are handed on, whatever their names, but for those named as mixing's own (``copy``,
``shuffle_key``), which it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, exact_dedup, mixing, ngram_join, toxicity
from tessera.scratch import Owner, Scratch
from tessera.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.keep_one(docs, size=5, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, mixing.temperature_weights(docs, alpha=0.5), seed=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: A trained model decides the first stage, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again, and deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Owner()
    for name, stage in STAGES[:-1]:
        with Owner() as inside:
            found = stage(spark, docs, sf_dir)
        with Owner() as handed_on:
            docs = Scratch(spark).table(found, keep=True)
        inside.close()
        before.close()
        before = handed_on
    return STAGES[-1][1](spark, docs, sf_dir)
