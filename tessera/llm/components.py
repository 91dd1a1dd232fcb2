"""Connected components of an edge table by large-star and small-star steps; edges never leave the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import Scratch


class UnionFind:
    """Roots are the smallest members."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True

    def edges(self) -> tuple[list, list]:
        """(member, root) of every member that isn't a root."""
        inner = [x for x in self.parent if self.find(x) != x]
        return inner, [self.find(x) for x in inner]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components, at most one for each node that a task meets. Columns a, b are longs or binaries."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = UnionFind()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sets.union(a, b)
        yield star_batch(sets, binary=kind == "binary")

    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def star_batch(sets: UnionFind, binary: bool) -> pa.RecordBatch:
    kind = pa.binary() if binary else pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x in sets.edges()], ["a", "b"])


def components(edges: DataFrame, s: Scratch) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by its smallest node."""
    now = s.table(contracted(edges).where("a <> b").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (state["n"], state["h"]) == seen or not state["n"]:
            break
        seen = (state["n"], state["h"])
        now = s.table(small_star(large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    inner = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return inner.union(least.select("a", F.col("least").alias("b"))).distinct()
