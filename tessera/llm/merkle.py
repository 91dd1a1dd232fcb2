"""A Merkle manifest of a dataset: a tree of hashes for each group of rows, one over the groups, and a proof for each row.

``H`` is the lowercase hexadecimal SHA-256 of its inputs, one after the other, digests as text. A leaf is H of a row's values, each ``-`` where
null, else its length in UTF-8 bytes, ``:`` and the value. Within a group, leaves stand in the order of their ids; of each level every ``fanout``
consecutive nodes make one of the next, the last run whatever is left of them, be it one, without padding, until a single one remains: the group's
subroot, which of a single leaf is the leaf. Subroots, in the order of their groups, null first, likewise give the root.

Leaves get their places by a range partitioning, so no group is brought together, and each contiguous run of leaves that a task reads is pushed on a
stack of peaks: a node that ends its run of ``fanout`` takes its siblings from the stack and their parent is pushed in their place, as digits carry. A run's siblings
that another task has are missing: the peaks on the stack then stay. A round goes up at most ``STRIDE`` levels, so that a task holds a block of so many leaves at a time; its peaks, some
thousandth of the nodes, are dealt by larger blocks and pushed on a stack in the next round, until each group has a single peak. The way from a node to the
peak above it is written with it, and a proof is the way of the leaf and of the peaks above it: a join for each round, of which the first is the only one with all rows.

Defined results: a null value is ``-``, also of ids and groups; null ids come first, rows of one id in the order of their leaves, and rows alike in all hashed columns
are interchangeable. Texts are hashed whole in the JVM and don't move. An empty table gives no rows. Columns that aren't named aren't hashed, whatever they are called.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.broadcasts import light
from tessera.llm.ranks import ranked
from tessera.scratch import Scratch

STRIDE = 1024


def leaf(values: Sequence[Column]) -> Column:
    """H of a row's values; binary values are hashed as hexadecimal text."""
    each = []
    for v in values:
        text = v.cast("string")
        each.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*each).cast("binary"), 256)


def join_hashes(digests: Sequence[bytes]) -> bytes:
    """H of digests, which are given and returned as 32 bytes."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


@functools.lru_cache(1024)
def levels(n: int, fanout: int) -> tuple[int, ...]:
    """How many nodes each level has, from the leaves to the one that remains."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return tuple(out)


def fold(digest: bytes, idx: int, n: int, fanout: int, path: Sequence[bytes], at: int = 0) -> tuple[bytes, int]:
    """The root above a leaf by its siblings from ``path[at]`` on, and up to where they have been read."""
    for count in levels(n, fanout)[:-1]:
        first = idx - idx % fanout
        others = min(fanout, count - first) - 1
        run = list(path[at : at + others])
        run.insert(idx - first, digest)
        digest, at, idx = join_hashes(run), at + others, idx // fanout
    return digest, at


class Mountains:
    """The stack of peaks over a contiguous run of nodes, with all nodes that it has made."""

    def __init__(self, n: int, fanout: int, top: int):
        self.counts, self.fanout, self.top = levels(n, fanout), fanout, top
        self.stack: list[tuple[int, int]] = []
        self.nodes: dict[tuple[int, int], bytes] = {}

    def siblings(self, level: int, idx: int) -> range:
        first = idx - idx % self.fanout
        return range(first, min(first + self.fanout, self.counts[level]))

    def push(self, level: int, idx: int, digest: bytes) -> None:
        while True:
            self.nodes[level, idx] = digest
            self.stack.append((level, idx))
            if level >= self.top or self.counts[level] == 1:
                return
            run = self.siblings(level, idx)
            if idx != run[-1] or len(self.stack) < len(run) or self.stack[-len(run)] != (level, run[0]):
                return
            del self.stack[-len(run) :]
            level, idx, digest = level + 1, idx // self.fanout, join_hashes([self.nodes[level, i] for i in run])

    def way(self, level: int, idx: int) -> tuple[list[bytes], int, int]:
        """Siblings from a node up to the peak above it, and that peak."""
        path: list[bytes] = []
        while (level + 1, idx // self.fanout) in self.nodes:
            path += [self.nodes[level, i] for i in self.siblings(level, idx) if i != idx]
            level, idx = level + 1, idx // self.fanout
        return path, level, idx


NODE = "key string, n long, level int, idx long, hash binary, item boolean, peak boolean, path array<binary>, top_level int, top_idx long"


def _stride(fanout: int) -> int:
    """Levels that a round goes up: as many as give at most STRIDE leaves to a node, one at least."""
    k = 1
    while fanout ** (k + 1) <= STRIDE:
        k += 1
    return k


def _round(nodes: DataFrame, fanout: int, top: int, carried: Sequence[str] = ()) -> DataFrame:
    """Nodes (key, n, level, idx, hash), in order within each task, with their ways to the peaks above them, and the nodes made of them, up to level ``top``."""
    kinds = nodes.select(*carried).schema
    schema = T.StructType(nodes.sparkSession.createDataFrame([], NODE).schema.fields + kinds.fields)
    arrow = to_arrow_schema(schema)
    block, nothing = fanout**top, dict.fromkeys(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held: Mountains | None = None
        given: dict[tuple[int, int], dict] = {}
        now: tuple = ()
        after = -1

        def flush() -> None:
            if held is None:
                return
            peaks = set(held.stack)
            for (level, idx), digest in held.nodes.items():
                own = given.get((level, idx))
                path, top_level, top_idx = held.way(level, idx) if own is not None else (None, None, None)
                out.append({"key": now[0], "n": now[1], "level": level, "idx": idx, "hash": digest, "item": own is not None, "peak": (level, idx) in peaks, "path": path, "top_level": top_level, "top_idx": top_idx, **(own or nothing)})

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(5 + len(carried))]
            for key, n, level, idx, digest, *others in zip(*columns, strict=True):
                start = idx * fanout**level
                here = (key, n, start // block)
                if here != now or start != after:
                    flush()
                    held, given, now = Mountains(n, fanout, top), {}, here
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out = []
                given[level, idx] = dict(zip(carried, others, strict=True))
                held.push(level, idx, digest)
                after = min(start + fanout**level, n)
        flush()
        yield pa.RecordBatch.from_pylist(out, arrow)

    return nodes.select("key", "n", "level", "idx", "hash", *carried).mapInArrow(run, schema)


@dataclass
class Forest:
    """``items``: key, n, idx, hash and path of each leaf, with what it carries; ``nodes``: every node by key, n, level and idx; ``roots``: key, n and hash."""

    items: DataFrame
    nodes: DataFrame
    roots: DataFrame


def forest(leaves: DataFrame, fanout: int, s: Scratch, carried: Sequence[str] = ()) -> Forest:
    """The trees of leaves (key, n, idx, hash) that are in order within each task."""
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 1
    stride = top = _stride(fanout)
    rounds = [s.table(_round(leaves.withColumn("level", F.lit(0)), fanout, top, carried), keep=True)]
    while len(rounds) == 1 or fanout**top < most:  # what the first round's tasks have cut is joined in the second
        top += stride
        start = F.expr(f"idx * cast(power({fanout}, level) as long)")
        dealt = rounds[-1].where("peak").withColumn("start", start).withColumn("block", F.expr(f"start div {fanout**top}L"))
        dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "start")
        rounds.append(s.table(_round(dealt, fanout, top), keep=True))
    own = ["key", "n", "level", "idx", "hash"]
    above = rounds[-1].where("item")
    for earlier in reversed(rounds[:-1]):
        known = s.table(above.select("key", F.col("level").alias("top_level"), F.col("idx").alias("top_idx"), F.col("path").alias("rest")), keep=True)
        others = [c for c in carried if c in earlier.columns]
        above = earlier.where("item").join(light(known), ["key", "top_level", "top_idx"]).select(*own, F.concat("path", "rest").alias("path"), *others)
    made = rounds[0].select(*own)
    for later in rounds[1:]:
        made = made.unionByName(later.where("not item").select(*own))
    return Forest(above.select("key", "n", "idx", "hash", "path", *carried), made, rounds[-1].where("peak").select("key", "n", "hash"))


@dataclass
class Manifest:
    """``proofs``: a row for each row of the dataset; ``nodes``: key, level, idx and hash of every node of the groups' trees; ``subroots``: group, n, hash; ``root``: of all, None of an empty table."""

    proofs: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: bytes | None


def manifest(docs: DataFrame, columns: Sequence[str], group: str = "lang", id_col: str = "doc_id", fanout: int = 2, found: Sequence[Column] | None = None) -> Manifest:
    """The trees of ``docs`` by ``columns``, and each row's proof.

    ``found`` are the values that a later check meets in place of those of ``columns``; the same unless given. ``proofs`` has the id as ``id``, ``key`` (of the group), ``idx`` and ``n`` (place in the group and
    its size), ``leaf``, ``found_leaf``, ``subroot``, ``root``, ``proof`` (siblings from the leaf to the root), ``proof_sha256`` (H of these),
    ``folded_root`` (what found_leaf and the siblings give) and ``verified`` (whether that is the root).
    """
    s = Scratch(docs.sparkSession)
    values = [F.col(f"`{c}`") for c in columns]
    named = F.col(f"`{group}`").cast("string")
    hashed = F.unhex(leaf(values))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), named), F.lit("")).alias("key"), F.col(f"`{id_col}`").alias("id"), hashed.alias("hash"),
        (hashed if found is None else F.unhex(leaf(found))).alias("found"), F.monotonically_increasing_id().alias("tag"),
    )
    indexed = ranked(s.table(rows, keep=True), "key", ["id", "hash", "tag"], s, "idx", "n")
    groups = forest(s.table(indexed.sortWithinPartitions("key", "idx"), keep=True), fanout, s, ["id", "found"])
    subroots = s.table(groups.roots.select(F.lit("").alias("all"), F.col("key").alias("of"), "hash", F.col("n").alias("rows")), keep=True)
    placed = ranked(subroots, "all", ["of"], s, "idx", "n").select(F.col("all").alias("key"), "n", "idx", "hash", "of")
    upper = forest(s.table(placed.sortWithinPartitions("key", "idx"), keep=True), fanout, s, ["of"])
    top = upper.roots.first()
    root = bytes(top["hash"]) if top else None
    return Manifest(_proofs(groups.items, upper.items, root, fanout, s), groups.nodes, subroots.select(F.expr("if(of = '', null, substr(of, 2))").alias("group"), F.col("rows").alias("n"), "hash"), root)


PROOF = "key string, idx long, n long, leaf string, found_leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean"


def _proofs(items: DataFrame, upper: DataFrame, root: bytes | None, fanout: int, s: Scratch) -> DataFrame:
    above = s.table(upper.select(F.col("of").alias("key"), F.col("hash").alias("subroot"), F.col("idx").alias("up_idx"), F.col("n").alias("up_n"), F.col("path").alias("up_path")), keep=True)
    joined = items.join(light(above), "key").select("id", "key", "idx", "n", "hash", "found", "path", "subroot", "up_idx", "up_n", "up_path")
    schema = T.StructType([T.StructField("id", items.schema["id"].dataType), *items.sparkSession.createDataFrame([], PROOF).schema.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for id_, key, idx, n, digest, found, path, subroot, up_idx, up_n, up_path in zip(*columns, strict=True):
                folded, _ = fold(found, idx, n, fanout, path)
                folded, _ = fold(folded, up_idx, up_n, fanout, up_path)
                proof = path + up_path
                out.append({"id": id_, "key": key, "idx": idx, "n": n, "leaf": digest.hex(), "found_leaf": found.hex(), "subroot": subroot.hex(), "root": root.hex(), "proof": [x.hex() for x in proof], "proof_sha256": join_hashes(proof).hex(), "folded_root": folded.hex(), "verified": folded == root})
            yield pa.RecordBatch.from_pylist(out, arrow)

    return joined.mapInArrow(run, schema)
