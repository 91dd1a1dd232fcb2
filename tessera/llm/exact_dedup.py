"""Exact dedup by content-defined chunk recipes.

A text, after replacing each run of ASCII white space by one space, is cut where a rolling
hash of its last 32 bytes meets a mask, so that equal passages give equal chunks wherever they
stand. A chunk is known by a 64-bit fingerprint; ``chunk_store`` brings the chunks of equal
fingerprint together once, compares their bytes, and reports fingerprints that stand for
more than one content, so that the identifiers used afterwards are verified. Documents are then
compared as ordered lists of identifiers: their texts don't move again.

Defined results: a null text is an empty text (an empty recipe). A null id is larger than
any id. Rows that repeat both id and text are told apart by a row tag, so exactly one row of a
group stays. Texts are read whole, however long. Empty tables give empty results. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.broadcasts import light
from tessera.llm.names import unused
from tessera.llm.words import mix
from tessera.scratch import Scratch

MIN_CHUNK, AVERAGE_BITS, MAX_CHUNK = 2048, 12, 65536
HOT_ROWS = 100_000
_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def normalised(text: str | None) -> bytes:
    """The text in UTF-8 with each run of ``[\\x20\\x09-\\x0D]`` as one space."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return (b" " if raw[:1].isspace() else b"") + b" ".join(words) + (b" " if raw[-1:].isspace() else b"")


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks; their concatenation is the data."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [data] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # h[i] is then the sum of gear[data[i - j]] << j for j under 32
        h[step:] += h[:-step] << np.uint32(step)
    cuts = np.flatnonzero((h >> np.uint32(32 - AVERAGE_BITS)) == 0) + 1
    out, at = [], 0
    for cut in [*cuts.tolist(), n]:
        while cut - at > MAX_CHUNK:
            out.append(data[at : at + MAX_CHUNK])
            at += MAX_CHUNK
        if cut - at >= MIN_CHUNK or cut == n and cut > at:
            out.append(data[at:cut])
            at = cut
    return out


def fingerprint(chunk: bytes, bits: int = 64) -> int:
    """A signed 64-bit fingerprint; ``bits`` under 64 makes collisions likely, for tests."""
    x = xxhash.xxh3_64_intdigest(chunk) & ((1 << bits) - 1)
    return x - (1 << 64) if x >= 1 << 63 else x


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, tag, text_sha256, recipe) of every row; a recipe is the list of its chunks' fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = TaskContext.get().partitionId() << 40
        for b in batches:
            sha, lists = [], []
            for text in b.column(1):
                data = normalised(text.as_py())
                sha.append(hashlib.sha256(data).hexdigest())
                lists.append([fingerprint(c, bits) for c in chunks(data)])
            tags = np.arange(tag, tag + b.num_rows)
            tag += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tags, pa.int64()), pa.array(sha, pa.string()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "tag", "text_sha256", "recipe"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, tag long, text_sha256 string, recipe array<long>")


def chunk_store(docs: DataFrame, text_col: str = "text", bits: int = 64) -> DataFrame:
    """(fingerprint, content), distinct. A task sends a content that it meets again only once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[bytes] = set()
            held = 0
            for text in b.column(0):
                fresh = set(chunks(normalised(text.as_py())))
                seen |= fresh
                held += sum(map(len, fresh))
                if held > 16 << 20:
                    yield _contents(seen, bits)
                    seen, held = set(), 0
            yield _contents(seen, bits)

    found = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "fingerprint long, content binary")
    return found.groupBy("fingerprint", "content").agg(F.count("*").alias("n_tasks")).drop("n_tasks")


def _contents(seen: set[bytes], bits: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([fingerprint(c, bits) for c in seen], pa.int64()), pa.array(list(seen), pa.binary())], ["fingerprint", "content"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, tag."""
    spark = docs.sparkSession
    with Scratch(spark) as s:
        store = chunk_store(docs, text_col, bits)
        shared = s.table(store.groupBy("fingerprint").agg(F.count("*").alias("contents")).where("contents > 1"))
        made = s.table(recipes(docs, id_col, text_col, bits), keep=True)
        doubtful = made.select("tag", F.explode("recipe").alias("fingerprint")).join(shared, "fingerprint", "left_semi").select("tag").distinct()
        if shared.isEmpty():
            listed = made.withColumn("told_apart", F.lit(""))
        else:  # a list holding an identifier of several contents counts only together with the text's digest
            doubtful = s.table(doubtful, keep=True).withColumn("hit", F.lit(True))
            listed = made.join(doubtful, "tag", "left").withColumn("told_apart", F.when(F.col("hit"), F.col("text_sha256")).otherwise("")).drop("hit")
        first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")
        groups = listed.groupBy("recipe", "told_apart").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
        several = s.table(groups.where("group_size > 1"), keep=True)
    # Groups are counted by partial sums. Verdicts of the hot ones, of which there are few, go to the rows; other groups have under ``hot_rows`` rows in a task.
    key = ["recipe", "told_apart"]
    hot = light(several.where(F.col("group_size") >= hot_rows))
    rest = listed.join(hot, key, "left_anti")
    salted = several.where(F.col("group_size") < hot_rows)
    found = listed.join(hot, key).select("doc_id", "first", "group_size", "text_sha256", "recipe", "tag")
    alone = rest.join(salted, key, "left").select("doc_id", F.coalesce("first", first).alias("first"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256", "recipe", "tag")
    return found.union(alone).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("tag") == F.col("first.tag")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"), "tag"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Verdicts are joined back by id and digest: the rows of which none stays, and those of which one of several does, are few; their keys are broadcast up to
    64 MB, measured first, and the texts stay where they are. Of rows that repeat id and text the one that stays is the first by a hash of its columns.
    """
    spark = docs.sparkSession
    id_, sha, nth = unused(docs.columns, "__id", "__sha", "__nth")
    spaced = F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    keyed = docs.withColumns({id_: F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("no id")), sha: F.sha2(spaced.cast("binary"), 256)})
    verdict = exact_dedup(docs, id_col, text_col).where("group_size > 1").groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("no id")).alias(id_), F.col("text_sha256").alias(sha))
    counted = Scratch(spark).table(verdict.agg(F.count("*").alias("rows"), F.count_if("kept").alias("stay")), keep=True)
    twice = light(counted.where("stay > 0 and rows > 1").select(id_, sha))
    once = keyed.join(light(counted.where("stay = 0 or rows > 1").select(id_, sha)), [id_, sha], "left_anti")
    order = F.row_number().over(Window.partitionBy(id_, sha).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    first = keyed.join(twice, [id_, sha], "left_semi").withColumn(nth, order).where(F.col(nth) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return once.select(*columns).union(first.select(*columns))
