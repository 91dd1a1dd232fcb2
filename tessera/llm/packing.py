"""Documents packed into sequences of a fixed number of tokens: large ones are matched, small ones best-fit the gaps.

A document is its token ids and an end mark. One longer than a sequence is cut into pieces of a sequence's length, the last may be shorter.
Of pieces longer than a third of a sequence at most two share one: the longest takes the longest partner that fits, and so on down.
Shorter pieces, from the longest down, go where the smallest gap is left that holds them, and into new sequences where none does.

Pieces of one length are alike, so the plan is made of how many there are of each: that histogram, of at most ``capacity`` rows, is all that
reaches the driver, and the plan is a list of runs (pieces of one length that go to consecutive sequences), whose number
depends on the capacity and not on the corpus. Each piece then finds its place by its rank among those of its length. Ranks come from a
range partitioning by length and row, which splits a length that a third of all pieces have, and from counts by partition.

Defined results: a null or empty text is its end mark alone, and is packed. Rows that repeat are packed each. A null id stays null. Texts are read whole, however
long; one without white space is encoded as one word. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.encoding import Encoder
from tessera.llm.ranks import ranked
from tessera.llm.words import frugal
from tessera.scratch import Scratch

CAPACITY = 4096
END = 1
RUN = ("length", "rank", "rows", "sequence", "each", "offset")


def plan(counts: Mapping[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs and the number of sequences, from the number of pieces of each length.

    A run's columns are ``RUN``: pieces of ``length`` ranked from ``rank`` on, ``rows`` of them, ``each`` to a sequence (the last may get fewer), one
    sequence after the other from ``sequence`` on, the first piece at ``offset`` there.
    """
    left = {n: c for n, c in counts.items() if c}
    ranks = dict.fromkeys(left, 0)
    runs: list[tuple[int, ...]] = []
    gaps: list[int] = []  # that some sequence has, ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # first sequence and how many, by gap
    opened = 0

    def put(length: int, rows: int, sequence: int, each: int, offset: int) -> None:
        runs.append((length, ranks[length], rows, sequence, each, offset))
        ranks[length] += rows
        left[length] -= rows

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in ranges:
                bisect.insort(gaps, gap)
                ranges[gap] = []
            ranges[gap].append((sequence, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1
        if i >= 0 and large[i] == a and left[a] == 1:
            i -= 1
        if i < 0:
            n = left[a]
            put(a, n, opened, 1, 0)
            leave(capacity - a, opened, n)
        elif (b := large[i]) == a:
            n = left[a] // 2
            put(a, 2 * n, opened, 2, 0)
            leave(capacity - 2 * a, opened, n)
        else:
            n = min(left[a], left[b])
            put(a, n, opened, 1, 0)
            put(b, n, opened, 1, a)
            leave(capacity - a - b, opened, n)
            if not left[b]:
                del large[i]
        opened += n
        if not left[a]:
            large.pop()
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            i = bisect.bisect_left(gaps, length)
            if i == len(gaps):
                n = -(-left[length] // (capacity // length))
                leave(capacity, opened, n)
                opened += n
                continue
            gap = gaps[i]
            sequence, n = ranges[gap].pop()
            if not ranges[gap]:
                del ranges[gap], gaps[i]
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                put(length, full * each, sequence, each, capacity - gap)
                leave(gap - each * length, sequence, full)
            rest = left[length]
            if full < n and rest:  # fewer than ``each``
                put(length, rest, sequence + full, rest, capacity - gap)
                leave(gap - rest * length, sequence + full, 1)
                full += 1
            leave(gap, sequence + full, n - full)
    return np.array(sorted(runs), np.int64).reshape(-1, len(RUN)), opened


def pieces(docs: DataFrame, model_file: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, tag[, ids]): every document's pieces; ``tag`` numbers rows of this table's making."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Path(model_file).read_text(encoding="utf-8"))  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(shared.value)
        tag = TaskContext.get().partitionId() << 40
        last = np.array([end], "<u4")
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, found in enumerate(encoder.documents(part.column(1))):
                    ids = np.concatenate([found.astype("<u4", copy=False), last])
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at : at + capacity]
                        row.append(i), piece.append(k), start.append(at), length.append(len(own)), crc.append(zlib.crc32(own.data))
                        if keep_ids:
                            kept.append(own.astype(np.int32))
                n = len(row)
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.arange(tag, tag + n))]
                tag += n
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "tag", *(["ids"] if keep_ids else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, tag long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(frugal(run), schema)


def pack(docs: DataFrame, model_file: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, tag, and with ``keep_ids`` its ids.

    ``tag`` tells rows apart that repeat an id; sequences are numbered from 0.
    """
    spark, s = docs.sparkSession, Scratch(docs.sparkSession)
    made = s.table(pieces(docs, model_file, capacity, end, id_col, text_col, keep_ids), keep=True)
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = plan(counts, capacity)
    shared = spark.sparkContext.broadcast(runs)
    names = [c for c in made.columns if c != "tag"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, sequence, each, offset = shared.value.T
        wide = np.int64(1 << 50)
        key = length * wide + rank  # ascending
        for b in batches:
            own, at = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            run = np.searchsorted(key, own * wide + at, side="right") - 1
            nth = at - rank[run]
            found = [pa.array(sequence[run] + nth // each[run]), pa.array(offset[run] + nth % each[run] * own)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in names], *found, b.column(b.schema.get_field_index("tag"))], [*names, "sequence_id", "offset", "tag"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema if f.name != "tag")
    return ranked(made, "length", ["tag"], s).mapInArrow(place, f"{fields}, sequence_id long, offset long, tag long")


def sequences(packed: DataFrame) -> DataFrame:
    """Training sequences of what ``pack`` gives with ``keep_ids``: sequence_id, ids, and the lengths and documents of its pieces in order.

    A sequence's pieces have at most ``capacity`` tokens between them, so no group grows with the corpus.
    """
    inside = F.sort_array(F.collect_list(F.struct("offset", "tag", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("inside")).select("sequence_id", F.flatten("inside.ids").alias("ids"), F.col("inside.length").alias("lengths"), F.col("inside.doc_id").alias("doc_ids"))
