"""N-gram Jaccard self-join by T-occurrence search.

Two documents link when their sets of word n-grams have ``den * shared >= num * union``. Documents of equal sets are
one node. The search is exact:

1. Two sets that link differ in at most D n-grams, a number that their size gives. The n-grams are dealt by their hash to a quarter more parts, or half as many again, so at least as many parts
   as there are, less D, hold the same of both: by any order of parts, the first D + 1 of each set have one in common. Parts are named by what they hold, and that order is by how many sets have
   the part, counted exactly. A part that no other set has joins nothing, so a set with more than D of these is in no link, however many documents there are, and others need only
   the rarest of their shared parts. Sets of less than twice a size are dealt alike, and a set that may link with larger ones, of the next such
   range, is dealt their way too. Nodes of a part are chained, not paired. Components of what is chained are clusters outside of which there is no link.
2. A cluster is dealt into blocks of about ``BLOCK_NODES`` nodes or ``BLOCK_BYTES`` of n-grams at most. Within a block every node is searched by
   T-occurrence: the shortest inverted lists are merged by a heap, the T - 1 longest are probed by binary search (DivideSkip), or, where many
   candidates are left, by position in those lists' bit rows; nodes
   that reach the overlap needed are links; of the links found a task sends those that join two parts. A cluster of one block is then
   done. Others are dealt and searched once more, anew, after which most of a group of near copies is one part; what
   isn't in a cluster's largest part is searched against all its blocks, so no pair of different parts is left out.

So a group of near copies is searched in bounded blocks, its links are never listed pair by pair, and its whole is never in one task.

Up to the clusters a node goes by 8 bytes of its name: nodes taken for one there only share a cluster, which adds comparisons.

Defined results: words are split at ASCII white space and only A-Z are lower-cased; a document with fewer than ``size`` words has its whole
sequence as its one n-gram; a null or empty text, or one without words, has an empty set and links with nothing. Ids of null are larger than
any; a component of such rows only has a null name. Rows that repeat are each reported. Texts are read whole, however long; an
empty table gives none. Other columns aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessera.llm.broadcasts import light
from tessera.llm.components import UnionFind, components, star_batch
from tessera.llm.names import unused
from tessera.llm.sketch import bloom, may_hold
from tessera.llm.words import Slice, distinct_shingles, frugal, mix, slices
from tessera.scratch import Scratch, shuffles_dropped

MOST_COUNTED = 1 << 16  # sets of a part; more count as so many
BLOCK_NODES, BLOCK_BYTES = 2048, 48 << 20
PROBED_AT_ONCE = 64
MAX_BROADCAST = 500_000


def node_keys(s: Slice, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """16 bytes naming each document's set: two sums of mixed hashes."""
    out = np.zeros((s.n_docs, 2), np.uint64)
    starts = np.searchsorted(doc, np.arange(s.n_docs + 1))
    for i, salt in enumerate((0x51ED270B27D4EB4F, 0x2545F4914F6CDD1D)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        out[:, i] = mix(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(np.uint64))
    return out


def fresh(keys: np.ndarray, n: np.ndarray, seen: set[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Which documents of the slice bring a non-empty set that this task hasn't met; all keys as bytes."""
    names = [k.tobytes() for k in keys]
    new = np.zeros(len(names), bool)
    for i, k in enumerate(names):
        if n[i] and k not in seen:
            seen.add(k)
            new[i] = True
    return new, names


def binaries(keys: list[bytes]) -> pa.Array:
    return pa.array(keys, pa.binary())


def profile(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, node, short) of every row, ``short`` being 8 bytes of node."""
    kind = docs.schema["id"].dataType.simpleString()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                doc, h = distinct_shingles(s, size)
                keys = node_keys(s, doc, h)
                ids = batch.column(0).slice(s.first, s.n_docs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.bincount(doc, minlength=s.n_docs)), binaries([k.tobytes() for k in keys]), pa.array(keys[:, 0].view(np.int64))], ["id", "n", "node", "short"])

    return docs.mapInArrow(run, f"id {kind}, n long, node binary, short long")


def most_apart(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """In how many n-grams a set of n and one that links with it, of as many or more or fewer, differ at most."""
    return (den - num) * (n + n * den // num) // (den + num)


def parts_of(k: int, num: int, den: int) -> int:
    """Parts that the n-grams are dealt to by their hash, for sets of 2 ** k to 2 ** (k + 1) - 1 of them: a quarter more than may differ, of small sets half as many again."""
    return int((1.5 if k < 8 else 1.25) * most_apart(np.array([(2 << k) - 1]), num, den)[0]) + 1


def parts(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(part, node, tag), nodes by 8 bytes: names of the parts of each node's set. A task sends a set once.

    ``tag`` has the range of sizes that the set is held against, and in its lower 32 bits how many of the parts needn't be shared: all but D + 1.
    """

    def of_space(k: np.ndarray, doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, name, tag) of the parts of documents that are held against sets of 2 ** k n-grams or more; k is -1 where there is none."""
        keep = k[doc] >= 0
        doc, h = doc[keep], h[keep]
        if not len(doc):
            return doc, h, doc
        n_parts = np.zeros(len(k), np.uint64)
        for x in np.unique(k[k >= 0]).tolist():
            n_parts[k == x] = parts_of(x, num, den)
        part = ((h >> np.uint64(32)) * n_parts[doc]) >> np.uint64(32)  # ascends with the hash
        starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])]))
        owner = doc[starts]
        name = mix(np.add.reduceat(mix(h), starts) + (k[owner].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        wanted = most_apart(n, num, den) + 1
        filled = np.bincount(owner, minlength=len(k))
        owners, names = [owner], [name]
        for i in np.flatnonzero((k >= 0) & (filled < wanted)).tolist():  # small sets: parts without n-grams come last
            none = np.setdiff1d(np.arange(int(n_parts[i])), part[starts][owner == i].astype(np.int64))[: int(wanted[i] - filled[i])]
            owners.append(np.full(len(none), i))
            names.append(mix(none.astype(np.uint64) + np.uint64((int(k[i]) + 1) << 40)))
        owner, name = np.concatenate(owners), np.concatenate(names)
        return owner, name, ((k.astype(np.int64) << 32) + np.maximum(filled - wanted, 0))[owner]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for s in slices(batch.column(1)):
                doc, h = distinct_shingles(s, size)
                n = np.bincount(doc, minlength=s.n_docs)
                keys = node_keys(s, doc, h)
                new, _ = fresh(keys, n, seen)
                own = np.where(new, np.frexp(n.astype(np.float64))[1] - 1, -1)
                largest = np.where(new, np.frexp((n * den // num).astype(np.float64))[1] - 1, -1)
                k = own
                while (k >= 0).any():
                    owner, name, tag = of_space(k, doc, h, n)
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(keys[owner, 0].view(np.int64)), pa.array(tag)], ["part", "node", "tag"])
                    k = np.where((k >= 0) & (k < largest), k + 1, -1)

    return docs.mapInArrow(run, "part long, node long, tag long")


def shared(named: DataFrame) -> DataFrame:
    """(part, node, tag, n) of the parts that several nodes have, each row once; n is by how many, at most ``MOST_COUNTED``."""

    def told(x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        several = n > 1
        return pa.RecordBatch.from_arrays([*(pa.array(c[several]) for c in x), pa.array(n[several].astype(np.int32))], ["part", "node", "tag", "n"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # rows of the part that may go on
        many: int | None = None  # the part, if some of its rows have been sent
        for batch in batches:
            x = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            if not x.shape[1]:
                continue
            x = x[:, np.concatenate([[True], (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])])]  # else the same set from another task
            starts = np.flatnonzero(np.concatenate([[True], x[0, 1:] != x[0, :-1]]))
            sizes = np.diff(np.append(starts, x.shape[1]))
            n = np.minimum(sizes, MOST_COUNTED)
            if x[0, 0] == many:
                n[0] = MOST_COUNTED
            end = int(starts[-1])
            many = int(x[0, -1]) if sizes[-1] > MOST_COUNTED or (len(starts) == 1 and x[0, 0] == many) else None
            if many is not None:
                n[-1] = MOST_COUNTED
                end = x.shape[1] - 1
            yield told(x[:, :end], np.repeat(n, sizes)[:end])
            held = x[:, end:]
        if held.shape[1]:
            yield told(held, np.full(held.shape[1], held.shape[1] if many is None else MOST_COUNTED))

    return named.repartition("part").sortWithinPartitions("part", "node").mapInArrow(run, "part long, node long, tag long, n int")


def rarest(found: DataFrame) -> DataFrame:
    """(part, node): of each node's shared parts as many of the rarest as, with those that it shares with none, make the first D + 1."""
    own = Window.partitionBy("node", "tag")
    spare = F.col("tag").bitwiseAND(F.lit((1 << 32) - 1))
    placed = found.withColumn("place", F.row_number().over(own.orderBy("n", "part"))).withColumn("of", F.count("*").over(own))
    return placed.where(F.col("place") <= F.col("of") - spare).select("part", "node")


def joined(named: DataFrame) -> DataFrame:
    """Edges (a, b) that chain the nodes of each part; a task sends at most one for each node."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = UnionFind()
        last = np.zeros((2, 0), np.int64)
        for batch in batches:
            part, node = np.concatenate([last, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])], axis=1)
            at = np.flatnonzero((part[1:] == part[:-1]) & (node[1:] != node[:-1]))
            for a, b in set(zip(node[at].tolist(), node[at + 1].tolist())):
                sets.union(a, b)
            last = np.stack([part[-1:], node[-1:]])
        yield star_batch(sets, binary=False)

    return named.repartition("part").sortWithinPartitions("part", "node").mapInArrow(run, "a long, b long")


def members(docs: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """(short, node, grams) of the nodes, ``short`` being the 8 bytes, that a Bloom filter lets pass: sorted 64-bit hashes. Tasks that meet a set each send it."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # BLOOM_BYTES

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for s in slices(batch.column(1)):
                doc, h = distinct_shingles(s, size)
                starts = np.searchsorted(doc, np.arange(s.n_docs + 1))
                keys = node_keys(s, doc, h)
                new, names = fresh(keys, np.diff(starts), seen)
                at = np.flatnonzero(new & may_hold(shared.value, keys[:, 0]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at, 0].view(np.int64)), binaries([names[i] for i in at]), pa.array([h[starts[i] : starts[i + 1]].tobytes() for i in at], pa.binary())], ["short", "node", "grams"])

    return docs.mapInArrow(run, "short long, node binary, grams binary")


class InvertedIndex:
    """Lists of the hosts, by number, that hold each n-gram."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        del order, owner
        self.starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.tokens = tokens[self.starts]
        self.ends = np.append(self.starts[1:], len(tokens))
        self.rows: np.ndarray | None = None  # bit rows of lists that hold many hosts, made when first needed
        self.places = np.repeat(np.arange(len(self.starts)), self.ends - self.starts) * len(sets) + self.owner  # ascending

    def search(self, query: np.ndarray, num: int, den: int, below: int | None = None) -> np.ndarray:
        """Hosts, of the first ``below`` ones, that link with the query."""
        n = len(query)
        at = np.searchsorted(self.tokens, query)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == query]
        threshold = -(-num * n // den)  # at the least: a host that links has num / den of the query's size, and shares that
        if len(at) < threshold or not len(at):
            return np.zeros(0, np.int64)
        lengths = self.ends[at] - self.starts[at]
        at = at[np.argsort(lengths, kind="stable")]
        short = len(at) - (threshold - 1)
        candidates, counts = self._merge([self.owner[self.starts[i] : self.ends[i]].tolist() for i in at[:short]])
        sizes = self.sizes[candidates]
        fits = (den * sizes >= num * n) & (den * n >= num * sizes)
        if below is not None:
            fits &= candidates < below
        candidates, counts = candidates[fits], counts[fits]
        needed = -(-num * (n + self.sizes[candidates]) // (num + den))
        long = at[short:]
        lo = 0
        while lo < len(long):
            able = counts + len(long) - lo >= needed
            if not able.all():
                candidates, counts, needed = candidates[able], counts[able], needed[able]
            if not len(candidates):
                break
            if len(candidates) > PROBED_AT_ONCE and (many := self._row_of()[long[lo:]]).max() >= 0:
                counts += self.rows[many[many >= 0]].sum(axis=0, dtype=np.int32)[candidates]
                long, lo = long[lo:][many < 0], 0
            else:
                wanted = long[lo : lo + 256, None] * len(self.sizes) + candidates
                place = np.searchsorted(self.places, wanted)
                place[place == len(self.places)] = 0
                counts += (self.places[place] == wanted).sum(axis=0)
                lo += 256
        return candidates[counts >= needed]

    def _row_of(self) -> np.ndarray:
        """Each list's bit row, -1 where it has none; lists of at least an eighth of the hosts have one."""
        if self.rows is None:
            lengths = self.ends - self.starts
            many = np.flatnonzero(lengths * 8 >= len(self.sizes))
            self.row_of = np.full(len(lengths), -1)
            self.row_of[many] = np.arange(len(many))
            self.rows = np.zeros((len(many), len(self.sizes)), np.uint8)
            row = np.repeat(self.row_of, lengths)
            self.rows[row[row >= 0], self.owner[row >= 0]] = 1
        return self.row_of

    @staticmethod
    def _merge(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Hosts on the lists and on how many of them, by a heap of the lists' next hosts."""
        heap = [(x[0], i, 0) for i, x in enumerate(lists)]
        heapq.heapify(heap)
        hosts: list[int] = []
        counts: list[int] = []
        while heap:
            host, i, place = heap[0]
            if hosts and hosts[-1] == host:
                counts[-1] += 1
            else:
                hosts.append(host)
                counts.append(1)
            if place + 1 < len(lists[i]):
                heapq.heapreplace(heap, (lists[i][place + 1], i, place + 1))
            else:
                heapq.heappop(heap)
        return np.array(hosts, np.int64), np.array(counts, np.int64)


def searched(dealt: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """Edges (a, b) from parts to the smallest part that links within a group of rows (keys, host, query, part, node, grams) join them with.

    Rows with ``host`` are indexed and those with ``query`` searched; a group is held in one task at a time.
    """

    def links(group: list[tuple[bool, bool, bytes, bytes, np.ndarray]]) -> tuple[list[bytes], list[bytes]]:
        parts = UnionFind()
        hosts = [x for x in group if x[0]]
        if hosts and len(group) > 1:
            index = InvertedIndex([x[4] for x in hosts])
            own = 0
            for host, query, part, _, grams in group:
                if query:
                    for i in index.search(grams, num, den, own if host else None).tolist():
                        parts.union(part, hosts[i][2])
                own += host
        return parts.edges()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = []
        now = None
        for batch in batches:
            a: list[bytes] = []
            b: list[bytes] = []
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            host, query, part, node = (batch.column(len(keys) + i).to_pylist() for i in range(4))
            grams = batch.column(len(keys) + 4)
            for i, key in enumerate(zip(*columns)):
                if key != now:
                    for out, x in zip((a, b), links(group)):
                        out += x
                    now, group = key, []
                if group and group[-1][0] == host[i] and group[-1][3] == node[i]:
                    continue  # the same set from another task
                group.append((host[i], query[i], part[i], node[i], np.frombuffer(grams[i].as_py(), np.uint64)))
            yield edge_batch(a, b)
        yield edge_batch(*links(group))

    return dealt.select(*keys, "host", "query", "part", "node", "grams").repartition(*keys).sortWithinPartitions(*keys, "host", "node").mapInArrow(run, "a binary, b binary")


def edge_batch(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([binaries(a), binaries(b)], ["a", "b"])


def ngram_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) of every row: component_id is the smallest id that links reach."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    with Scratch(spark) as s, shuffles_dropped(spark):
        made = s.table(profile(texts, size))
        rows = made.select("id", "n", "node")
        clusters = s.table(components(joined(rarest(s.table(shared(parts(texts, size, num, den))))), s))
        few = clusters.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
        belongs = clusters.select(F.col("node").alias("short"), F.col("component").alias("cluster"))
        blocks_of = F.greatest(F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
        sized = made.where("n > 0").select("short", "node", "n").distinct().join(belongs, "short").groupBy("cluster").agg(blocks_of.alias("n_blocks"))
        dealing = s.table(belongs.join(sized, "cluster"))

        def sets_of(which: DataFrame) -> DataFrame:
            return members(texts, size, bloom(which, "short")).join(F.broadcast(which) if few else which, "short").drop("short")

        def dealt(sets: DataFrame, salt: int) -> DataFrame:
            block = F.pmod(F.xxhash64(F.col("node"), F.lit(salt)), F.col("n_blocks")).cast("int")
            return sets.select("cluster", "n_blocks", block.alias("block"), "node", "grams")

        both = {"host": F.lit(True), "query": F.lit(True), "part": F.col("node")}
        of_one_block = s.table(searched(dealt(sets_of(dealing.where("n_blocks = 1")), 1).withColumns(both), ["cluster", "block"], num, den))
        linked = of_one_block.select(F.col("a").alias("node"), F.col("b").alias("component"))
        in_blocks = dealing.where("n_blocks > 1")
        if not in_blocks.isEmpty():
            sets = s.table(sets_of(in_blocks))
            large = dealt(sets, 1)
            twice = [s.table(searched(dealt(sets, salt).withColumns(both), ["cluster", "block"], num, den)) for salt in (1, 2)]
            found = s.table(components(twice[0].union(twice[1]), s))
            found = s.table(found.withColumnRenamed("component", "part"))
            little = lambda df: F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df
            placed = large.join(little(found), "node", "left").withColumn("part", F.coalesce("part", "node"))
            counted = placed.select("cluster", "part", "node").distinct().groupBy("cluster", "part").agg(F.count("*").alias("in_part"))
            largest = counted.groupBy("cluster").agg(F.max(F.struct("in_part", "part")).alias("top"), F.sum("in_part").alias("all")).select("cluster", F.col("top.part").alias("largest"), F.ceil((F.col("all") - F.col("top.in_part")) / block_nodes).cast("int").alias("n_queries"))
            placed = placed.join(little(s.table(largest)), "cluster").where("n_queries > 0")
            hosts = placed.withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("n_queries") - 1))).select("cluster", "block", "batch", F.lit(True).alias("host"), F.lit(False).alias("query"), "part", "node", "grams")
            asked = placed.where("part <> largest").withColumn("batch", F.pmod(F.xxhash64(F.col("node"), F.lit(3)), F.col("n_queries")).cast("int"))
            asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("cluster", "block", "batch", F.lit(False).alias("host"), F.lit(True).alias("query"), "part", "node", "grams")
            rest = s.table(searched(hosts.unionByName(asked), ["cluster", "block", "batch"], num, den))
            linked = linked.union(s.table(components(found.select(F.col("node").alias("a"), F.col("part").alias("b")).where("a <> b").union(rest), s)))
        named = rows.where("n > 0").join(linked, "node", "left").withColumn("part", F.coalesce("component", "node"))
        names = named.groupBy("part").agg(F.min("id").alias("component_id"))
        whole = named.join(names, "part").select("id", "n", "component_id", "node").unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "node"))
        out = s.table(whole, keep=True)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "node")


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but those whose component has a smaller id.

    Verdicts go by id and set, so rows of one id, or without any, are told apart; a component without any id stays. They are brought back by id and a hash of the text, which are
    broadcast up to 64 MB, measured first: the rows themselves don't pass through Python, and stay where they are.
    """
    gone_id, gone_text, own_text = unused(docs.columns, "__gone", "__hash", "__own")
    hashed = F.xxhash64(F.col(f"`{text_col}`"))
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), hashed.alias("hash"))
    found = ngram_components(narrow, size, num, den, "id", "text")
    gone = found.where("component_id is not null and not (doc_id <=> component_id)").select("doc_id", "node").distinct()
    mine = with_sets(narrow, size, "text", "own").select("id", "hash", "own")
    leave = mine.join(gone, (mine["own"] == gone["node"]) & mine["id"].eqNullSafe(gone["doc_id"]), "left_semi").select(F.col("id").alias(gone_id), F.col("hash").alias(gone_text)).distinct()
    leave = light(Scratch(docs.sparkSession).table(leave, keep=True))
    rows = docs.withColumn(own_text, hashed)
    same = (rows[own_text] == leave[gone_text]) & rows[f"`{id_col}`"].eqNullSafe(leave[gone_id])
    return rows.join(leave, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def with_sets(docs: DataFrame, size: int, text_col: str, name: str = "__set") -> DataFrame:
    """The rows with the name of their set, in the column ``name``."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for s in slices(texts):
                doc, h = distinct_shingles(s, size)
                names = binaries([k.tobytes() for k in node_keys(s, doc, h)])
                yield pa.RecordBatch.from_arrays([*batch.slice(s.first, s.n_docs).columns, names], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))
