"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

Classes: an end mark, the ``WORDS`` most frequent training words, and buckets of all other words by their
last two bytes; a rarer word's probability is its bucket's times its add-one share in it, so every text has a
proper probability. One log-bilinear predictor: the vectors of the two preceding classes u1 and u2, each transformed by its position's
diagonal matrix, add up to a context h = c1 * r(u1) + c2 * r(u2), and class w after it has the score h . q(w) + bias(w), normalised over all classes.

Training is in numpy, by mini-batches with ``NOISE`` noise classes each, drawn from the unigram distribution and shared by the batch, so that scores and
gradients are products of matrices. It starts on the driver, on the texts of at most ``WARM_ROWS`` training rows (those of smallest hash, of at most ``WARM_BYTES`` each). From
there all training rows are dealt by a hash of id and text to shards, as many as ``SHARD_TOKENS`` tokens each take; a copy of the model goes through each shard's rows once, in the order of
another hash, and the copies are averaged by their numbers of tokens. So scores don't depend on how rows lie in partitions (but for the order in which floats are added up). What is dealt are classes,
two bytes a word. Word counts are gathered from all training rows too
(a distributed table, never collected). The model's size is fixed by ``WORDS``, ``CLASSES`` and ``DIMENSIONS``; larger ones cost CLASSES ** 2 normalisers.

The exact normaliser of every context, a pair of classes, is found once by batched products of all context and class vectors, dealt over the cluster: a table
of CLASSES x CLASSES numbers, which travels to every task with the model. Tokens are then scored by batched products.

Counts of up to ``FREQUENT`` words, those above a count threshold, travel to every task (16 bytes each); the other
words of a text meet the count table in a shuffled join. Words are identified by 64-bit hashes.

Defined results: a null text is empty and scores its end mark. A null id counts as the empty text in the fold rule. Without
training rows all counts are 0 and classes have the probabilities of an untrained model. Rows are told apart by a tag, so repeated rows
each get their own. Texts are read whole, however long. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.sketch import BLOCK, blocks, combined
from tessera.llm.toxicity import fold
from tessera.llm.words import Slice, mix, slices
from tessera.scratch import Scratch

END, START, FIRST_WORD = 0, 1, 2
WORDS, CLASSES = 1022, 2048
BUCKETS = CLASSES - FIRST_WORD - WORDS
FREQUENT = 1 << 19
DIMENSIONS, NOISE, BATCH, RATE = 24, 64, 1024, 0.15
WARM_ROWS, WARM_BYTES, WARM_EPOCHS = 2000, 1 << 16, 4
SHARD_TOKENS = 1 << 23
_HISTOGRAM = 1 << 12


def bucket(s: Slice) -> np.ndarray:
    """Bucket of each word by its last two bytes."""
    last = s.data[s.end - 1].astype(np.uint64)
    before = np.where(s.end - s.start > 1, s.data[np.maximum(s.end - 2, 0)], 0).astype(np.uint64)
    return (mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Vocabulary:
    hashes: np.ndarray  # of the WORDS top words, sorted

    def classes(self, h: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        return np.where(known, FIRST_WORD + at, FIRST_WORD + WORDS + buckets)


def with_ends(n: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of documents of ``n`` words each, with their ends: class, class before, class two before, document."""
    total = len(classes) + len(n)
    ends = np.cumsum(n + 1) - 1
    token = np.full(total, END)
    is_word = np.ones(total, bool)
    is_word[ends] = False
    token[is_word] = classes
    doc = np.repeat(np.arange(len(n)), n + 1)
    first = ends - n
    one, two = np.empty_like(token), np.empty_like(token)
    one[1:], two[2:] = token[:-1], token[:-2]
    one[first] = START
    two[first] = START
    two[first[n > 0] + 1] = START
    return token, one, two, doc


class LogBilinear:
    """Parameters lie in one array: context vectors, position transforms, class vectors, biases; ``squares`` are AdaGrad's sums."""

    def __init__(self, unigram: np.ndarray, seed: int = 3):
        n, d = len(unigram), DIMENSIONS
        rng = np.random.default_rng(seed)
        self.unigram = unigram
        self.values = np.concatenate([rng.normal(0, 0.1, n * d), np.ones(2 * d), rng.normal(0, 0.1, n * d), np.log(unigram)]).astype(np.float32)
        self.squares = np.full(len(self.values), 1e-2, np.float32)

    def parts(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views (contexts, transforms, classes, biases)."""
        n, d = len(self.unigram), DIMENSIONS
        r, c, q, bias = np.split(of, np.cumsum([n * d, 2 * d, n * d]))
        return r.reshape(n, d), c.reshape(2, d), q.reshape(n, d), bias

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        r, c, _, _ = self.parts(self.values)
        return r[one] * c[0] + r[two] * c[1]

    def train(self, token: np.ndarray, one: np.ndarray, two: np.ndarray, rng: np.random.Generator, rate: float = RATE) -> None:
        """One pass of noise-contrastive steps: maximises log s(d) of the tokens + sum log s(-d) of the noise, d = score - log(NOISE * unigram)."""
        r, c, q, bias = self.parts(self.values)
        squares = self.parts(self.squares)
        log_noise = np.log(NOISE * self.unigram).astype(np.float32)
        bounds = np.cumsum(self.unigram)
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

        def climb(values: np.ndarray, sums: np.ndarray, at: np.ndarray, slope: np.ndarray) -> None:
            """AdaGrad on the rows ``at``, whose slopes are added up where they repeat."""
            order = np.argsort(at, kind="stable")
            at = at[order]
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            slope, at = np.add.reduceat(slope[order], starts, axis=0), at[starts]
            sums[at] += slope * slope
            values[at] += rate * slope / np.sqrt(sums[at])

        for lo in range(0, len(token), BATCH):
            w, u1, u2 = token[lo : lo + BATCH], one[lo : lo + BATCH], two[lo : lo + BATCH]
            noise = np.minimum(np.searchsorted(bounds, rng.random(NOISE) * bounds[-1]), len(bounds) - 1)
            r1, r2 = r[u1], r[u2]
            h = r1 * c[0] + r2 * c[1]
            qw, qn = q[w], q[noise]
            up = 1 - sigmoid(np.einsum("ij,ij->i", h, qw) + bias[w] - log_noise[w])
            down = -sigmoid(h @ qn.T + bias[noise] - log_noise[noise])
            dh = up[:, None] * qw + down @ qn
            at = np.concatenate([w, noise])
            climb(q, squares[2], at, np.concatenate([up[:, None] * h, down.T @ h]))
            climb(bias, squares[3], at, np.concatenate([up, down.sum(axis=0)]))
            climb(r, squares[0], np.concatenate([u1, u2]), np.concatenate([dh * c[0], dh * c[1]]))
            dc = np.stack([(dh * r1).sum(axis=0), (dh * r2).sum(axis=0)])
            squares[1][:] += dc * dc
            c += rate * dc / np.sqrt(squares[1])

    def normalisers(self, two: int) -> np.ndarray:
        """Log normaliser of each context whose farther class is ``two``, by the nearer class."""
        r, c, q, bias = self.parts(self.values)
        scores = (r * c[0] + r[two] * c[1]) @ q.T
        scores += bias
        top = scores.max(axis=1, keepdims=True)
        return (np.log(np.exp(scores - top).sum(axis=1)) + top[:, 0]).astype(np.float32)

    def log_probability(self, token: np.ndarray, one: np.ndarray, two: np.ndarray, normalisers: np.ndarray) -> np.ndarray:
        """Of each token, normalised over the classes; ``normalisers`` by farther and nearer class."""
        _, _, q, bias = self.parts(self.values)
        out = np.empty(len(token))
        for lo in range(0, len(token), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            out[part] = np.einsum("ij,ij->i", self.context(one[part], two[part]), q[token[part]]) + bias[token[part]] - normalisers[two[part], one[part]]
        return out


def word_counts(training: DataFrame) -> DataFrame:
    """(hash, bucket, n) of all words of ``text`` in the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            size = 0
            for s in slices(b.column(0)):
                h, first, n = np.unique(s.hashes(), return_index=True, return_counts=True)
                held.append((h, bucket(s)[first], n))
                size += len(h)
                if size > 1 << 20:
                    yield merged(held)
                    held, size = [], 0
            if held:
                yield merged(held)

    def merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, b, n = (np.concatenate(x) for x in zip(*held))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(b[first].astype(np.int32)), pa.array(np.bincount(inverse, n, len(u)).astype(np.int64))], ["hash", "bucket", "n"])

    return training.mapInArrow(run, "hash long, bucket int, n long").groupBy("hash").agg(F.max("bucket").alias("bucket"), F.sum("n").alias("n"))


def class_counts(counts: DataFrame, buckets: np.ndarray, n: np.ndarray, n_end: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each class in the training rows, and of each bucket its tokens and distinct words together; top words have these buckets and counts."""
    in_bucket, words = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for at, total, distinct in counts.groupBy("bucket").agg(F.sum("n"), F.count("*")).collect():  # at most BUCKETS rows
        in_bucket[at], words[at] = total, distinct
    np.subtract.at(in_bucket, buckets, n)
    np.subtract.at(words, buckets, 1)
    tokens = np.zeros(CLASSES, np.int64)
    tokens[END], tokens[FIRST_WORD : FIRST_WORD + len(n)], tokens[FIRST_WORD + WORDS :] = n_end, n, in_bucket
    return tokens, in_bucket + words


def tokens_of(texts: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for s in slices(texts):
        yield with_ends(s.counts(), vocabulary.classes(s.hashes(), bucket(s)))


def classes_of(training: DataFrame, vocabulary: Vocabulary, shards: int) -> DataFrame:
    """(shard, place, classes): each training row's classes, two bytes each, in order."""
    shared = training.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(0)):
                classes = shared.value.classes(s.hashes(), bucket(s)).astype("<u2")
                ends = np.cumsum(s.counts())
                own = pa.array([classes[i:j].tobytes() for i, j in zip((ends - s.counts()).tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(s.first, s.n_docs) for i in (1, 2)), own], ["shard", "place", "classes"])

    row = training.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("text", "doc_id").alias("place"))
    return row.mapInArrow(run, "shard int, place long, classes binary")


def trained(training: DataFrame, vocabulary: Vocabulary, tokens: np.ndarray, n_rows: int, n_tokens: int, shard_tokens: int = SHARD_TOKENS) -> LogBilinear:
    """The model of all ``n_rows`` training rows (doc_id, text), which have ``n_tokens``."""
    unigram = tokens + 0.5
    unigram[START] = 1e-3
    model = LogBilinear(unigram / unigram.sum())
    # about twice as many rows as are wanted pass the hash, so no task gathers more
    row = training.select("text", F.xxhash64("doc_id", "text").alias("place")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= WARM_BYTES)
    share = min(1.0, 2 * WARM_ROWS / max(1, n_rows))
    chosen = row.where(F.shiftrightunsigned("place", 11) <= int(share * ((1 << 53) - 1))).orderBy("place", "text").limit(WARM_ROWS)
    sample = chosen.select("text").toArrow()  # at most WARM_ROWS * WARM_BYTES
    rng = np.random.default_rng(5)
    if sample.num_rows:
        warm = [np.concatenate(x) for x in zip(*tokens_of(sample.column("text"), vocabulary))][:3]
        for epoch in range(WARM_EPOCHS):
            model.train(*warm, rng, RATE * (1 - epoch / (WARM_EPOCHS + 1)))
    shared = training.sparkSession.sparkContext.broadcast(model)  # of fixed size
    size = len(model.values) + 1
    padded = -(-size // BLOCK) * BLOCK
    shards = max(1, -(-n_tokens // shard_tokens))

    class Shard:
        def __init__(self, number: int):
            self.number, self.model, self.noise = number, copy.deepcopy(shared.value), np.random.default_rng(number)
            self.n = self.size = 0
            self.held: list[bytes] = []

        def add(self, classes: bytes) -> None:
            self.held.append(classes)
            self.size += len(classes) // 2 + 1
            if self.size > 1 << 18:
                self.step()

        def step(self) -> None:
            if self.held:
                n = np.array([len(x) // 2 for x in self.held])
                self.model.train(*with_ends(n, np.frombuffer(b"".join(self.held), "<u2").astype(np.int64))[:3], self.noise, RATE)
                self.n, self.held, self.size = self.n + self.size, [], 0

        def sent(self) -> pa.RecordBatch:
            self.step()
            out = np.zeros(padded)
            out[: size - 1] = self.model.values.astype(np.float64) * self.n
            out[size - 1] = self.n
            numbers, content = blocks(out)
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(content, pa.binary())], ["block", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        for b in batches:
            for number, classes in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if shard is None or shard.number != number:
                    if shard is not None:
                        yield shard.sent()
                    shard = Shard(number)
                shard.add(classes)
        if shard is not None:
            yield shard.sent()

    dealt = classes_of(training, vocabulary, shards).repartition("shard").sortWithinPartitions("shard", "place")
    total = combined(dealt.mapInArrow(run, "block int, content binary"), padded, "float64", "sum")
    if total[size - 1]:
        model.values = (total[: size - 1] / total[size - 1]).astype(np.float32)
    return model


def normalisers_of(spark: SparkSession, model: LogBilinear) -> np.ndarray:
    """(CLASSES, CLASSES): log normalisers by farther and nearer class."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for two in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([two], pa.int64()), pa.array([shared.value.normalisers(two).tobytes()], pa.binary())], ["two", "logs"])

    n = len(model.unigram)
    rows = spark.range(0, n, 1, 64).mapInArrow(run, "two long, logs binary").toArrow()  # n rows of 4 * n bytes
    out = np.empty((n, n), np.float32)
    for two, logs in zip(rows.column("two").to_pylist(), rows.column("logs")):
        out[two] = np.frombuffer(logs.as_buffer(), np.float32)
    return out


@dataclass
class Scorer:
    vocabulary: Vocabulary
    model: LogBilinear
    normalisers: np.ndarray
    frequent: np.ndarray  # hashes, sorted
    log_counts: np.ndarray  # log10(c + 1)
    bucket_sizes: np.ndarray  # log10 of what an add-one share in the bucket is out of
    n_end: int


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, bucket and count of all words over a count threshold, the lowest that at most ``most`` words pass.

    Thresholds are all counts up to _HISTOGRAM, and 64 to each doubling beyond.
    """
    step = F.when(F.col("n") <= _HISTOGRAM, F.col("n")).otherwise(_HISTOGRAM + 1 + F.floor(64 * F.log2(F.col("n") / _HISTOGRAM)))
    histogram = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()  # at most _HISTOGRAM + 64 * 51 rows
    passed, threshold = 0, None
    for at, words in sorted(histogram, reverse=True):
        passed += words
        if passed > most:
            break
        threshold = at
    rows = counts.where(step >= threshold if threshold is not None else F.lit(False)).toArrow()
    h = rows.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], rows.column("bucket").to_numpy()[order], rows.column("n").to_numpy()[order]


def score_texts(docs: DataFrame, folds: int = 7, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from the other folds."""
    spark = docs.sparkSession
    every = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), (fold(id_col, folds) == held_fold).alias("held_out"))
    training = every.where("not held_out").select("doc_id", "text")
    s = Scratch(spark)
    counts = s.table(word_counts(training.select("text")), keep=True)
    n_end = training.count()
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, n_distinct = whole["n"] + n_end, whole["v"] + (n_end > 0)
    h, b, n = frequent_words(counts, frequent)
    top = np.sort(np.lexsort((h, -n))[:WORDS])
    vocabulary = Vocabulary(h[top])
    tokens, sizes = class_counts(counts, b[top], n[top], n_end)
    model = trained(training, vocabulary, tokens, n_end, n_all, shard_tokens)
    scorer = spark.sparkContext.broadcast(Scorer(vocabulary, model, normalisers_of(spark, model), h, np.log10(n + 1.0), np.log10(sizes + 1.0), n_end))  # at most FREQUENT * 16 bytes, the model and its normalisers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = scorer.value
        tag = TaskContext.get().partitionId() << 40
        for batch in batches:
            for s in slices(batch.column(1)):
                yield scored(x, s, batch.slice(s.first, s.n_docs), tag)
                tag += s.n_docs

    kind = every.schema["doc_id"].dataType.simpleString()
    made = s.table(every.mapInArrow(run, f"tag long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, lm double, rare array<long>, times array<int>"), keep=True)
    rare = made.select("tag", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("tag", F.col("r.rare").alias("hash"), F.col("r.times").alias("times"))
    found = rare.join(counts.select("hash", "n"), "hash").groupBy("tag").agg(F.sum("times").alias("__known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("__logs"))
    extra = F.coalesce(F.col("__logs"), F.lit(0.0))
    base = F.col("logs") + extra - F.col("n_tokens") * F.lit(float(np.log10(n_all + n_distinct + 1.0)))
    return made.join(found, "tag", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce(F.col("__known"), F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("lm") + extra).alias("score")
    )


def scored(x: Scorer, s: Slice, rows: pa.RecordBatch, tag: int) -> pa.RecordBatch:
    h, buckets = s.hashes(), bucket(s)
    classes = x.vocabulary.classes(h, buckets)
    token, one, two, doc = with_ends(s.counts(), classes)
    lm = np.bincount(doc, x.model.log_probability(token, one, two, x.normalisers) / np.log(10), s.n_docs)
    at = np.searchsorted(x.frequent, h)
    at[at == len(x.frequent)] = 0
    known = x.frequent[at] == h if len(x.frequent) else np.zeros(len(h), bool)
    logs = np.where(known, x.log_counts[at], 0.0) if len(x.frequent) else np.zeros(len(h))
    shared = classes >= FIRST_WORD + WORDS
    lm += np.bincount(s.doc, np.where(shared, logs - x.bucket_sizes[buckets], 0.0), s.n_docs)
    n = s.counts()
    rare = np.flatnonzero(~known)
    order = rare[np.lexsort((h[rare], s.doc[rare]))]
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (s.doc[order][1:] != s.doc[order][:-1])
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(order))).astype(np.int32)
    offsets = np.searchsorted(s.doc[order][starts], np.arange(s.n_docs + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (h[order][starts].view(np.int64), times)]
    ended = x.n_end > 0
    columns = [
        pa.array(np.arange(tag, tag + s.n_docs)), rows.column(0), rows.column(2), pa.array((n + 1).astype(np.int64)),
        pa.array(np.bincount(s.doc[known], minlength=s.n_docs).astype(np.int64) + ended),
        pa.array(np.bincount(s.doc, logs, s.n_docs) + np.log10(x.n_end + 1.0)), pa.array(lm), *lists,
    ]
    return pa.RecordBatch.from_arrays(columns, ["tag", "doc_id", "held_out", "n_tokens", "known", "logs", "lm", "rare", "times"])
