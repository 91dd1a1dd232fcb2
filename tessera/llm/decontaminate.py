"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A benchmark item of L words is looked for in windows of L words at every place of every text (a shorter text is one window). The
measure is the weighted Jaccard similarity of the two multisets of word shingles, counts being weights; a window is
contaminated where ``den * shared >= num * union``.

1. Gate. Of the m shingles of such a window at most m * (den - num) / (den + num) aren't the item's, so of every ``stride``-th
   shingle of the text at least floor(m / stride) less that many inside the window must be. Only windows with that many are
   fingerprinted; no window that could pass the measure is left out.
2. Fingerprints of 64 bits are SimHashes over the window's words. Multi-index Hamming blocks: fingerprints are cut into 8 bytes, and an item's
   bytes are listed with all their variants of up to two changed bits, so that every item within ``RADIUS`` = 23
   bits of a window shares a listed byte with it (24 changed bits would be needed to change each byte thrice). Windows are looked up among the items that the gate gave
   them, by item, block and byte: a window meets an item about 1.2 times, however many items there are.
3. The measure is computed exactly, on the words themselves, for what the index returns.

Item tables are broadcast only up to 64 MB, measured first; beyond that they meet by shuffled joins.

What isn't exact: a window that passes the measure but whose fingerprint is more than ``RADIUS`` bits off is missed. Windows that pass have at least 8 of 9 shingles in
common, hence nearly all words: of modelled windows at the very threshold, of 5 to 400 words with words replaced apart, side by side or at an end, less than 1 in 10,000
is farther off (the tests hold it to that; the worst kind, a tenth replaced at an end, lies 9 bits off on average).

Defined results: very long texts are looked at whole. Words are split at ASCII white space and lower-cased. An item of fewer than ``size`` words has its whole sequence as
its one shingle; null or empty items and texts match nothing. Rows that repeat id and text give one row per item; rows of one id and
different texts are looked at apart. Items that repeat an item_id are each looked for. Empty tables
give no rows. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.broadcasts import MAX_BYTES, light, size_of
from tessera.llm.names import unused
from tessera.scratch import Scratch

RADIUS = 23
_LANES = 0x0000000100000001


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingle_hash(of: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.slice(of, at, width))


def numbered(shingles: Column) -> Column:
    """Equal shingles told apart by a running number, so that set operations count them all."""
    nth = F.transform(shingles, lambda x, i: F.concat(x, F.lit(" #"), F.size(F.filter(F.slice(shingles, 1, i + 1), lambda y: y == x)).cast("string")))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), F.transform(shingles, lambda x: F.concat(x, F.lit(" #1")))).otherwise(nth)


def text_shingles(of: Column, width: Column) -> Column:
    last = F.size(of) - width + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(of, i, width), " "))).otherwise(F.array().cast("array<string>"))


def vote_sums(h: Column) -> list[Column]:
    """Counts of each of the 64 bits over rows, two to a number."""
    return [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(_LANES))).alias(f"v{i}") for i in range(32)]


def majority(n: Column) -> Column:
    """The bits set in more than half of the n rows whose ``vote_sums`` these are."""
    out = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"v{i}"), 32)
        out = out.bitwiseOR(F.when(low * 2 > n, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        out = out.bitwiseOR(F.when(high * 2 > n, F.shiftleft(F.lit(1).cast("long"), i + 32)).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(windows: DataFrame, keys: list[str], words_col: str) -> DataFrame:
    """(keys, fp) of rows that ``keys`` tell apart."""
    each = windows.select(*keys, F.size(words_col).alias("n_words"), F.explode(words_col).alias("word"))
    return each.withColumn("h", F.xxhash64("word")).groupBy(*keys, "n_words").agg(*vote_sums(F.col("h"))).select(*keys, majority(F.col("n_words")).alias("fp"))


def bytes_of(fp: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(8)])


def stride_for(fewest: int, num: int, den: int) -> int:
    """The largest step up to 4 at which every window of ``fewest`` shingles or more has a sampled one that the item shares."""
    for step in (4, 3, 2):
        if step <= fewest and all(m // step > m * (den - num) // (den + num) for m in range(fewest, max(fewest, 20 * step * (num + den) // max(1, num + den - step * (den - num))) + 1)):
            return step
    return 1


def row_key(id_col: str, text_col: str) -> Column:
    """Id and a hash of the text, by which rows are looked at."""
    return F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("no id")), F.lit(":"), F.xxhash64(F.col(f"`{text_col}`")).cast("string"))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words, distance, n_windows): for each text and item the best window, the first of equals."""
    return contaminated_rows(docs, benchmark, size, num, den, id_col, text_col, item_col, item_text_col).drop("key")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(key, doc_id, item_id, similarity, first_word, n_words, distance, n_windows): as ``contaminated``, and the row's ``row_key``."""
    spark = docs.sparkSession
    with Scratch(spark) as s:
        item = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), words(F.col(f"`{item_text_col}`")).alias("item_words")).where("size(item_words) > 0").distinct()
        item = item.withColumn("item", F.xxhash64("item_id", "item_words")).withColumn("length", F.size("item_words")).withColumn("width", F.least("length", F.lit(size)))
        items = s.table(item.withColumn("m", F.col("length") - F.col("width") + 1))
        shapes = items.groupBy("width").agg(F.min("m").alias("fewest")).collect()  # at most ``size`` rows
        grams = items.select("item", "length", "width", "m", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("m")), lambda i: F.xxhash64(F.slice("item_words", i, F.col("width")))))).alias("h"))
        grams = s.table(grams)
        text = docs.select(F.col(f"`{id_col}`").alias("doc_id"), words(F.col(f"`{text_col}`")).alias("words"), row_key(id_col, text_col).alias("key"))
        text = text.withColumn("n", F.size("words"))
        few = size_of(grams) <= MAX_BYTES
        hits = None
        for width, fewest in sorted(map(tuple, shapes)):
            step = stride_for(-(-num * fewest // den), num, den)
            found = sampled_hits(text, grams.where(F.col("width") == width), width, step, few)
            hits = found if hits is None else hits.unionByName(found)
        if hits is None:
            hits = sampled_hits(text, grams, size, 1, few)
        hits = s.table(hits.distinct())

        whole = F.col("n") < F.col("length")
        last = F.when(whole, F.lit(1)).otherwise(F.least(F.col("p"), F.col("n") - F.col("length") + 1))
        starts = F.when(whole, F.array(F.lit(1))).otherwise(F.sequence(F.greatest(F.lit(1), F.col("p") - F.col("m") + 1), last))
        own = F.least("m", F.col("n") - F.col("width") + 1)
        needed = F.floor(own / F.col("step")) - F.floor(own * (den - num) / (den + num))
        placed = hits.where(F.when(whole, True).otherwise(last >= F.greatest(F.lit(1), F.col("p") - F.col("m") + 1))).withColumn("needed", F.greatest(needed, F.lit(1)))
        window = placed.select("key", "item", "p", "needed", F.explode(starts).alias("first_word")).groupBy("key", "item", "first_word").agg(F.min("p").alias("p"), F.count("*").alias("n_hits"), F.max("needed").alias("needed")).where("n_hits >= needed")
        cut = window.select("key", "item", "first_word", "p").join(hits, ["key", "item", "p"]).select("key", "doc_id", "item", "first_word", "length", F.slice("near", F.col("first_word") - F.col("base") + 1, F.least("length", "n")).alias("words"))
        cut = cut.groupBy("key", "doc_id", "first_word", "length").agg(F.first("words").alias("words"), F.collect_set("item").alias("items"))
        windows = s.table(cut)
        marked = fingerprints(windows.select("key", "first_word", "length", "words"), ["key", "first_word", "length"], "words")
        listed = s.table(fingerprints(items.select("item", "item_words"), ["item"], "item_words").withColumnRenamed("fp", "item_fp"))
        index = listed.select("item", "item_fp", F.posexplode(bytes_of(F.col("item_fp"))).alias("block", "byte")).withColumn("byte", F.explode(F.array(*[F.col("byte").bitwiseXOR(F.lit(x)) for x in range(256) if x.bit_count() <= 2])))
        index = s.table(index)
        asked = marked.join(windows.select("key", "first_word", "length", "items"), ["key", "first_word", "length"]).select("key", "first_word", "length", "fp", F.explode("items").alias("item"))
        asked = asked.select("*", F.posexplode(bytes_of(F.col("fp"))).alias("block", "byte"))
        off = F.col("fp").bitwiseXOR(F.col("item_fp"))
        by_byte = F.transform(bytes_of(off), lambda x: F.bit_count(x) <= 2)
        near = asked.join(light(index, MAX_BYTES), ["item", "block", "byte"]).where(F.bit_count(off) <= RADIUS).where(F.array_position(by_byte, True) == F.col("block") + 1)
        near = s.table(near.select("key", "first_word", "length", "item", F.bit_count(off).alias("distance")))

        compared = near.join(windows, ["key", "first_word", "length"]).join(light(items.select("item", "item_id", "item_words", "width"), MAX_BYTES), "item")
        mine, its = numbered(text_shingles(F.col("words"), F.col("width"))), numbered(text_shingles(F.col("item_words"), F.col("width")))
        measured = compared.select("key", "doc_id", "item", "item_id", "first_word", "distance", F.size("words").alias("n_words"), mine.alias("mine"), its.alias("its")).withColumn("shared", F.size(F.array_intersect("mine", "its")))
        union = F.size("mine") + F.size("its") - F.col("shared")
        passed = measured.withColumn("all", union).where(F.col("shared") * den >= F.col("all") * num).withColumn("similarity", F.col("shared") / F.col("all"))
        best = F.max(F.struct("similarity", (-F.col("first_word")).alias("early"), "n_words", "distance")).alias("best")
        out = s.table(passed.groupBy("key", "doc_id", "item", "item_id").agg(best, F.count("*").alias("n_windows")), keep=True)
    return out.select("key", "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.early")).alias("first_word"), F.col("best.n_words").alias("n_words"), F.col("best.distance").alias("distance"), "n_windows")


def sampled_hits(text: DataFrame, grams: DataFrame, width: int, step: int, few: bool) -> DataFrame:
    """(key, doc_id, item, p, ...): every ``step``-th shingle of a text that an item has, with the words near it."""
    places = F.sequence(F.lit(1), F.col("n") - width + 1, F.lit(step))
    sampled = text.where(F.col("n") >= width).select("key", "doc_id", "words", "n", F.posexplode(F.transform(places, lambda i: shingle_hash(F.col("words"), i, width))).alias("place", "h"))
    sampled = sampled.withColumn("p", F.col("place") * step + 1)
    base = F.greatest(F.lit(1), F.col("p") - F.col("length"))
    columns = ["key", "doc_id", "item", "p", "n", "length", "width", "m", F.lit(step).alias("step"), base.alias("base"), F.slice("words", base, 2 * F.col("length") + width).alias("near")]
    if few:
        return sampled.join(F.broadcast(grams), "h").select(*columns)
    narrow = sampled.select("key", "p", "h").join(grams, "h").drop("h")
    return narrow.join(text.where(F.col("n") >= width), "key").select(*columns)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a contaminated window, told by id and text: with or without an id each by its own text."""
    mine, hit = unused(docs.columns, "__key", "__hit")
    hits = contaminated_rows(docs, benchmark, size, num, den, id_col, text_col).select(F.col("key").alias(hit)).distinct()
    keyed = docs.withColumn(mine, row_key(id_col, text_col))
    return keyed.join(hits, keyed[mine] == hits[hit], "left_anti").drop(mine)
