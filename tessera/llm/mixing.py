"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of n rows that is to make up weight w of a corpus of T rows has the mean repetition rate
w * T / n. Each row's number of copies is that Poisson distribution's quantile at a uniform number
hashed from seed and id, so any run and any partitioning gives the same copies; the copies are then put
into one global order by a hash of seed, id and copy.

Rows that repeat an id have equal shuffle keys; their order among themselves is any.

Defined results: rows of a null source are a source of their own. A null id hashes as the empty
text; rows repeating an id get the same number of copies each. A source without weight, or with one
of 0 or less, gets no copies. Texts aren't looked at, however long. An empty table gives an empty result. The operator's columns replace
columns of ``docs`` of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.broadcasts import MAX_BYTES, light
from tessera.llm.names import unused
from tessera.scratch import Scratch


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the parts' MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """The distribution function at 0, 1, ... up to where what remains is beyond a double's precision."""
    steps = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")

    def step(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = state["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(state["cdf"], F.array(total)).alias("cdf"))

    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["cdf"])


def temperature_weights(docs: DataFrame, source_col: str = "source", alpha: float = 0.5) -> DataFrame:
    """(source, weight): weights in proportion to the number of rows to the power ``alpha``."""
    sized = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.pow(F.count("*").cast("double"), F.lit(alpha)).alias("part"))
    return sized.join(F.broadcast(sized.agg(F.sum("part").alias("whole"))), F.lit(True)).select("source", (F.col("part") / F.col("whole")).alias("weight"))  # one row


def mix_sources(docs: DataFrame, weights: DataFrame, target_rows: int | None = None, seed: int = 1, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Columns of ``docs``, ``copy`` (1, 2, ...) and ``shuffle_key``, in the order of ``shuffle_key``.

    ``weights`` holds (source, weight); ``target_rows`` is the expected size of the result, by
    default that of ``docs``.
    """
    source, n, every, w_source, w, cdf, copies = unused(docs.columns, "__source", "__n", "__all", "__w_source", "__w", "__cdf", "__copies")
    sizes = docs.groupBy(F.col(f"`{source_col}`").alias(source)).agg(F.count("*").alias(n))
    whole = F.lit(target_rows) if target_rows is not None else F.col(every)
    rated = (
        sizes.join(F.broadcast(sizes.agg(F.sum(n).alias(every))), F.lit(True))  # one row
        .join(weights.groupBy(F.col("source").alias(w_source)).agg(F.max("weight").cast("double").alias(w)), F.col(source).eqNullSafe(F.col(w_source)))
        .where(F.col(w) > 0)
        .select(source, poisson_cdf(F.col(w) * whole / F.col(n)).alias(cdf))
    )
    with_cdf = light(Scratch(docs.sparkSession).table(rated, keep=True), MAX_BYTES)  # else a shuffled join, split by Spark where a source is hot
    own_id = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    drawn = docs.join(with_cdf, F.col(f"`{source_col}`").eqNullSafe(F.col(source)))
    number = F.size(F.filter(cdf, lambda p: p <= uniform(F.lit(str(seed)), own_id)))
    kept = drawn.withColumn(copies, number).where(F.col(copies) > 0).drop(cdf, source)
    out = kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(copies)
    return out.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), own_id, F.col("copy").cast("string")).cast("binary"))).orderBy("shuffle_key")
