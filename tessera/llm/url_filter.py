"""URL filters by a temporal list join, in DataFrame functions only.

List entries are dated: an ``add`` puts a key (a domain, or a host and path prefix) on a list, a ``remove``
takes it off; an entry holds until the key's next entry. The entries of a key, in the order of their dates, are its history, cut into
parts of at most ``HISTORY`` entries with the time that each part covers. An as-of join on the key brings every capture to the one part that covers its fetch time, and
the last entry at or before that time decides. So an open entry costs one row, and a key with a long history doesn't meet its captures entry by entry.

Histories are broadcast where their size, measured first, is at most ``MAX_BROADCAST_BYTES``; captures aren't shuffled then. Else the
join is shuffled on the key, where Spark splits keys with many captures.

A capture's keys are its host, each parent domain, and the host with each leading part of the path that
ends at a slash or at the path's end; case, port, user and a leading ``www.`` don't count.

Defined results: a capture without url or time matches nothing. Domains are lower-cased, paths are not. Entries without key, date or action
have no effect, and an entry of a null list counts for a list of its own, named as the empty string; of one list's entries of one key and date, ``remove``
counts. Times have no bounds: an entry without a later one holds for ever. Verdicts depend on url and time only, so rows that repeat get the same verdict and none is
lost. A url is read whole. Empty tables: no captures give no rows, no entries block nothing. Output columns replace columns of ``captures`` of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.broadcasts import light
from tessera.llm.names import unused
from tessera.scratch import Scratch


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys(url: Column) -> Column:
    """Every list key that would cover the url."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(path(url), "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.concat(host(url), F.array_join(F.slice(parts, 1, i), "/")))
    return F.array_distinct(F.filter(F.concat(domains, prefixes), lambda k: k != ""))


HISTORY = 32
MAX_BROADCAST_BYTES = 64 << 20


def histories(entries: DataFrame) -> DataFrame:
    """(key, list, since, until, history): half-open, an open end is null; history is a sorted array of (dated, listed)."""
    key = F.when(F.instr("key", "/") > 0, F.col("key")).otherwise(F.lower("key"))
    known = entries.where("key is not null and dated is not null and action in ('add', 'remove')")
    one = known.groupBy(F.coalesce("list", F.lit("")).alias("list"), key.alias("key"), "dated").agg((F.max("action") == "add").alias("listed"))
    along = Window.partitionBy("list", "key")
    part = F.floor((F.row_number().over(along.orderBy("dated")) - 1) / HISTORY)
    parts = one.withColumn("part", part).groupBy("list", "key", "part").agg(F.min("dated").alias("since"), F.sort_array(F.collect_list(F.struct("dated", "listed"))).alias("history"))
    return parts.select("key", "list", "since", F.lead("since").over(along.orderBy("since")).alias("until"), "history")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Columns of ``captures``, ``blocked``, ``n_matches`` and ``matched`` (list:key, the smallest, or null).

    ``entries`` holds (list, key, action, dated).
    """
    kept = [c for c in captures.columns if c.lower() not in ("blocked", "n_matches", "matched")]
    url_, at, n, what = unused(captures.columns, "__url", "__at", "__n", "__what")
    url, time = F.col(f"`{url_col}`"), F.col(f"`{time_col}`")
    whole = captures.where(url.isNotNull() & time.isNotNull())
    rest = captures.where(url.isNull() | time.isNull())
    wanted = whole.select(url.alias("asked_url"), time.alias("asked_at")).distinct().select("asked_url", "asked_at", F.explode(keys(F.col("asked_url"))).alias("key"))
    covering = light(Scratch(captures.sparkSession).table(histories(entries), keep=True), MAX_BROADCAST_BYTES)
    met = wanted.join(covering, "key").where((F.col("since") <= F.col("asked_at")) & (F.col("until").isNull() | (F.col("asked_at") < F.col("until"))))
    last = F.element_at(F.filter("history", lambda e: e["dated"] <= F.col("asked_at")), -1)
    verdict = met.where(last["listed"]).groupBy(F.col("asked_url").alias(url_), F.col("asked_at").alias(at)).agg(F.count("*").alias(n), F.min(F.concat_ws(":", "list", "key")).alias(what))
    found = whole.join(verdict, (url == F.col(url_)) & (time == F.col(at)), "left")
    columns = [F.col(f"`{c}`") for c in kept]
    number = F.coalesce(F.col(n), F.lit(0).cast("long"))
    out = found.select(*columns, (number > 0).alias("blocked"), number.alias("n_matches"), F.col(what).alias("matched"))
    return out.union(rest.select(*columns, F.lit(False), F.lit(0).cast("long"), F.lit(None).cast("string")))
