"""Queries of this subpackage, by name: thin callables over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import contaminated
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.lm_scoring import score_texts
from tessera.llm.merkle import manifest
from tessera.llm.mixing import mix_sources, temperature_weights
from tessera.llm.ngram_join import ngram_components
from tessera.llm.packing import pack
from tessera.llm.substring_dedup import repeated_passages
from tessera.llm.token_counts import token_counts
from tessera.llm.toxicity import toxicity
from tessera.llm.url_filter import filter_urls, host, path
from tessera.llm.warc import derivatives, responses
from tessera.llm.whitening import whiten


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_read(spark, sf_dir, "documents"))


def _hashed(*parts: Column) -> Column:
    """The first 32 bits of the parts' MD5 as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated block list over the hosts of ``pages``: domains added and removed in turn, and one path for some hosts."""
    hosts = pages.select(host(F.col("url")).alias("host"), F.regexp_extract(path(F.col("url")), "^/[^/]+", 0).alias("top")).where("host <> ''").distinct()
    domains = hosts.select("host").distinct().where(_hashed(F.lit("listed"), F.col("host")) % 10 < 6).select(F.lit("domains").alias("list"), F.col("host").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("turn"))
    parents = hosts.where("size(split(host, '[.]')) > 3").select(F.substring_index("host", ".", -3).alias("key")).distinct().where(_hashed(F.lit("parent"), F.col("key")) % 10 < 4).select(F.lit("parents").alias("list"), "key", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("turn"))
    paths = hosts.where("top <> ''").where(_hashed(F.lit("path"), F.col("host"), F.col("top")) % 10 < 3).select(F.lit("paths").alias("list"), F.concat("host", "top").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("turn"))
    every = domains.unionByName(parents).unionByName(paths)
    dated = F.timestamp_seconds(F.lit(1688169600) + _hashed(F.col("key"), F.col("turn").cast("string")) % 46656000)
    return every.select("list", "key", F.when(F.col("turn") % 2 == 0, "add").otherwise("remove").alias("action"), dated.alias("dated"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    second = F.lit(1704067200) + _hashed(F.lit("fetched"), F.col("page_id").cast("string")) % 31536000
    captures = pages.withColumn("fetched_s", second).withColumn("fetched", F.timestamp_seconds("fetched_s"))
    return filter_urls(captures, dated_list(pages)).drop("fetched")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.timestamp_seconds(F.lit(1704067200) + _hashed(F.lit("fetched"), F.col("page_id").cast("string")) % 31536000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return derivatives(responses(_read(spark, sf_dir, "pages"), day)).withColumnRenamed("id_of_source", "page_id")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return mix_sources(docs, temperature_weights(docs, alpha=0.5), seed=1)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_read(spark, sf_dir, "documents"), size=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "similarity", "first_word", "n_words")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    import public_tokenizers

    return token_counts(_read(spark, sf_dir, "documents"), model_file or public_tokenizers.path("piece_bpe_32k.model"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    found = [F.col(c) + touched.cast("long") if c == "n_chars" else F.col(c) for c in names]
    return manifest(docs, names, found=found).proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    import public_tokenizers

    packed = pack(_read(spark, sf_dir, "documents"), model_file or public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_read(spark, sf_dir, "embeddings")).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_warc": op5_warc,
    "op6_mix_sources": op6_mix_sources,
    "op7_ngram_join": op7_ngram_join,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op4_url_filters": r"""
        WITH captures AS (
          SELECT page_id, url, 1704067200 + ('0x' || substr(md5('fetched|' || page_id), 1, 8))::BIGINT % 31536000 AS fetched_s,
                 regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)', 1) AS host,
                 regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
          FROM pages),
        hosts AS (SELECT DISTINCT host, regexp_extract(path, '^/[^/]+', 0) AS top FROM captures WHERE host <> ''),
        turns AS (
          SELECT 'domains' AS list, host AS key, unnest([0, 1, 2, 3]) AS turn FROM (SELECT DISTINCT host FROM hosts) WHERE ('0x' || substr(md5('listed|' || host), 1, 8))::BIGINT % 10 < 6
          UNION ALL
          SELECT 'parents', key, unnest([0, 1]) FROM (SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS key FROM hosts WHERE len(string_split(host, '.')) > 3) WHERE ('0x' || substr(md5('parent|' || key), 1, 8))::BIGINT % 10 < 4
          UNION ALL
          SELECT 'paths', host || top, unnest([0, 1, 2]) FROM hosts WHERE top <> '' AND ('0x' || substr(md5('path|' || host || '|' || top), 1, 8))::BIGINT % 10 < 3),
        entries AS (SELECT list, key, turn % 2 AS off, 1688169600 + ('0x' || substr(md5(key || '|' || turn), 1, 8))::BIGINT % 46656000 AS dated FROM turns),
        single AS (SELECT list, key, dated, max(off) AS off FROM entries GROUP BY ALL),
        spans AS (SELECT list, key, off, dated AS since, lead(dated) OVER (PARTITION BY list, key ORDER BY dated) AS until FROM single),
        met AS (
          SELECT page_id, list || ':' || key AS what FROM captures, spans
          WHERE off = 0 AND since <= fetched_s AND (until IS NULL OR fetched_s < until)
            AND (host = key OR ends_with(host, '.' || key) OR host || path = key OR (key LIKE '%/%' AND starts_with(host || path, key || '/'))))
        SELECT page_id, url, fetched_s, count(what) > 0 AS blocked, count(what) AS n_matches, min(what) AS matched
        FROM captures LEFT JOIN met USING (page_id) GROUP BY page_id, url, fetched_s
    """,
    "op6_mix_sources": r"""
        WITH sized AS (SELECT source, count(*) AS n, sqrt(count(*)) AS part FROM documents GROUP BY source),
        rated AS (SELECT source, part / sum(part) OVER () * sum(n) OVER () / n AS rate FROM sized),
        steps AS (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT))) AS k FROM rated),
        mass AS (SELECT source, k, exp(sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(k) END) OVER (PARTITION BY source ORDER BY k)) AS p FROM steps),
        cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS at_most FROM mass),
        lists AS (SELECT source, list(at_most ORDER BY k) AS at_most FROM cdf GROUP BY source),
        drawn AS (
          SELECT d.*, len(list_filter(l.at_most, lambda p: p <= ('0x' || substr(md5('1|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0)) AS copies
          FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
        each AS (SELECT *, unnest(generate_series(1, copies)) AS nth FROM drawn WHERE copies > 0)
        SELECT doc_id, text, lang, source, n_chars, CAST(nth AS INT) AS copy, md5('order1|' || doc_id || '|' || nth) AS shuffle_key FROM each
    """,
    "op8_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        b0 AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
        b AS (SELECT item_id, w, len(w) AS l, least(len(w), 5) AS width, len(w) - least(len(w), 5) + 1 AS m FROM b0 WHERE len(w) > 0),
        bi AS (SELECT *, unnest(generate_series(1, m)) AS i FROM b),
        bs AS (SELECT item_id, l, width, m, array_to_string(w[i:i + width - 1], ' ') AS sh, count(*) AS c FROM bi GROUP BY ALL),
        di AS (SELECT doc_id, w, len(w) AS n, width, unnest(generate_series(1, len(w) - width + 1)) AS p FROM d, (SELECT DISTINCT width FROM b) WHERE len(w) >= width),
        ds AS (SELECT doc_id, n, width, p, array_to_string(w[p:p + width - 1], ' ') AS sh FROM di),
        hits AS (SELECT doc_id, n, item_id, l, ds.width AS width, m, least(m, n - ds.width + 1) AS own, p, ds.sh AS sh, c FROM ds JOIN bs ON ds.sh = bs.sh AND ds.width = bs.width),
        wins AS (SELECT DISTINCT doc_id, item_id, m, own, n, l, unnest(generate_series(greatest(1, p - m + 1), least(p, greatest(1, n - l + 1)))) AS s FROM hits),
        met AS (SELECT wins.doc_id, wins.item_id, wins.m, wins.own, wins.n, wins.l, s, sh, least(count(*), max(c)) AS k
                FROM wins JOIN hits ON wins.doc_id = hits.doc_id AND wins.item_id = hits.item_id AND p BETWEEN s AND s + wins.own - 1 GROUP BY ALL),
        sim AS (SELECT doc_id, item_id, s, least(l, n) AS n_words, sum(k) AS shared, m + own - sum(k) AS every FROM met GROUP BY doc_id, item_id, s, l, n, m, own),
        best AS (SELECT *, shared / every AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / every DESC, s) AS nth FROM sim WHERE shared * 100 >= every * 80)
        SELECT doc_id, item_id, similarity, CAST(s AS INT) AS first_word, CAST(n_words AS INT) AS n_words FROM best WHERE nth = 1
    """,
    "op7_ngram_join": r"""
        WITH RECURSIVE t AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        places AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS p FROM t WHERE len(w) > 0),
        sets AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS gram FROM places),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes i ON i.doc_id = a JOIN sizes j ON j.doc_id = b WHERE 100 * k >= 90 * (i.n + j.n - k)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM t UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.other = ways.a)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
    """,
    # crc32 is spelled out: for each byte one exclusive or and eight shifts
    "op11_merkle_manifest": r"""
        WITH RECURSIVE d AS (
          SELECT *, xor(4294967295, list_reduce([4294967295::BIGINT] || flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')]),
                   lambda crc, o: CASE WHEN o >= 0 THEN xor(crc, o) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END)) % 7 = 0 AS touched FROM documents),
        v AS (
          SELECT doc_id, coalesce('=' || lang, '') AS key, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                 coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars, n_chars + CASE WHEN touched THEN 1 ELSE 0 END AS n_found FROM d),
        hashed AS (SELECT doc_id, key, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf, sha256(head || coalesce(strlen(n_found::VARCHAR) || ':' || n_found, '-') || tail) AS found FROM v),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM hashed),
        tree AS (
          SELECT key, 0 AS level, idx, leaf AS h, n FROM leaves
          UNION ALL SELECT key, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 1) // 2) FROM tree WHERE n > 1 GROUP BY key, level, idx // 2),
        subroots AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
        upper AS (
          SELECT 0 AS level, idx, h, n FROM subroots
          UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 1) // 2) FROM upper WHERE n > 1 GROUP BY level, idx // 2),
        walk AS (
          SELECT key, idx AS leaf_idx, 0 AS level, idx, n, found AS h, '' AS proof FROM leaves
          UNION ALL SELECT w.key, w.leaf_idx, w.level + 1, w.idx // 2, (w.n + 1) // 2, sha256(CASE WHEN w.idx % 2 = 0 THEN w.h || coalesce(t.h, '') ELSE t.h || w.h END), w.proof || coalesce(t.h, '')
          FROM walk w LEFT JOIN tree t ON t.key = w.key AND t.level = w.level AND t.idx = xor(w.idx, 1) WHERE w.n > 1),
        rise AS (
          SELECT w.key, w.leaf_idx, 0 AS level, s.idx, s.n, w.h, w.proof FROM walk w JOIN subroots s USING (key) WHERE w.n = 1
          UNION ALL SELECT w.key, w.leaf_idx, w.level + 1, w.idx // 2, (w.n + 1) // 2, sha256(CASE WHEN w.idx % 2 = 0 THEN w.h || coalesce(t.h, '') ELSE t.h || w.h END), w.proof || coalesce(t.h, '')
          FROM rise w LEFT JOIN upper t ON t.level = w.level AND t.idx = xor(w.idx, 1) WHERE w.n > 1)
        SELECT l.doc_id, l.leaf, s.h AS subroot, u.h AS root, sha256(r.proof) AS proof_sha256, r.h AS folded_root, r.h = u.h AS verified
        FROM leaves l JOIN rise r ON r.key = l.key AND r.leaf_idx = l.idx AND r.n = 1 JOIN subroots s ON s.key = l.key JOIN upper u ON u.n = 1
    """,
}
