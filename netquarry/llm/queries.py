"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from . import bpe, hilbert, packing, pii, quality, revisit, seekable, simhash, topk, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
#: The key of the surrogates. A deployment passes its own, kept apart from the data.
PII_KEY = "netquarry demonstration key"
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORDS, capacity=2048)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTES, public_tokenizers.PATTERN)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replaced(docs, PII_KEY)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisit.resolve(revisit.captures(table(spark, sf_dir, "pages")))
    return found.select("record_id", F.expr("record_id div 3").alias("page_id"), "url_key", "kind", "source_id", "status", revisit.header_text(F.col("headers")).alias("headers"), "payload_digest")


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shards(table(spark, sf_dir, "documents"), n=24)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seekable.written_and_read(table(spark, sf_dir, "documents"), WORDS)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


ALL = (op1_packing, op2_simhash, op3_byte_bpe, op4_topk, op5_pii, op6_quality, op7_revisit, op8_hilbert, op9_token_files, op10_toxicity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


#: Scores of whole vectors in DuckDB; the other operators here have no SQL form (tokenizers, XXH64, crc32, files).
ORACLE_SQL = {
    "op4_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.c, c.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.c) = len(c.c)
    WHERE q.vec_id % 50 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op7_revisit": r"""
WITH bare AS (
    SELECT CAST(page_id AS BIGINT) AS page_id, sha256(coalesce(html, '')) AS digest,
           regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b
    FROM pages
), parts AS (
    SELECT page_id, digest, split_part(b, '?', 1) AS place, regexp_extract(b, '\?(.*)$', 1) AS query FROM bare
), page AS (
    SELECT page_id, digest,
           regexp_replace(regexp_replace(lower(split_part(place, '/', 1)), '^[^@]*@|:(?:80|443)$', '', 'g'), '^www\d*\.', '')
           || regexp_replace(regexp_extract(place, '^[^/]*(/.*)$', 1), '/+$', '')
           || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key
    FROM (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)'))) AS kept FROM parts)
), r AS (
    SELECT page_id * 3 + nth AS record_id, page_id, nth, url_key, digest, page_id + 40 * nth AS ts, (page_id + nth) % 5 AS rule,
           nth = 0 OR (page_id + nth) % 5 = 0 AS is_full
    FROM page, (SELECT unnest([0, 1, 2]) AS nth)
), v AS (
    SELECT *, 'day ' || ts AS date, CASE WHEN rule <> 4 THEN 'day ' || page_id END AS modified,
           CASE WHEN is_full THEN '"' || digest[1:12] || '"' WHEN rule = 1 THEN 'W/"' || digest[1:12] || '"' WHEN rule = 2 THEN '"other"' WHEN rule = 4 THEN '"' || digest[1:12] || '"' END AS etag,
           last_value(CASE WHEN is_full THEN record_id END IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS response_id
    FROM r
), j AS (
    SELECT v.*, f.digest AS f_digest, f.etag AS f_etag, f.modified AS f_modified,
           CASE WHEN v.is_full THEN 'response' WHEN f.record_id IS NULL THEN 'missing'
                ELSE CASE coalesce(regexp_replace(v.etag, '^W/', '') = regexp_replace(f.etag, '^W/', ''), v.modified = f.modified)
                     WHEN TRUE THEN 'resolved' WHEN FALSE THEN 'stale' ELSE 'unchecked' END END AS status
    FROM v LEFT JOIN v f ON NOT v.is_full AND f.record_id = v.response_id
)
SELECT record_id, page_id, url_key, CASE WHEN is_full THEN 'response' ELSE 'revisit' END AS kind,
       CASE WHEN is_full THEN record_id ELSE response_id END AS source_id, status,
       array_to_string(list_filter([
           CASE WHEN NOT is_full THEN 'cache-control: max-age=' || nth END,
           'content-type: ' || CASE WHEN is_full OR status = 'resolved' THEN 'text/html' ELSE 'text/plain' END,
           'date: ' || date,
           'etag: ' || CASE WHEN status = 'resolved' THEN coalesce(etag, f_etag) ELSE etag END,
           'last-modified: ' || CASE WHEN status = 'resolved' THEN f_modified ELSE modified END
       ], lambda x: x IS NOT NULL), chr(10)) AS headers,
       CASE WHEN is_full THEN digest WHEN status = 'resolved' THEN f_digest END AS payload_digest
FROM j
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
