"""Queries of the training-data operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.substring_dedup import digest

    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=20)


ORACLES["op1_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 18)) AS p FROM w
), wins AS (
  SELECT s.doc_id, s.p, sha256(array_to_string(w.words[s.p : s.p + 19], ' ')) AS h FROM starts s JOIN w USING (doc_id)
), again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM wins) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, p + o AS p FROM again, (SELECT unnest(range(20)) AS o)
), flat AS (
  SELECT w.doc_id, u.p, w.words[u.p] AS word FROM w, unnest(range(1, len(w.words) + 1)) AS u(p)
), left_over AS (
  SELECT f.doc_id, count(*) AS n, string_agg(f.word, ' ' ORDER BY f.p) AS t
  FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p WHERE g.p IS NULL GROUP BY 1
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(l.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(l.t, '')) AS kept_sha256
FROM w LEFT JOIN left_over l USING (doc_id)
"""


@_query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.exact_dedup import exact_dedup

    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLES["op10_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.sharding import shard

    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)


ORACLES["op6_sharding"] = r"""
WITH s AS (
  SELECT doc_id, k, -1.0 / ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || k), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS score
  FROM documents, (SELECT unnest(range(17)) AS k)
), b AS (
  SELECT doc_id, CAST(arg_max(k, score) FILTER (k < 16) AS INTEGER) AS shard, CAST(arg_max(k, score) AS INTEGER) AS grown_shard FROM s GROUP BY doc_id
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i)
  )
), bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS v FROM documents
), sums AS (
  SELECT doc_id, CAST(len(v) + 1 AS BIGINT) AS size, xor(list_reduce(v, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM bytes, crc
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM b JOIN sums USING (doc_id)
"""


@_query
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.simhash import simhash_dedup

    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query
def op3_doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.doc_fingerprint import fingerprint

    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.warc import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=0)


@_query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folio.llm.packing import pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.language_id import identify

    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folio.llm.sentencepiece_codec import code

    return code(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.line_dedup import line_dedup

    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
