"""Queries over the test tables, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.text import fuzzy_match, line_facts
from folio.operators import lines as L
from folio.operators import retrieval as R
from folio.operators import upsert as U
from folio.operators.blocks import cosine_stats
from folio.operators.distances import head_distances
from folio.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("SELECT doc_id, substr(text, 1, 100) AS preview FROM documents")
def doc_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 100).alias("preview"))


@query("SELECT doc_id, source, text FROM documents WHERE source IN ('src1', 'src3')")
def source_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src3")).select("doc_id", "source", "text")


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND source <> ''")
def distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").where("source <> ''").distinct()


@query("SELECT coalesce(source, '未知来源') AS source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def chunk_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("未知来源")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


_LINES = """lines AS (
  SELECT doc_id, i - 1 AS pos, parts[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i) WHERE parts[i] <> ''
)"""


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(text, '^#+', '')) AS text FROM lines WHERE NOT regexp_full_match(text, '-?[0-9]+([.][0-9]+)?') AND trim(regexp_replace(text, '^#+', '')) <> ''")
def clean_lines(spark, sf_dir):
    return L.clean_lines(L.split_lines(table(spark, sf_dir, "documents")))


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS chunk_id, text FROM lines")
def chunk_numbering(spark, sf_dir):
    return L.number(L.split_lines(table(spark, sf_dir, "documents"))).select("doc_id", "pos", "chunk_id", "text")


@query(f"""WITH {_LINES}, s AS (
  SELECT *, CAST(sum(CASE WHEN regexp_matches(text, '^[A-D]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS section FROM lines
) SELECT doc_id, section, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY pos) AS text FROM s GROUP BY 1, 2""")
def section_islands(spark, sf_dir):
    return L.section_texts(L.split_lines(table(spark, sf_dir, "documents")), F.col("text").rlike("^[A-D]"))


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, text FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM lines) WHERE b IS NULL OR b <> text")
def dedupe_adjacent(spark, sf_dir):
    return L.dedupe_adjacent(L.split_lines(table(spark, sf_dir, "documents")))


def _bm25(source: str = "documents") -> str:
    return f"""tokens AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM {source}),
post AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY 1, 2),
dl AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY 1),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, corpus GROUP BY term, n),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM benchmark WHERE item_id % 50 = 0),
score AS (SELECT q.query_id, p.doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post p JOIN q USING (term) JOIN stats USING (term) JOIN dl USING (doc_id), corpus GROUP BY 1, 2),
best AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM score QUALIFY rank <= 10)"""


@query(f"WITH {_bm25()} SELECT term, df, round(idf, 6) AS idf FROM stats")
def bm25_term_stats(spark, sf_dir):
    stats, _ = R.term_stats(materialize(R.postings(table(spark, sf_dir, "documents")), "postings"))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


def _evaluated(spark: SparkSession, sf_dir: str, q: DataFrame) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return R.evaluate(R.knn(vectors, q).join(vectors, "vec_id").select("query_id", "rank", "embedding"), q)


def _arms(spark: SparkSession, sf_dir: str, q: DataFrame) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return R.hybrid({"bm25": R.bm25_top(docs, q), "overlap": R.overlap_top(docs, q)})


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'missing: k' END AS error FROM events")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(k.isNull(), "missing: k").alias("error"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'th') THEN 'save' WHEN role = 'user' THEN 'retrieve' ELSE 'unknown' END AS route FROM conversations""")
def route_queries(spark, sf_dir):
    from folio.operators.control import route

    rows = table(spark, sf_dir, "conversations")
    reply = F.when(F.lower("text").rlike("th"), " SAVE").when(F.col("role") == "user", "Retrieve ").otherwise("other")
    return rows.select("conv_id", "turn", route(reply).alias("route"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def conversation_stats(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"))


@query("""WITH t AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch(ts) - epoch(before) > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM t)
SELECT user_id, CAST(n AS BIGINT) AS session, count(*) AS beats FROM s GROUP BY 1, 2""")
def heartbeat_sessions(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by).cast("timestamp")) > 60_000_000
    rows = table(spark, sf_dir, "events").withColumn("starts", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0))
    return rows.withColumn("session", F.sum("starts").over(by)).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("beats"))


def _by_label(spark: SparkSession, sf_dir: str, q: DataFrame) -> DataFrame:
    return cosine_stats(table(spark, sf_dir, "embeddings"), q, "label", "vec_id", "embedding", R.BROADCAST)


@query()
def chunk_recursive(spark, sf_dir):
    from folio.operators.chunking import recursive

    return recursive(table(spark, sf_dir, "documents"), 500)


# Searches for every id divisible by 50; ranks are within a query.


@query(f"WITH {_bm25()} SELECT * FROM best")
def bm25_topk(spark, sf_dir):
    return R.bm25_top(table(spark, sf_dir, "documents"), _questions(spark, sf_dir))


@query(f"WITH part AS (SELECT * FROM documents WHERE source IN ('src1', 'src3')), {_bm25('part')} SELECT * FROM best")
def bm25_filtered_topk(spark, sf_dir):
    return R.bm25_top(source_filter(spark, sf_dir), _questions(spark, sf_dir))


_VECTORS = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, label, e, q, list_sum(list_transform(list_zip(e, q), lambda x: power(x[1] - x[2], 2))) AS l2,
  list_dot_product(e, q) / nullif(sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)), 0) AS cos FROM v, q)"""


@query(f"WITH {_VECTORS} SELECT query_id, vec_id, round(l2, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(l2, 6), vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def knn_l2_topk(spark, sf_dir):
    return R.knn(table(spark, sf_dir, "embeddings"), _query_vectors(spark, sf_dir))


@query(f"WITH {_VECTORS} SELECT query_id, vec_id, round(cos, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 6) DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def cosine_topk(spark, sf_dir):
    return R.knn(table(spark, sf_dir, "embeddings"), _query_vectors(spark, sf_dir), metric="cosine")


@query(f"WITH {_VECTORS} SELECT query_id, label, vec_id, round(l2, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id, label ORDER BY round(l2, 6), vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3")
def knn_per_label(spark, sf_dir):
    return R.knn_by(table(spark, sf_dir, "embeddings"), _query_vectors(spark, sf_dir), "label")


@query(f"""WITH {_VECTORS}, top AS (SELECT query_id, e, cos, row_number() OVER (PARTITION BY query_id ORDER BY round(l2, 6), vec_id) AS rank FROM s QUALIFY rank <= 10),
d AS (SELECT a.query_id, round(1 - avg(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))), 6) AS diversity FROM top a JOIN top b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY 1)
SELECT query_id, round(avg(cos), 6) AS avg_cosine, round(max(cos), 6) AS max_cosine, any_value(diversity) AS diversity FROM top LEFT JOIN d USING (query_id) GROUP BY 1""")
def retrieval_eval(spark, sf_dir):
    return _evaluated(spark, sf_dir, _query_vectors(spark, sf_dir))


_JACCARD = """sets AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents),
qs AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS qw FROM benchmark WHERE item_id % 50 = 0),
jac AS (SELECT query_id, doc_id, round(coalesce(len(list_intersect(w, qw)) / nullif(len(w) + len(qw) - len(list_intersect(w, qw)), 0), 0), 6) AS j FROM sets, qs),
arm AS (SELECT query_id, doc_id, j AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY j DESC, doc_id) AS INTEGER) AS rank FROM jac QUALIFY rank <= 10),
both_arms AS (SELECT *, 'bm25' AS origin FROM best UNION ALL SELECT *, 'overlap' AS origin FROM arm)"""


@query(f"WITH {_bm25()}, {_JACCARD} SELECT query_id, doc_id, score, rank, origin FROM both_arms")
def hybrid_union(spark, sf_dir):
    return _arms(spark, sf_dir, _questions(spark, sf_dir))


@query(f"""WITH {_bm25()}, {_JACCARD}
SELECT query_id, doc_id, origin, score, CAST(r AS INTEGER) AS rank FROM (SELECT query_id, doc_id, origin, j AS score, row_number() OVER (PARTITION BY query_id ORDER BY j DESC, doc_id, origin) AS r FROM (SELECT query_id, doc_id, origin FROM both_arms) JOIN jac USING (query_id, doc_id)) WHERE r <= 10""")
def rerank_topk(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return R.rerank(_arms(spark, sf_dir, q), table(spark, sf_dir, "documents"), q)


@query(f"WITH {_VECTORS} SELECT query_id, label, round(avg(cos), 6) AS avg_cosine, round(max(cos), 6) AS max_cosine FROM s GROUP BY 1, 2")
def cosine_by_label(spark, sf_dir):
    return _by_label(spark, sf_dir, _query_vectors(spark, sf_dir))


# Chunkers and heading match over all documents; the queries of the same names without _documents are over literals.


@query()
def chunk_fixed_documents(spark, sf_dir):
    from folio.operators.chunking import fixed

    return fixed(table(spark, sf_dir, "documents"), 500)


@query()
def pack_simple_documents(spark, sf_dir):
    from folio.operators.chunking import pack_lines

    return pack_lines(table(spark, sf_dir, "documents"), 500)


@query()
def fuzzy_heading_match_documents(spark, sf_dir):
    """The first line of each benchmark item as heading, each document as the text that may start with it: all pairs."""
    heads = table(spark, sf_dir, "benchmark").select("item_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("head"))
    heads = heads.withColumn("bare", F.regexp_replace("head", r"(?U)\s", ""))
    longest = heads.agg(F.max(F.length("head"))).head()[0] or 0
    facts = line_facts(F.col("text"), longest)
    # made before the pairs, one text at a time: as expressions of a pair they would be made for each
    docs = table(spark, sf_dir, "documents").select("doc_id", facts.alias("facts")).repartition(4 * spark.sparkContext.defaultParallelism)
    pairs = docs.crossJoin(F.broadcast(heads))
    return pairs.select("doc_id", "item_id", fuzzy_match(F.col("head"), F.col("facts.start"), facts=F.col("facts"), bare=F.col("bare")).alias("m")).select("doc_id", "item_id", "m.matched", "m.end")


# Upserts whose store and batch together are all documents, and all benchmark headings against all documents.


def _store_and_rest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    stored = F.coalesce(F.col("doc_id") % 5 < 3, F.lit(False))
    return docs.where(stored), docs.where(~stored).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("new"), F.col("source"))).otherwise(F.col("source")))


_UPSERT = """store AS (SELECT source, doc_id, text FROM documents WHERE coalesce(doc_id % 5 < 3, false)),
batch AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'new' || source ELSE source END AS source, doc_id, text FROM documents WHERE NOT coalesce(doc_id % 5 < 3, false))"""


@query(f"WITH {_UPSERT} SELECT * FROM batch WHERE EXISTS (SELECT 1 FROM store WHERE store.source = batch.source)")
def upsert_existing(spark, sf_dir):
    store, batch = _store_and_rest(spark, sf_dir)
    return U.existing(batch, store)


@query(f"WITH {_UPSERT} SELECT * FROM batch WHERE NOT EXISTS (SELECT 1 FROM store WHERE store.source = batch.source)")
def upsert_new(spark, sf_dir):
    store, batch = _store_and_rest(spark, sf_dir)
    return U.new(batch, store)


@query(f"WITH {_UPSERT} SELECT * FROM store WHERE NOT EXISTS (SELECT 1 FROM batch WHERE batch.source = store.source) UNION ALL SELECT * FROM batch")
def upsert_replace(spark, sf_dir):
    return U.upsert(*_store_and_rest(spark, sf_dir))


@query(f"WITH {_UPSERT} SELECT * FROM store UNION ALL SELECT * FROM batch WHERE NOT EXISTS (SELECT 1 FROM store WHERE store.source = batch.source)")
def upsert_append(spark, sf_dir):
    return U.upsert(*_store_and_rest(spark, sf_dir), replace=False)


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS t FROM documents), b AS (SELECT item_id, split_part(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), chr(10), 1) AS h FROM benchmark)
SELECT doc_id, item_id, round(1 - levenshtein(h, substr(t, 1, length(h))) / nullif(length(h), 0), 6) AS similarity FROM d, b""")
def levenshtein_heads(spark, sf_dir):
    """Every pair has a similarity, so none can be blocked away."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    heads = table(spark, sf_dir, "benchmark").select("item_id", F.split_part(plain, F.lit("\n"), F.lit(1)).alias("head"))
    docs = table(spark, sf_dir, "documents").select("doc_id", plain.alias("plain"))
    return head_distances(docs, heads).select("doc_id", "item_id", F.round(F.lit(1.0) - F.col("d") / F.nullif("n", F.lit(0)), 6).alias("similarity"))
