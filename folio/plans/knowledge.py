"""Queries of the store, retrieval strategies, answers and reports, over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.models import HashingEmbedder, tokenize
from folio.operators import answer as A
from folio.operators import control
from folio.operators import retrieval as R
from folio.session import materialize, sent, temporary
from folio.sources import reports
from folio.sources.markdown import synthetic_documents, valid_documents
from folio.sources.store import Store

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


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunks (source, chunk_id, doc_id, text), numbered within their source."""
    return numbered(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id").select("source", "chunk_id", "doc_id", "text")


def numbered(rows: DataFrame, group: str, order: str, pieces: int = 32) -> DataFrame:
    """rows with chunk_id, their number from 0 within a group. A group is dealt out in ranges of the order and numbered in each, on from how many rows
    the ranges before have; so a large group is no large task."""
    bounds = rows.select(F.percentile_approx(order, [(i + 1) / pieces for i in range(pieces - 1)], 1000)).head()[0] or []
    piece = F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b <= F.col(order))), F.lit(-1)) if bounds else F.lit(0)
    piece = F.when(F.col(order).isNull(), -1).otherwise(piece)
    dealt = rows.withColumn("_piece", piece)
    counts = dealt.groupBy(group, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_piece")) - F.col("_n")
    starts = counts.select(F.col(group).alias("_group"), F.col("_piece").alias("_at"), before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy(group, "_piece").orderBy(order)) - 1
    joined = dealt.withColumn("_nth", nth).join(sent(materialize(starts, "starts")), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_piece") == F.col("_at")))
    return joined.select(*rows.columns, (F.col("_nth") + F.col("_before")).cast("int").alias("chunk_id"))


def new_store(spark: SparkSession) -> Store:
    return Store(spark, temporary(spark, "store"))


def store(spark: SparkSession, sf_dir: str) -> Store:
    """A store of all documents, made once a session."""
    known = spark.sparkContext.__dict__.setdefault("_folio_stores", {})
    if sf_dir not in known:
        made = new_store(spark)
        made.add(chunks(spark, sf_dir))
        known[sf_dir] = made
    return known[sf_dir]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_id FROM documents),
first AS (SELECT * FROM c WHERE source < 'src5'), second AS (SELECT * FROM c WHERE source >= 'src3' AND doc_id % 2 = 0)
SELECT source, CAST(chunk_id AS INTEGER) AS chunk_id, doc_id FROM first WHERE source NOT IN (SELECT source FROM second) UNION ALL SELECT source, CAST(chunk_id AS INTEGER), doc_id FROM second""")
def store_upsert(spark, sf_dir):
    """Two batches written and read back: sources of the second replace those of the first."""
    rows, made = chunks(spark, sf_dir), new_store(spark)
    made.add(rows.where("source < 'src5'"))
    made.add(rows.where("source >= 'src3' and doc_id % 2 = 0"))
    return made.chunks().select("source", "chunk_id", "doc_id")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_id FROM documents),
first AS (SELECT * FROM c WHERE source < 'src5'), second AS (SELECT * FROM c WHERE source >= 'src3')
SELECT source, count(*) AS n FROM (SELECT * FROM first UNION ALL SELECT * FROM second WHERE source NOT IN (SELECT source FROM first)) WHERE source <> 'src1' GROUP BY 1""")
def store_append_remove(spark, sf_dir):
    """A second batch that only adds unknown sources, and a source removed, after which all is one batch."""
    rows, made = chunks(spark, sf_dir), new_store(spark)
    made.add(rows.where("source < 'src5'"))
    made.add(rows.where("source >= 'src3'"), replace=False)
    made.remove(["src1"])
    made.compact()
    return made.chunks().groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT source FROM documents")
def store_registry(spark, sf_dir):
    return store(spark, sf_dir).registry()


@query("""WITH t AS (SELECT source, doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM documents), c AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_id FROM documents)
SELECT source, CAST(chunk_id AS INTEGER) AS chunk_id, term, count(*) AS tf, CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS INTEGER) AS dl FROM t JOIN c USING (doc_id) GROUP BY source, doc_id, chunk_id, term""")
def store_postings(spark, sf_dir):
    made = store(spark, sf_dir)
    return made.postings().join(made.chunks().select("id", "chunk_id"), "id").select("source", "chunk_id", "term", "tf", "dl")


def _retrieved(strategy: str, sources: list[str] | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.retrieve(store(spark, sf_dir), questions(spark, sf_dir), strategy, sources=sources).select("query_id", "rank", "score", "origin", "source", "chunk_id")

    return run


for _name in R.STRATEGIES:
    QUERIES[f"retrieve_{_name}"] = _retrieved(_name)
QUERIES["retrieve_filtered"] = _retrieved("default", ["src1", "src3"])


@query()
def refine_fold(spark, sf_dir):
    asked = questions(spark, sf_dir)
    return A.refine(R.retrieve(store(spark, sf_dir), asked, "bm25rerank"), asked)


@query()
def evaluate_answers(spark, sf_dir):
    asked = questions(spark, sf_dir)
    results = R.retrieve(store(spark, sf_dir), asked, "bm25rerank")
    return A.evaluate_answers(asked.join(A.refine(results, asked), "query_id"), results).drop("query", "answer", *(f"{n}_reply" for n in A.JUDGES))


@query()
def answer_graph(spark, sf_dir):
    """Every user turn of the conversations through the graph: routed, and answered with how many chunks were found, or with help."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    made = store(spark, sf_dir)
    saved = lambda q: q.select("query_id", F.lit("stored").alias("output"))
    found = lambda q: R.retrieve(made, q, "bm25rerank").groupBy("query_id").agg(F.count(F.lit(1)).cast("string").alias("output"))
    return A.run(rows, saved, found)


_COSINE = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, round(avg(list_dot_product(e, q) / nullif(sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)), 0)), 6) AS avg_cosine, count(*) AS n FROM v, q GROUP BY 1)"""


@query(f"""WITH {_COSINE} SELECT query_id, '| mean cosine | ' || printf('%.4f', avg_cosine) || ' | avg_cosine |' AS value FROM s UNION ALL SELECT query_id, '| n | ' || printf('%.4f', n::DOUBLE) || ' | n |' FROM s""")
def metric_report(spark, sf_dir):
    """Mean cosine of each query vector (ids divisible by 50) with all vectors, as rows of a report; the column of words is no metric."""
    from folio.functions.vectors import mean_cosine

    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    rows = mean_cosine(vectors, q).crossJoin(F.broadcast(n)).select("query_id", F.round("avg_cosine", 6).alias("avg_cosine"), "n", F.lit("words").alias("note"))
    long = reports.numeric_metrics(rows, describe={"avg_cosine": "mean cosine"})
    return reports.metric_report(long).select("pos.query_id", "value")


@query("SELECT 'chunk 1' || chr(10) || 't' || chr(10) || chr(10) || 'doc_id: 1' || chr(10) || 'chunk_id: 0' || chr(10) || 'titles: [\"甲\"]' || chr(10) || repeat('=', 80) AS value")
def chunk_report(spark, sf_dir):
    return reports.chunk_report(spark.createDataFrame([(1, 0, "t", ["甲"])], "doc_id long, chunk_id int, text string, titles array<string>")).select("value")


@query("SELECT * FROM (VALUES (0, 'a.md', 'what does it say'), (1, NULL, 'nothing named')) AS t(query_id, sources, query)")
def mentioned_sources(spark, sf_dir):
    asked = spark.createDataFrame([(0, "what does A.md it say"), (1, "nothing named")], "query_id int, query string")
    names = spark.createDataFrame([("a.md",), ("b.md",)], "source string")
    return R.mentioned_sources(asked, names).select("query_id", F.array_join("sources", ",").alias("sources"), "query")


@query("SELECT * FROM (VALUES (1, 'a', 'a.md'), (3, 'b', '未知来源')) AS t(doc_id, text, source)")
def input_validity(spark, sf_dir):
    rows = spark.createDataFrame([(1, "a", "a.md"), (2, "  ", "b.md"), (3, "b", None), (4, None, "c.md")], "doc_id int, text string, source string")
    return valid_documents(rows)


@query("SELECT range AS doc_id, 'news' || range || '.md' AS source, 5 AS headings FROM range(50)")
def synthetic_news(spark, sf_dir):
    made = synthetic_documents(spark, 50, seed=7)
    return made.select("doc_id", "source", F.regexp_count("text", F.lit(r"(?m)^#+ ")).alias("headings"))


@query("SELECT * FROM (VALUES (0, 'bm25,hello,abc'), (1, '中文,文检,检索,x1'), (2, '好')) AS t(n, words)")
def segmented_words(spark, sf_dir):
    rows = spark.createDataFrame([(0, "BM25 Hello, abc"), (1, "中文检索 x1"), (2, "好。")], "n int, text string")
    return rows.select("n", F.array_join(tokenize(F.col("text")), ",").alias("words"))


@query("""SELECT * FROM (VALUES (0, 'semantic', 800, 'en'), (1, 'default', 200, 'cn'), (2, 'default', 300, 'cn')) AS t(pos, strategy, size, language)""")
def plan_request(spark, sf_dir):
    """What a request in words plans for each document."""
    rows = spark.createDataFrame([(0, "semantic size=800 en"), (1, "please store this"), (2, "大小300")], "pos int, request string")
    return rows.select("pos", control.plan_of(F.col("request")).alias("p")).select("pos", "p.*")


def embedder() -> HashingEmbedder:
    return HashingEmbedder()
