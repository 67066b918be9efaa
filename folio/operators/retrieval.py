"""Hybrid retrieval: BM25 and k-NN arms, union, re-rank, top k, strategies, and evaluation.

A query table has a row for each query, told apart by `query_id`; every result has that column, and ranks are within a query. A table
without it is numbered row by row, so no query is lost; where results are joined later, give the ids. Query sides are the small ones: their
terms are joined by term, and their vectors are broadcast while there are at most BROADCAST of them (beyond that, by blocks); vectors meet as blocks
(folio.operators.blocks). Postings are
written once, and statistics and scores are read off them; ranks are limited in each task before rows are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from folio.functions.models import Embedder, Reranker, TextModel, ask, embed, rerank_score
from folio.functions.text import tokens
from folio.functions.vectors import cosine, squared_l2
from folio.operators import blocks
from folio.operators.terms import best_by_terms, count_terms
from folio.session import materialize, sent

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries whose vectors are sent to every task at once, and results that a broadcast may hold.
BROADCAST = 10_000
#: Pairs of a query's term and a text that has it, beyond which the best texts are found block by block.
HITS = 100_000_000
STRATEGIES = ("hyde", "faissbert", "bm25rerank", "default")


def postings(chunks: DataFrame, key: str = "doc_id", text: str = "text", tokenizer=tokens) -> DataFrame:
    """(key, dl, term, tf): how often a text of dl terms has a term; terms are lower-case words between white space."""
    return count_terms(chunks.select(key, tokenizer(F.col(text)).alias("words")), "words")


def term_stats(post: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) and one row (n, avgdl, mean_idf). A negative idf is EPSILON times the mean over all terms."""
    counts = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    corpus = post.groupBy(key).agg(F.first("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    raw = counts.crossJoin(F.broadcast(corpus)).select("term", "df", "n", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"), F.max("n").alias("n"), F.max("avgdl").alias("avgdl"))
    stats = raw.crossJoin(F.broadcast(mean.select("mean_idf"))).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return stats, mean.select("n", "avgdl", "mean_idf")


def named(query: DataFrame) -> DataFrame:
    """The query table with a query_id."""
    return query if "query_id" in query.columns else query.withColumn("query_id", F.monotonically_increasing_id())


def bm25_scores(post: DataFrame, query: DataFrame, key: str = "doc_id", tokenizer=tokens, best: int | None = None) -> DataFrame:
    """(query_id, key, score rounded to 6 places) of the texts of written postings that have a term of the query (column `query`). A repeated term counts again.
    best: only the so many best of a query are needed; where there are over HITS pairs of a query's term and a text, no others are made then."""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = materialize(df, "terms")  # one row a term: read for the mean and for the terms of the queries
    corpus = post.groupBy(key).agg(F.first("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    n, avgdl = corpus.head()
    if not n:
        return post.select(F.lit(0).cast("long").alias("query_id"), key, F.lit(0.0).alias("score")).where("false")
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = df.agg(F.avg(raw)).head()[0]
    wanted = named(query).select("query_id", F.explode(tokenizer(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    weights = wanted.join(df, "term").select("query_id", "term", "df", (F.col("times") * F.when(raw < 0, F.lit(EPSILON * mean)).otherwise(raw)).alias("weight"))
    weights = materialize(weights, "weights")
    room = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl))
    whole = all(isinstance(kind, ByteType | ShortType | IntegerType | LongType) for kind in (post.schema[key].dataType, weights.schema["query_id"].dataType))
    if best is not None and whole and (weights.agg(F.sum("df")).head()[0] or 0) > HITS:
        texts = post.select(key, "term", (F.col("tf") * (K1 + 1) / room).alias("value"))
        return best_by_terms(texts, weights, best, key).select("query_id", key, F.round("score", 6).alias("score"))
    hits = post.join(sent(weights.drop("df")), "term")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / room
    return hits.groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"))


def bm25(chunks: DataFrame, query: DataFrame, key: str = "doc_id", text: str = "text", best: int | None = None) -> DataFrame:
    """bm25_scores on texts whose postings are written first: the texts are read once."""
    return bm25_scores(materialize(postings(chunks, key, text), "postings"), query, key, best=best)


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query in this order, with their rank from 1. Spark limits the groups of a rank in each task first."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def bm25_top(chunks: DataFrame, query: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    return top(bm25(chunks, query, key, text, k), k, F.desc("score"), F.asc(key))


def _pairs(rows: DataFrame, query: DataFrame, *columns: str) -> DataFrame:
    """rows with the columns of every query: a small query side is sent whole, a larger one in blocks, each of which meets a copy of
    the rows; so no task holds more than a block."""
    asked = named(query).select("query_id", *columns)
    if asked.limit(BROADCAST + 1).count() <= BROADCAST:
        return rows.crossJoin(F.broadcast(asked))
    blocks = -(-asked.count() // BROADCAST)
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    return rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))).join(asked, "_block").drop("_block")


def knn(vectors: DataFrame, query: DataFrame, k: int = 10, metric: str = "l2", key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank) of the k nearest vectors to each query vector (column `q`), exactly. l2: squared distance."""
    found = _scored(vectors, query, k, metric, key, column)
    order = [F.asc_nulls_last("score") if metric == "l2" else F.desc_nulls_last("score"), F.asc(key)]
    return top(found.select("query_id", key, F.round("score", 6).alias("score")), k, *order)


def _scored(vectors: DataFrame, query: DataFrame, k: int, metric: str, key: str, column: str, group: str | None = None) -> DataFrame:
    """(query_id, [group,] key, score) of all pairs that the k best can be among; of all where keys or vectors can't be packed."""
    query = named(query).select("query_id", "q")
    if blocks.packable(vectors, key, column) and blocks.packable(query, "query_id", "q"):
        return blocks.nearest(vectors, query, k, metric, key, column, group, BROADCAST)
    score = (squared_l2 if metric == "l2" else cosine)(F.col(column), F.col("q"))
    return _pairs(vectors, query, "q").select("query_id", *([group] if group else []), key, score.alias("score"))


def knn_by(vectors: DataFrame, query: DataFrame, group: str, k: int = 3, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest vectors of each group, for each query."""
    pairs = _scored(vectors, query, k, "l2", key, column, group).select("query_id", group, key, F.round("score", 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", group).orderBy(F.asc_nulls_last("score"), F.asc(key)))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two texts' sets of terms, the offline re-ranker."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def overlap_top(chunks: DataFrame, query: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k texts of each query with the largest Jaccard index of terms; texts without a common term count 0 and come last by key.

    The terms are made once a text, and each term of a query is looked up in them."""
    rows = _pairs(chunks.select(key, F.array_distinct(tokens(F.col(text))).alias("w")), named(query).select("query_id", F.array_distinct(tokens(F.col("query"))).alias("qw")), "qw")
    both = F.size(F.array_intersect("w", "qw"))
    score = F.round(F.coalesce(both / F.nullif(F.size("w") + F.size("qw") - both, F.lit(0)), F.lit(0.0)), 6)
    return top(rows.select("query_id", key, score.alias("score")), k, F.desc("score"), F.asc(key))


def hybrid(arms: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of the arms, with the arm's name; duplicates stay."""
    out = None
    for name, df in arms.items():
        part = df.withColumn("origin", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def rerank(candidates: DataFrame, chunks: DataFrame, query: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", reranker: Reranker | None = None) -> DataFrame:
    """Of each query's candidates the k whose texts score highest with it: by the overlap of terms, or by a re-ranker. Candidates and queries both have a query_id."""
    rows = chunks.select(key, text).join(sent(materialize(candidates, "candidates")), key).join(query.select("query_id", "query"), "query_id")
    score = jaccard(F.col("query"), F.col(text)) if reranker is None else rerank_score(F.col("query"), F.col(text), reranker)
    scored = rows.select("query_id", key, "origin", F.round(score, 6).alias("score"))
    return top(scored, k, F.desc("score"), F.asc(key), F.asc("origin"))


def retrieve(store, queries: DataFrame, strategy: str = "default", k: int = 10, sources: list[str] | None = None, model: TextModel | None = None, reranker: Reranker | None = None) -> DataFrame:
    """(query_id, rank, score, origin, id, source, chunk_id, text) of the k best chunks of a store for each query (query_id, query), of all sources or of those given.

    hyde: the vector arm with a hypothetical document. faissbert: the vector arm with the translated query. bm25rerank: vector and BM25 arms with
    the translated query, k each, duplicates kept, re-ranked with the original query. default: the same with a translated hypothetical document, re-ranked with
    that. Filters hold before anything is ranked, and the BM25 statistics are those of the filtered chunks. Raises where there is no store."""
    if not store.exists():
        raise FileNotFoundError(f"there is no store in {store.root}")
    strategy = strategy.strip().lower()
    strategy = strategy if strategy in STRATEGIES else "default"
    asked = named(queries).select("query_id", "query")
    text = F.col("query")
    if strategy in ("hyde", "default"):
        text = ask("hyde", text, model)
    if strategy != "hyde":
        text = ask("translate", text, model)
    wanted = materialize(asked.select("query_id", text.alias("query")), "queries")  # models answer once
    chunks = store.chunks(sources)
    vectors = wanted.select("query_id", embed(F.col("query"), store.embedder).alias("q"))
    near = knn(store.vectors(sources), vectors, k, key="id")
    if strategy in ("hyde", "faissbert"):
        best = near.withColumn("origin", F.lit("vector"))
    else:
        words = top(bm25_scores(store.postings(sources), wanted, "id", store.tokenizer, k), k, F.desc("score"), F.asc("id"))
        both = hybrid({"vector": near, "bm25": words})
        best = rerank(both, chunks, asked if strategy == "bm25rerank" else wanted, k, "id", reranker=reranker)
    return chunks.select("id", "source", "chunk_id", "text").join(sent(materialize(best, "best")), "id").select("query_id", "rank", "score", "origin", "id", "source", "chunk_id", "text")


def mentioned_sources(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """queries with `sources`: those whose name, without its ending, the query mentions (null where it mentions none), and `query` without the names.
    Sources are looked up by the words of the query, so no pair is made that shares none."""
    stem = F.lower(F.regexp_replace("source", r"\.[A-Za-z0-9]+$", ""))
    names = sources.select("source", stem.alias("stem")).where("stem <> ''").distinct().withColumn("word", F.split_part("stem", F.lit(" "), F.lit(1)))
    words = named(queries).select("query_id", "query", F.explode(F.array_distinct(F.concat(tokens(F.col("query")), tokens(F.regexp_replace("query", r"[^\w\s]", " "))))).alias("word"))
    found = words.join(names, "word").where(F.lower("query").contains(F.col("stem")))
    by = found.groupBy("query_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("stem")).alias("stems"))
    out = named(queries).join(by, "query_id", "left")
    bare = F.aggregate(F.coalesce("stems", F.array().cast("array<string>")), F.col("query"), lambda q, s: F.regexp_replace(q, F.concat(F.lit(r"(?iU)(?<!\w)\Q"), s, F.lit(r"\E(\.[a-z0-9]+)?(?!\w)")), F.lit("")))
    return out.select("query_id", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("query"), "sources")


def evaluate(results: DataFrame, query: DataFrame, column: str = "embedding") -> DataFrame:
    """(query_id, avg_cosine, max_cosine, diversity): results are each query's top k with `rank`; diversity is null for fewer than two."""
    c = cosine(F.col(column), F.col("q"))
    sims = results.join(query.select("query_id", "q"), "query_id").groupBy("query_id").agg(F.round(F.avg(c), 6).alias("avg_cosine"), F.round(F.max(c), 6).alias("max_cosine"))
    a, b = results.select("query_id", F.col("rank").alias("i"), F.col(column).alias("va")), results.select("query_id", F.col("rank").alias("j"), F.col(column).alias("vb"))
    pairs = a.join(b, "query_id").where("i < j").groupBy("query_id").agg(F.round(1 - F.avg(cosine(F.col("va"), F.col("vb"))), 6).alias("diversity"))
    return sims.join(pairs, "query_id", "left")
