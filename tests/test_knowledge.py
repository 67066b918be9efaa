"""Sources, store, retrieval strategies, answers and streams against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions.models import HashingEmbedder, OfflineText, OverlapReranker, words
from folio.operators import retrieval as R
from folio.sources import markdown as M
from folio.sources.store import Store

TEXTS = {
    ("a.md", 0): "spark reads parquet files fast", ("a.md", 1): "the cluster shuffles rows by key", ("b.md", 0): "a broadcast join sends the small side", ("b.md", 1): "rows are read from parquet",
    ("c.md", 0): "", ("c.md", 1): "parquet parquet parquet", ("d.md", 0): "nothing to see here",
}


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    rows = [(s, i, t) for (s, i), t in TEXTS.items()]
    made.add(spark.createDataFrame(rows, "source string, chunk_id int, text string"))
    return made


def best(vectors, q, k):
    d = {key: round(float(((v.astype(float) - q.astype(float)) ** 2).sum()), 6) for key, v in vectors.items()}
    return d, k


def test_markdown_sources(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "x 1+2.md").write_text("# 甲\ntext", encoding="utf-8")
    (tmp_path / "in" / "sub" / "y.MD").write_text("second", encoding="utf-8")
    (tmp_path / "in" / "no.txt").write_text("other")
    (tmp_path / "in" / "bad.md").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "in" / "big.md").write_bytes(b"a" * (M.MAX_BYTES + 1))
    docs, bad = M.markdown_dir(spark, str(tmp_path / "in"))
    assert {(r.source, r.text) for r in docs.collect()} == {("x 1+2.md", "# 甲\ntext"), ("y.MD", "second")}
    assert {(r.file_path.rsplit("/", 1)[1], r.error) for r in bad.collect()} == {("bad.md", "not UTF-8"), ("big.md", "larger than 10 MB")}
    assert [r.text for r in M.markdown_file(spark, str(tmp_path / "in" / "sub" / "y.MD")).collect()] == ["second"]
    for path, error in (("in/none.md", M.NotFound), ("in/no.txt", M.NoMarkdown), ("in/bad.md", M.NoMarkdown), ("in/big.md", M.NoMarkdown)):
        with pytest.raises(error):
            M.markdown_file(spark, str(tmp_path / path))
    (tmp_path / "empty").mkdir()
    for path, error in (("none", M.NotFound), ("in/no.txt", M.NotFolder), ("empty", M.NoMarkdown)):
        with pytest.raises(error):
            M.markdown_dir(spark, str(tmp_path / path))


def test_store_batches_replace_append_remove_and_fail(spark, store, tmp_path):
    assert store.exists() and not Store(spark, str(tmp_path / "none")).exists()
    live = lambda: {(r.source, r.chunk_id, r.text) for r in store.chunks().collect()}
    assert live() == {(s, i, t) for (s, i), t in TEXTS.items()}
    frame = lambda rows: spark.createDataFrame(rows, "source string, chunk_id int, text string")
    store.add(frame([("a.md", 0, "new"), ("e.md", 0, "e")]))
    assert {x for x in live() if x[0] in "a.md e.md"} == {("a.md", 0, "new"), ("e.md", 0, "e")}
    assert store.postings().where("source = 'a.md'").count() == 1 and store.vectors().where("source = 'a.md'").count() == 1
    store.add(frame([("a.md", 0, "ignored"), ("f.md", 0, "f")]), replace=False)
    assert ("a.md", 0, "new") in live() and ("f.md", 0, "f") in live()
    before = live()

    def broken(texts):
        raise ValueError("no model")

    failing = Store(spark, store.root, embedder=broken)
    with pytest.raises(Exception):
        failing.add(frame([("b.md", 0, "lost")]))
    assert live() == before
    store.remove(["b.md", "unknown.md"])
    assert live() == {x for x in before if x[0] != "b.md"}
    store.compact()
    assert live() == {x for x in before if x[0] != "b.md"} and len(store.batches()) == 1
    assert sorted(r.source for r in store.registry().collect()) == ["a.md", "c.md", "d.md", "e.md", "f.md"]


@pytest.mark.parametrize("strategy", [*R.STRATEGIES, "unknown"])
@pytest.mark.parametrize("sources", [None, ["a.md", "b.md"]])
def test_strategies(spark, store, strategy, sources):
    """Against plain Python: both arms, the union with repeats, the re-ranker and the filters; the text models mark what they made."""
    model = lambda task, text: {"hyde": text + " join", "translate": text + " rows"}.get(task, text)
    asked = "parquet files"
    made = {"hyde": asked + " join", "faissbert": asked + " rows", "bm25rerank": asked + " rows"}.get(strategy, asked + " join rows")
    texts = {k: t for k, t in TEXTS.items() if sources is None or k[0] in sources}
    embedder, k = HashingEmbedder(), 3
    vectors = dict(zip(texts, embedder(list(texts.values())), strict=True))
    q = embedder([made])[0]
    near = {key: round(float(((v.astype(float) - q.astype(float)) ** 2).sum()), 6) for key, v in vectors.items()}
    queries = spark.createDataFrame([(7, asked)], "query_id int, query string")
    rows = R.retrieve(store, queries, strategy, k, sources, model).orderBy("rank").collect()
    found = [(r.source, r.chunk_id) for r in rows]
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and all(r.text == texts[r.source, r.chunk_id] for r in rows)
    if strategy in ("hyde", "faissbert"):
        assert [r.score for r in rows] == sorted(near.values())[:k] and all(near[f] == r.score for f, r in zip(found, rows, strict=True))
        return
    terms = {key: t.lower().split() for key, t in texts.items()}
    n, avg = sum(bool(t) for t in terms.values()), np.mean([len(t) for t in terms.values() if t])
    df = {w: sum(w in t for t in terms.values()) for t in terms.values() for w in t}
    raw = {w: np.log(n - c + 0.5) - np.log(c + 0.5) for w, c in df.items()}
    idf = {w: x if x >= 0 else 0.25 * np.mean(list(raw.values())) for w, x in raw.items()}
    bm25 = {key: round(sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in made.split() if w in t), 6) for key, t in terms.items() if set(t) & set(made.split())}
    rank = asked if strategy == "bm25rerank" else made
    score = lambda t: round(len(set(t.split()) & set(rank.split())) / len(set(t.split()) | set(rank.split())), 6)
    pool = sorted(near.values())[:k], sorted(bm25.values(), reverse=True)[:k]
    expected = sorted([score(texts[key]) for key in sorted(near, key=lambda x: near[x])[: len(pool[0])]] + [score(texts[key]) for key in sorted(bm25, key=lambda x: -bm25[x])[: len(pool[1])]], reverse=True)[:k]
    assert [r.score for r in rows] == expected and all(score(r.text) == r.score for r in rows)


def test_retrieve_needs_a_store(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.retrieve(Store(spark, str(tmp_path / "none")), spark.createDataFrame([("x",)], "query string"))


def test_many_queries_meet_the_vectors_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    usual = sorted(map(tuple, R.knn(vectors, queries, 2).collect()))
    monkeypatch.setattr(R, "BROADCAST", 2)
    assert sorted(map(tuple, R.knn(vectors, queries, 2).collect())) == usual


def test_models():
    e = HashingEmbedder(16)(["a b", "b a", "", "c"])
    assert np.allclose(e[0], e[1]) and not e[2].any() and np.isclose(np.linalg.norm(e[3]), 1)
    assert OverlapReranker()(["a b", ""], ["b c", ""]) == [1 / 3, 0.0]
    assert words("中文检索 X1, y") == ["中文", "文检", "检索", "x1", "y"] and words("好 a好") == ["好", "a", "好"]
    assert OfflineText()("route", "please save this") == "save" and OfflineText()("route", "what is it") == "retrieve"


def test_refine_asks_in_order_of_rank(spark):
    from folio.operators import answer as A

    results = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (2, 1, None)], "query_id long, rank int, text string")
    queries = spark.createDataFrame([(1, "q"), (2, "p"), (3, "none")], "query_id long, query string")
    model = lambda task, text: "|".join(text.split("\x1f"))
    got = {r.query_id: r.answer for r in A.refine(results, queries, model).collect()}
    assert got == {1: "q|second|q|first|", 2: "p||", 3: A.EMPTY}


def test_judges_and_metrics(spark):
    from folio.operators import answer as A

    rows = spark.createDataFrame([(1, "red fox", "the red fox ran. A blue whale sang.", "the red fox ran"), (2, "x", A.EMPTY, None)], "query_id long, query string, answer string, sources string")
    judged = A.judge(rows, lambda task, text: f"I give {len(task) % 5 + 1} of 5").collect()[0]
    assert (judged.faithfulness, judged.relevance, judged.completeness) == (12 % 5 + 1, 9 % 5 + 1, 12 % 5 + 1)
    results = spark.createDataFrame([(1, 1, "stones and sand"), (1, 2, "the red fox ran")], "query_id long, rank int, text string")
    got = {r.query_id: r for r in A.evaluate_answers(rows.drop("sources"), results).collect()}
    assert got[1].grounded == 0.5 and got[1].context_precision == 0.5 and got[1].skipped is None
    assert got[2].skipped == A.EMPTY and got[2].avg_cosine is None


def test_reports_are_written_in_order(spark, tmp_path):
    from folio.sources import reports

    chunks = spark.createDataFrame([(1, i, f"text {i}") for i in range(20)], "doc_id long, chunk_id int, text string").repartition(6)
    reports.write_text(reports.chunk_report(chunks), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x for x in lines if x.startswith("text")] == [f"text {i}" for i in range(20)] and lines.count(reports.LINE) == 20
    reports.write_text(reports.answer_report(spark.createDataFrame([(1, "q", "a")], "query_id long, query string, answer string")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("value = '# q'").count() == 1


def test_ingest_stream(spark, tmp_path):
    from folio.operators.chunking import recursive
    from folio.streaming.ingest import ingest, markdown_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("one two", encoding="utf-8")
    made = Store(spark, str(tmp_path / "store"))
    chunk = lambda docs: recursive(docs, 5).withColumnRenamed("pos", "chunk_id")
    run = lambda: ingest(markdown_stream(spark, str(tmp_path / "in")), made, chunk, str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "b.md").write_text("three", encoding="utf-8")
    run()
    assert {(r.source, r.chunk_id, r.text) for r in made.chunks().collect()} == {("a.md", 0, "one"), ("a.md", 1, " two"), ("b.md", 0, "three")}


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from folio import session

    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_engine_from_a_folder_to_answers(spark, tmp_path):
    from folio.engine import Engine

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "cats.md").write_text("# Cats\nCats sleep all day.\n# Food\nCats eat fish.", encoding="utf-8")
    (tmp_path / "in" / "dogs.md").write_text("# Dogs\nDogs run and eat meat every day.", encoding="utf-8")
    (tmp_path / "in" / "bad.md").write_bytes(b"\xff\xfe")
    engine = Engine(spark)
    done = engine.ingest_dir(str(tmp_path / "in"), -1)
    assert done.batch == 0 and done.features == {"cats.md": 2, "dogs.md": 1} and len(done.warnings) == 1
    engine.preload()
    assert engine.loaded() == ["chunks", "postings", "vectors"] and engine.table("chunks").count() == 3
    best = engine.retrieve("who does eat meat", 2).orderBy("rank").collect()
    assert (best[0].source, best[0]["rank"]) == ("dogs.md", 1) and "meat" in best[0].text and len(best) == 2
    asked = spark.createDataFrame([(1, "what do they eat in cats.md"), (2, "dogs run")], "query_id long, query string")
    got = {r.query_id: r for r in engine.answer(asked, 2).collect()}
    assert got[1].sources == ["cats.md"] and "fish" in got[1].answer and "Dogs run" in got[2].answer
    engine.ingest_dir(str(tmp_path / "in"), -1)
    assert engine.loaded() == [] and engine.table("chunks").count() == 3  # replaced, not doubled
