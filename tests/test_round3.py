"""Faults that larger tables showed."""

import duckdb
from pyspark.sql import functions as F

from folio import catalogue


def test_long_numbers_are_headings_too(spark):
    from folio.operators.structural import structural, whole

    text = "# 1 a\nfirst\n4703443633947811 second\n4703443633947812 third\n" + "9" * 5000 + " fourth"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = "\n".join(r.text for r in structural(docs, -1).orderBy("chunk_id").collect())
    assert all(x in got for x in ("first", "second", "third", "fourth"))
    assert whole("0" + "9" * 5000) == 10**5000 - 1 and whole("12") == 12


def test_scores_are_printed_by_their_exact_value(spark):
    from folio.sources import reports

    scores = [-0.00225, 0.00225, -0.00695, 0.00125, 0.00135, 2.5, None, -0.00001]
    rows = spark.createDataFrame([(i, "m", "d", x) for i, x in enumerate(scores)], "query_id long, name string, description string, score double")
    got = {r.pos.query_id: r.value.split(" | ")[1] for r in reports.metric_report(rows).collect()}
    con = duckdb.connect()
    assert got == {i: "-" if x is None else con.execute("SELECT printf('%.4f', ?::DOUBLE)", [x]).fetchone()[0] for i, x in enumerate(scores)}


def test_mean_cosine_makes_no_pairs(spark):
    from folio.functions.vectors import cosine, mean_cosine

    vectors = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([-1.0, 0.5],), (None,), ([1.0, None],), ([3.0],)], "embedding array<float>")
    query = spark.createDataFrame([(1, [0.3, 0.1]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 2.0, 3.0])], "query_id long, q array<float>")
    usual = vectors.crossJoin(query).groupBy("query_id").agg(F.round(F.avg(cosine(F.col("embedding"), F.col("q"))), 9).alias("avg_cosine"))
    rows = lambda df: sorted((r.query_id, r.avg_cosine) for r in df.collect())
    found = mean_cosine(vectors, query)
    assert rows(found.withColumn("avg_cosine", F.round("avg_cosine", 9))) == rows(usual)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_documents_above_the_size_are_in_a_query_of_their_own(spark, tmp_path):
    texts = [(1, " short "), (2, "word " * 30_000), (3, None), (4, " \n ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    name = "chunk_md_header_documents"
    assert [tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()] == con.execute(catalogue.ORACLES[name]).fetchall() == [(1, 0, "short")]
    every = catalogue.QUERIES["chunk_md_header_all_documents"](spark, str(tmp_path)).orderBy("doc_id", "pos").collect()
    assert [r.text for r in every if r.doc_id == 1] == ["short"] and "".join(r.text for r in every if r.doc_id == 2) == texts[1][1].strip()


def test_semantic_chunks_read_each_sentence_once():
    from folio.functions.models import HashingEmbedder
    from folio.operators.chunking import split_semantic

    class Counting(HashingEmbedder):
        seen = 0

        def bags(self, texts):
            self.seen += sum(map(len, texts))
            return super().bags(texts)

    plain = HashingEmbedder()
    text = "".join(f"Word{i % 7} Σίσυφος{i % 11} über_{i} 中文{i % 3}字 x{'.!,;'[i % 4]} " for i in range(400))
    counting = Counting()
    assert split_semantic(text, 500, "en", counting) == split_semantic(text, 500, "en", lambda t: plain(t)) and counting.seen <= len(text)


def test_workers_hand_pieces_on_bit_by_bit(spark, monkeypatch):
    from folio.operators import chunking as C

    texts = [(i, f"{i} " + "some words. " * 300) for i in range(40)]
    docs = spark.createDataFrame([*texts, (90, None), (91, "")], "doc_id int, text string").coalesce(1)
    found = C._pieces(docs, "text", lambda t: C.split_recursive(t, 100, C.SEPARATORS["en"]))
    got: dict = {}
    for r in found.orderBy("doc_id", "pos").collect():
        got[r.doc_id] = got.get(r.doc_id, "") + r.text
    assert got == dict(texts)


def test_postings_move_no_rows(spark):
    from folio.operators import retrieval as R

    texts = [(1, "a b A c"), (2, ""), (3, None), (4, "中 文 中"), (5, "x " * 3000)]
    post = R.postings(spark.createDataFrame(texts, "doc_id long, text string"))
    assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.dl, r.term, r.tf) for r in post.collect())
    assert got == [(1, 4, "a", 2), (1, 4, "b", 1), (1, 4, "c", 1), (4, 3, "中", 2), (4, 3, "文", 1), (5, 3000, "x", 3000)]
    assert [f.simpleString() for f in post.schema.fields] == ["doc_id:bigint", "dl:int", "term:string", "tf:bigint"]


def test_chunks_are_numbered_in_ranges(spark):
    from pyspark.sql import Window

    from folio.plans.knowledge import numbered

    rows = spark.createDataFrame([(f"s{i % 3}" if i % 7 else None, (i * 37) % 500) for i in range(400)] + [("s1", None), ("s2", 10_000)], "source string, doc_id long")
    usual = rows.withColumn("chunk_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1)
    found = numbered(rows, "source", "doc_id")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, usual.collect()))
    windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number()" in x and "_piece" in x]
    assert windows


def test_compact_copies_vectors(spark, tmp_path):
    from folio.sources.store import Store

    made = Store(spark, str(tmp_path / "store"))
    frame = lambda rows: spark.createDataFrame(rows, "source string, chunk_id int, text string")
    made.add(frame([("a", 0, "x y"), ("b", 0, "z")]))
    made.add(frame([("a", 0, "x w w")]))
    tables = lambda: [sorted(map(repr, made.table(t).collect())) for t in ("chunks", "vectors", "postings")]
    before = tables()

    def broken(texts):
        raise ValueError("no model")

    made.embedder = broken  # compacting asks no model
    made.compact()
    assert tables() == before and len(made.batches()) == 1 and {r.source for r in made.registry().collect()} == {"a", "b"}


def test_head_distances(spark):
    import random

    from folio.functions.text import levenshtein_similarity
    from folio.operators.distances import head_distances

    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("ab c") for _ in range(n))
    heads = [(i, word(n)) for i, n in enumerate([1, 5, 63, 64, 65, 127, 128, 129, 200, 331])] + [(50, ""), (51, None)]
    near = [(100 + i, "".join(c for c in h if rnd.random() > 0.1) + "zz") for i, h in heads if h]
    texts = [(i, word(rnd.randint(0, 400))) for i in range(60)] + near + [(500, None), (501, ""), (502, heads[9][1])]
    docs, asked = spark.createDataFrame(texts, "doc_id long, plain string"), spark.createDataFrame(heads, "item_id long, head string")
    found = head_distances(docs, asked)
    usual = docs.crossJoin(asked).select("doc_id", "item_id", levenshtein_similarity(F.col("head"), F.col("plain")).alias("s"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(found.select("doc_id", "item_id", (F.lit(1.0) - F.col("d") / F.nullif("n", F.lit(0))).alias("s"))) == rows(usual)
    assert "levenshtein" not in found._jdf.queryExecution().executedPlan().toString()


def test_facts_of_a_line_change_no_match(spark):
    from folio.functions.text import fuzzy_match, line_facts

    lines = ["1.2 A b", "1.2  Ab c", "1.2.3 x", "Introductoin x", "总规，则", "a", "", None, "A 类 房屋抗震鉴定 x", "foo bar" * 30, "foo\nbar. baz"]
    heads = ["1.2 A b", "Introduction", "总则", "", "A类房屋抗震鉴定", "foo bar" * 29, "foo bar"]
    docs, asked = spark.createDataFrame(list(enumerate(lines)), "i int, line string"), spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "j int, head string")
    facts = docs.select("i", "line", line_facts(F.col("line"), max(map(len, heads))).alias("facts")).crossJoin(asked)
    bare = F.regexp_replace("head", r"(?U)\s", "")
    both = facts.select("i", "j", fuzzy_match(F.col("head"), F.col("line")).alias("a"), fuzzy_match(F.col("head"), F.col("facts.start"), facts=F.col("facts"), bare=bare).alias("b")).collect()
    assert all(r.a == r.b for r in both) and sum(r.a.matched for r in both) >= 6


def test_many_queries_find_their_best_texts_by_blocks(spark, monkeypatch):
    import random

    from folio.operators import retrieval as R

    rnd = random.Random(5)
    text = lambda n: " ".join(f"w{int(rnd.paretovariate(0.4)) % 3000}" for _ in range(n))
    same = text(30)
    docs = spark.createDataFrame([(i, text(rnd.randint(0, 60))) for i in range(1500)] + [(2000 + i, same) for i in range(30)] + [(3000, None)], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(i, text(12)) for i in range(60)] + [(70, same), (71, "nothing"), (72, "w1 w1 w1")], "query_id int, query string")
    rows = lambda: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in R.bm25_top(docs, asked).collect())
    usual = rows()
    monkeypatch.setattr(R, "HITS", 0)
    assert rows() == usual and len(usual) > 600


def test_only_documents_with_objects_go_through_windows(spark, monkeypatch):
    from folio.operators import structural as S

    seen = []
    usual = S.bind_objects
    monkeypatch.setattr(S, "bind_objects", lambda rows: seen.extend(r.doc_id.doc_id for r in rows.select("doc_id").distinct().collect()) or usual(rows))
    texts = [(1, "plain\n12\n## \nmore text\nand on"), (2, "# A\ntext\n## B\nmore"), (3, "x\n表 1 t\n<table><tr><td>1</td></tr></table>\ny"), (4, "# A\n![](images/a.jpg)\n图 1 z"), (5, None), (6, ""), (7, "a costs $$ 3")]
    got = S.structural(spark.createDataFrame(texts, "doc_id long, text string"), 500).orderBy("doc_id", "chunk_id").collect()
    assert sorted(seen) == [3, 4, 7]
    rows = [(r.doc_id, r.type, r.text) for r in got]
    assert (1, "text", "plain") in rows and (1, "text", "more text\n\nand on") in rows and (7, "text", "a costs $$ 3") in rows
    assert {(r.doc_id, r.type) for r in got} == {(1, "text"), (2, "chunk"), (3, "text"), (3, "table"), (4, "chunk"), (4, "figure"), (7, "text")}
