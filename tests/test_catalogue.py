"""Each query of the library against its DuckDB equivalent, over the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pytest

from folio import catalogue

DATA = "/root/testdata/sf0.001"


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: round(x, 5) if isinstance(x, float) else x
    return sorted(tuple(repr(value(r[i])) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    found = [tuple(r) for r in df.collect()]
    if name not in catalogue.ORACLES:
        assert found
        return
    run = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, found) == rows(names, run.fetchall())


def test_recursive_chunks_give_the_text_back(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got: dict = {}
    for r in catalogue.QUERIES["chunk_recursive"](spark, DATA).collect():
        assert len(r.text) <= 500
        got.setdefault(r.doc_id, []).append((r.pos, r.text))
    assert {k: "".join(t for _, t in sorted(v)) for k, v in got.items()} == texts


def test_bm25_scores(spark):
    from folio.operators.retrieval import bm25_top

    docs = spark.createDataFrame([(1, "a b a c"), (2, "b c"), (3, "c d"), (4, "c c e"), (5, "f")], "doc_id long, text string")
    query = spark.createDataFrame([("a c",)], "query string")
    assert [(r.doc_id, r.score) for r in bm25_top(docs, query).orderBy("rank").collect()] == [(1, 1.408905), (4, 0.200127), (2, 0.163618), (3, 0.163618)]


def test_each_row_of_a_query_table_is_answered_by_itself(spark):
    from folio.operators import retrieval as R

    docs = spark.createDataFrame([(1, "a b a c"), (2, "b c"), (3, "c d"), (4, "c c e"), (5, "f")], "doc_id long, text string")
    asked = [(7, "a c"), (8, "f e"), (9, "d")]
    batch = spark.createDataFrame(asked, "query_id long, query string")
    sorted_rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    single = [row for i, text in asked for row in sorted_rows(R.bm25_top(docs, spark.createDataFrame([(i, text)], batch.schema)))]
    assert sorted_rows(R.bm25_top(docs, batch)) == single and {row[0] for row in single} == {7, 8, 9}
    arms = R.hybrid({"x": docs.crossJoin(batch.select("query_id")).select("query_id", "doc_id")})
    best = {r.query_id: r.doc_id for r in R.rerank(arms, docs, batch, k=1).collect()}
    assert best == {7: 1, 8: 5, 9: 3}

    vectors = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(6)], "vec_id long, label int, embedding array<double>")
    points = spark.createDataFrame([(1, [0.2, 1.0]), (2, [4.9, 1.0])], "query_id long, q array<double>")
    near = R.knn(vectors, points, k=2)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in near.collect()) == [(1, 1, 0), (1, 2, 1), (2, 1, 5), (2, 2, 4)]
    assert sorted((r.query_id, r.label, r.vec_id) for r in R.knn_by(vectors, points, "label", k=1).collect()) == [(1, 0, 0), (1, 1, 1), (2, 0, 4), (2, 1, 5)]
    assert R.evaluate(near.join(vectors, "vec_id"), points).count() == 2
    assert R.knn(vectors, points.drop("query_id"), k=2).count() == 4


def _pack(pieces, size):
    out, now = [], None
    for p in pieces:
        if now is None:
            now = p
        elif len(now) < size and len(p) < 0.8 * size and (len(now) <= 0.8 * size or "\n\n" in now):
            now += "\n\n" + p
        else:
            out, now = [*out, now], p
    return out + ([] if now is None else [now])


def _fixed(pieces, size):
    out, now = [], None
    for p in pieces:
        if now is not None and len(now) + 2 + len(p) <= size:
            now += "\n\n" + p
        else:
            out, now = out + ([] if now is None else [now]), p
    return out + ([] if now is None else [now])


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Documents of the smallest table, and long texts, nulls, empty texts and many pieces, as a folder of tables."""
    folder = tmp_path_factory.mktemp("tables")
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    odd = [None, "", "\n\n\n", "x" * 5000, "\n\n".join("ab" * (i % 90) for i in range(900)), "\n".join("y" * (i * 37 % 620) for i in range(400)), "Ü\n\nß"]
    rows = real + [(1000 + i, t) for i, t in enumerate(odd)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    heads = [(i, (t or "").split("\n")[0][: 20 + i]) for i, t in enumerate(t for _, t in real[:8])] + [(90, "Ü"), (91, "9.1 A x"), (92, "")]
    spark.createDataFrame([(i, h + "\nmore") for i, h in heads], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, heads


@pytest.mark.parametrize("name, separator, fold", [("chunk_fixed_documents", "\n\n", _fixed), ("pack_simple_documents", "\n", _pack)])
def test_documents_are_chunked_whole(spark, texts, name, separator, fold):
    folder, rows, _ = texts
    expected = sorted((i, n, c) for i, t in rows if t for n, c in enumerate(fold([p for p in t.split(separator) if p], 500)))
    found = catalogue.QUERIES[name](spark, folder)
    assert sorted((r.doc_id, r.pos, r.text) for r in found.collect()) == expected


def test_headings_are_matched_with_whole_documents(spark, texts):
    import re

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def match(head, text):
        n = len(head)
        if text.startswith(head):
            return True, n
        bare = re.sub(r"\s", "", head)
        if bare and re.sub(r"\s", "", text[: 2 * n]).startswith(bare):
            return True, next(e for e in range(2 * n + 1) if re.sub(r"\s", "", text[:e]) == bare)
        if re.match(r"\d+\.\d+\.\d+", text):
            return False, -1
        mark = re.search(r"[^\w\s（）()、.\-—]", text)
        if mark and mark[0] in "。！？，,":
            return False, -1
        if "." in head and head.split(" ")[0] == text.split(" ")[0]:
            return True, min(n, len(text))
        if n and 1 - distance(head, text[:n]) / n >= 0.8:
            ends = [e for e in range(max(n - 2, 1), n + 3) if e <= len(text)]
            return True, min((distance(head, text[:e]), abs(e - n), e) for e in ends)[2] if ends else n
        return False, -1

    folder, rows, heads = texts
    found = {(r.doc_id, r.item_id): (r.matched, r.end) for r in catalogue.QUERIES["fuzzy_heading_match_documents"](spark, folder).collect()}
    assert len(found) == len(rows) * len(heads)
    assert {k: found[k] for k in found if dict(rows)[k[0]] is not None} == {(i, j): match(h, t) for i, t in rows if t is not None for j, h in heads}
    assert sum(ok for ok, _ in found.values()) >= 8
    assert all(found[1000, j] == (False, -1) for j, _ in heads)  # a null text matches nothing


def test_upserts_and_heads_take_all_rows(spark):
    rows = lambda name: catalogue.QUERIES[name](spark, DATA)
    docs, heads = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    batch = {r.doc_id for name in ("upsert_existing", "upsert_new") for r in rows(name).collect()}
    ids = {r.doc_id for r in docs.collect()}
    assert batch == {i for i in ids if i % 5 >= 3}
    known = {r.doc_id for r in rows("upsert_existing").collect()}
    assert {r.doc_id for r in rows("upsert_append").collect()} == ids - known  # rows of known sources are skipped
    assert batch <= {r.doc_id for r in rows("upsert_replace").collect()}
    assert rows("levenshtein_heads").count() == docs.count() * heads.count()
