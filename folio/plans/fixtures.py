"""Queries of structural operators over inline rows; their oracles are the rows that must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import attach as A
from folio.operators import chunking, control
from folio.operators import lines as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(spark)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, pos int, text string")


@query("SELECT * FROM (VALUES (0, true, 17), (1, true, 18), (2, false, -1), (3, false, -1), (4, true, 7), (5, true, 12), (6, false, -1)) AS t(n, matched, \"end\")")
def fuzzy_heading_match(spark):
    rows = [("9.2 A类单层砖柱厂房抗震鉴定", "9.2 A 类单层砖柱厂房抗震鉴定"), ("6.2 A 类钢筋混凝土房屋抗震鉴定", "6.2 A 类钢筋混凝土房屋抗震鉴定：定"), ("6.2 A", "6.2.1 x"), ("总则", "总规，则"), ("6.2 foo", "6.2 bar baz"), ("Introduction", "Introductoin x"), ("Introduction", "Conclusion is")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, outline string, line string")
    return df.select("n", X.fuzzy_match(F.col("outline"), F.col("line")).alias("m")).select("n", "m.matched", "m.end")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 'images/abc.jpg', '图 1 示意', '![](images/abc.jpg)' || chr(10) || '图 1 示意'), (1, 3, 'images/x.jpg', NULL, '![](images/x.jpg)')) AS t(doc_id, pos, link, name, text)")
def figure_caption_bind(spark):
    return L.figures(lines(spark, "![](images/abc.jpg)", "图 1 示意", "正文", "![](images/x.jpg)", "正文"))


@query("SELECT CAST(1 AS BIGINT) AS doc_id, 1 AS block, '公式如下：' AS name, '公式如下：' || chr(10) || chr(10) || '$$' || chr(10) || 'a=b' || chr(10) || '$$' || chr(10) || chr(10) || '式中 x —— 变量' AS text")
def equation_blocks(spark):
    return L.equations(lines(spark, "公式如下：", "$$", "a=b", "$$", "式中 x —— 变量", "正文"))


@query("SELECT CAST(1 AS BIGINT) AS doc_id, 2 AS pos, '表 1 参数' AS name UNION ALL SELECT 1, 8, NULL")
def table_title_asof(spark):
    return L.table_titles(lines(spark, "表 1 参数", "单位 mm", "<table><tr></tr></table>", "正文", "a", "b", "c", "d", "<table></table>"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 1), (1, 1, 2)) AS t(doc_id, pos, code)")
def note_runs(spark):
    return L.note_runs(spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 4)], "doc_id long, pos int, code int"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 3, '乙'), (1, 4, '丙')) AS t(doc_id, pos, text)")
def trailing_annex(spark):
    return L.trailing_annexes(lines(spark, "1 X", "附：甲", "2 Y", "附：乙", "附：丙"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0 AS BIGINT), 'A longtitle'), (1, 1, 'B')) AS t(doc_id, entry, text)")
def outline_unwrap(spark):
    return L.unwrap(lines(spark, "A long", "title 3", "B 4"), F.col("text").rlike(r"\d+$"))


@query("SELECT * FROM (VALUES (0, '1.1 Foo'), (1, '总则'), (2, 'Scope'), (3, NULL)) AS t(n, entry)")
def outline_clean(spark):
    df = spark.createDataFrame(list(enumerate(["1.1 Foo", "总则……3", "# Scope 12", "x"])), "n int, line string")
    return df.select("n", X.outline_entry(F.col("line")).alias("entry"))


@query("SELECT '1. 总则（General）：1.1 目的：' AS text")
def breadcrumb(spark):
    df = spark.createDataFrame([([("1. 总则", "General"), None, ("1.1 目的：", "")],)], "path array<struct<title: string, en: string>>")
    return df.select(X.breadcrumb(F.col("path")).alias("text"))


_ATTACH = [("1.0.1~1.0.2 说明A", "1.0.3、1.0.4 说明B", "9.9.9 说明C"), ("1.0.2~7.7.7 说明D",), ("1.0.3 说明E",)]


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 0, 0), (0, 0, 1), (0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 0, 1), (2, 0, 2)) AS t(doc_id, pos, target)")
def range_attach(spark):
    notes = spark.createDataFrame([(d, i, t) for d, ts in enumerate(_ATTACH) for i, t in enumerate(ts)], "doc_id long, pos int, text string")
    base = spark.createDataFrame([(d, i, t) for d in range(3) for i, t in enumerate(["1.0.1 x", "1.0.2 y", "1.0.3 z", "1.0.4 w"])], "doc_id long, pos int, text string")
    return A.attach(notes, base)


@query("SELECT * FROM (VALUES (0, 'aaaa' || chr(10) || chr(10) || 'bbb'), (1, 'cccccccc' || chr(10) || chr(10) || 'd'), (2, 'e')) AS t(pos, text)")
def pack_simple(spark):
    df = spark.createDataFrame([(["aaaa", "bbb", "cccccccc", "d", "e"],)], "pieces array<string>")
    return df.select(F.posexplode(chunking.fold_packs(F.col("pieces"), 10)).alias("pos", "text"))


@query("SELECT * FROM (VALUES (0, NULL, 'default', 200, 'cn'), (1, NULL, 'default', 200, 'cn'), (2, 'unreadable', NULL, NULL, NULL), (3, 'missing key', 'default', NULL, NULL)) AS t(n, error, strategy, size, language)")
def json_plan_parse(spark):
    plan = '{"切片方式": ["default"], "切片大小": [200], "使用语言": ["cn"]}'
    df = spark.createDataFrame(list(enumerate([plan, plan.replace('"', "'"), "bad", '{"切片方式": ["default"]}'])), "n int, reply string")
    p = df.select("n", control.parse_plan(F.col("reply")).alias("p"))
    return p.select("n", "p.error", F.get("p.strategies", F.lit(0)).alias("strategy"), F.get("p.sizes", F.lit(0)).alias("size"), F.get("p.languages", F.lit(0)).alias("language"))


@query("SELECT * FROM (VALUES (0, 'hyde', 300, 'en'), (1, 'default', 200, 'cn')) AS t(pos, strategy, size, language)")
def plan_zip(spark):
    docs = spark.createDataFrame([(0,), (1,), (2,)], "pos int")
    plan = spark.createDataFrame([(["HyDE", "xyz"], [300, 200], ["en"])], "strategies array<string>, sizes array<int>, languages array<string>")
    return control.zip_plan(docs, plan)


@query("SELECT 'aa' AS text, 0 AS pos, CAST(1 AS BIGINT) AS doc_id UNION ALL SELECT 'bbbbbbbbbbbb', 1, 1 UNION ALL SELECT 'c' || chr(10) || chr(10) || 'd', 2, 1")
def chunk_fixed(spark):
    return chunking.fixed(spark.createDataFrame([(1, "aa\n\nbbbbbbbbbbbb\n\nc\n\nd")], "doc_id long, text string"), 10)
