"""Headings, outlines, sections and packing against plain Python and given rows."""

import random

import pytest
from pyspark.sql import functions as F

from folio.functions.matching import distance, match
from folio.functions.text import fuzzy_match
from folio.operators import outline as O
from folio.operators import structural as S
from folio.plans import structure


def test_the_two_heading_matches_agree(spark):
    r = random.Random(2)
    letters = "ab 1.2。，—()A 　"
    rows = [("".join(r.choice(letters) for _ in range(r.randrange(1, 9))), "".join(r.choice(letters) for _ in range(r.randrange(0, 14))), r.choice([0.6, 0.8])) for _ in range(1500)]
    rows += [(a, a[: len(a) // 2] + " " + a[len(a) // 2 :] + r.choice(["", " x", "：定"]), t) for a, _, t in rows[:300]]
    rows = [x for x in rows if x[0].strip()]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "n int, outline string, line string, threshold double")
    got = {x.n: (x.m.matched, x.m.end) for x in df.select("n", fuzzy_match(F.col("outline"), F.col("line"), F.col("threshold")).alias("m")).collect()}
    wrong = [(rows[i], got[i], match(*rows[i])) for i in range(len(rows)) if got[i] != match(*rows[i])]
    assert not wrong, wrong[:5]
    assert sum(m for m, _ in got.values()) > 200


def test_distance():
    assert distance("kitten", "sitting") == 3 and distance("", "ab") == 2 and distance("中文", "中x文") == 1


def headings(*titles, en=None):
    import re

    out = []
    for t in titles:
        number = re.match(r"\d+(?:\.\d+)*", t)
        kind = "number" if number else "lower_alpha" if re.match(r"[a-z]\. ", t) else "appendix" if t.startswith("附录") else "plain"
        prefix = number.group() if number else t[:2] if kind == "lower_alpha" else ""
        out.append(O.Heading(t, "", (kind, prefix.rstrip(".").count(".")), prefix.rstrip(".").split(".")[-1] in ("1", "a"), ("content", 0) if kind == "plain" else None))
    return out


def test_hierarchy_without_a_style_that_moves_has_no_gaps():
    found = headings(*(t for t in structure._TITLES if t != "2.2.1 数据统计"))
    O.infer(found)
    path = {h.title: (h.depth, [p and p[0] for p in h.parents]) for h in found}
    assert path["1.1.1 研究背景"] == (2, ["1. 第一章", "1.1 引言"]) and path["2.1.1 简介"] == (2, ["2. 第二章", "2.1 实验设计"])


def test_a_heading_after_a_top_one_finds_its_level_again():
    found = headings("前言", "1 a", "1.1 b", "结语", "2 c", "2.1 d")
    O.infer(found)
    assert [h.depth for h in found] == [0, 1, 2, 0, 1, 2]


def line(i, text, kind="content", prefix="", head="", content=None, first=False):
    digits = prefix.rstrip(".").split(".")[-1]
    return S.Line(i, text, (kind, prefix.rstrip(".").count(".")), prefix, head or prefix, text if content is None else content, first, sum(map(ord, prefix)), int(digits) if digits.isdigit() else None)


def number(i, prefix, rest, bare=False):
    text = f"{prefix} {rest}"
    return line(i, text, "number", prefix, prefix, prefix if bare else text, prefix.split(".")[-1] == "1")


def test_sections_follow_the_outline_and_numbers():
    rows = [number(0, "1", "甲"), line(1, "正文"), number(2, "1.0.1", "应当，如此", True), number(3, "1.0.2", "应当，这样", True), number(4, "1.0.40", "不是标题", True), line(5, "(1) x", "number_parentthese", "(1)", "(1)", None, True), number(6, "2", "乙"), number(7, "2.0.1", "丙，丁", True)]
    found = S.place(rows, headings("1 甲", "2 乙"))
    got = [(i, s.title, [p and p[0] for p in s.parents], s.named) for i, s in found]
    assert got == [(0, "1 甲", [], True), (2, "1.0.1", ["1 甲", None], False), (3, "1.0.2", ["1 甲", None], False), (5, "(1) x", ["1 甲", None, "1.0.2"], True), (6, "2 乙", [], True), (7, "2.0.1", ["2 乙", None], False)]  # the number that jumps by 38 is text


def test_structural_chunks_of_markdown(spark):
    rows = {}
    for r in S.structural(structure.markdown(spark), -1).orderBy("doc_id", "chunk_id").collect():
        rows.setdefault(r.doc_id, []).append(r)
    first = rows[1]
    kinds = [r.type for r in first]
    assert kinds == ["text"] + ["chunk"] * kinds.count("chunk") + ["figure", "equation", "table"] and first[0].text == "封面"
    by = {r.outline_titles[0]: r for r in first if r.type == "chunk"}
    assert by["1.0.1"].text.startswith("1 总则（1 General）：1.0.1 为贯彻") and "附：条文说明：" in by["1.0.1"].text and "说明甲" in by["1.0.1"].text
    two = by["1.0.2"]
    assert two.has_table and two.table_names == ["表 1 参数"] and "说明甲" in two.text and two.text[two.addition_start[0] :].startswith("\n\n附：条文说明：")
    assert "<tr><td>1</td></tr><tr><td>2</td></tr></table>" in two.text and "2 乙" in two.text  # the continuation and the notes
    deep = by["2.1.1"]
    assert deep.has_equation and deep.has_figure and deep.figure_links == ["images/abc.jpg"] and deep.figure_names == ["图 1 示意"] and "说明乙" in deep.text
    assert deep.text.startswith("2 抗震鉴定（2 Seismicappraisal）：2.1 一般规定（2.1 General rules）：2.1.1 ")
    table = first[-1]
    assert table.name == "表 1 参数" and table.text.startswith("表 1 参数\n\n<table>") and table.text.endswith("注：1 甲\n2 乙")
    assert [(r.type, r.text) for r in rows[2]] == [("text", "没有标题的正文"), ("text", "第二行")]
    assert [(r.type, r.text) for r in rows[3]] == [("text", "引言"), ("chunk", "甲：\n正文甲"), ("chunk", "乙：\n正文乙")]
    packed = [r for r in S.structural(structure.markdown(spark), 2000).collect() if r.doc_id == 1 and r.type == "chunk"]
    assert len(packed) < len(by) and sum(r.text.count("说明甲。") for r in packed) <= 2


@pytest.mark.parametrize("size", [10, 60, 400])
def test_packing_keeps_every_chunk_and_the_sizes(size):
    r = random.Random(size)
    meta = dict.fromkeys(S.FLAGS, False) | {k: [] for k in S.NAMES}
    chunks = [S.Chunk("x：" + "".join(r.choice("abcdef") for _ in range(r.randrange(1, 80))), [f"t{i}"], [""], [("x", "")], dict(meta, table_names=[f"n{i % 3}"]), []) for i in range(40)]
    out = S.pack(chunks, size)
    assert "".join(c.text.replace("\n\n", "").replace("x：", "") for c in out) == "".join(c.text.replace("x：", "") for c in chunks)
    assert [t for c in out for t in c.titles] == [f"t{i}" for i in range(40)]
    for a, b in zip(out[:-1], out[1:], strict=True):  # no two neighbours that had to join
        alone = len(a.titles) == 1 and len(a.text) > 0.8 * size
        first = next(c for c in chunks if c.titles[0] == b.titles[0])
        assert alone or not ((len(a.text) < size and len(first.text) < 0.8 * size) or len(a.text) < 0.4 * size)
    assert all(len(set(c.meta["table_names"])) == len(c.meta["table_names"]) for c in out)


def test_a_note_that_goes_on_is_kept_once():
    meta = dict.fromkeys(S.FLAGS, False) | {k: [] for k in S.NAMES}
    a = S.Chunk("x：a\n\n附：n", ["a"], [""], [("x", "")], meta, ["\n\n附：n"])
    b = S.Chunk("x：b\n\n附：n", ["b"], [""], [("x", "")], meta, ["\n\n附：n"])
    assert [c.text for c in S.pack([a, b], 100)] == ["x：a\n\nb\n\n附：n"]


def test_fold_packs_leaves_a_long_first_piece_alone(spark):
    from folio.operators.chunking import fold_packs

    df = spark.createDataFrame([(["aaaa\n\nbbb", "c", "d", "e"],)], "p array<string>")
    assert df.select(fold_packs(F.col("p"), 10)).head()[0] == ["aaaa\n\nbbb", "c\n\nd\n\ne"]


def test_semantic_chunks_keep_every_sentence(spark):
    from folio.functions.models import HashingEmbedder
    from folio.operators.chunking import split_semantic

    text = ". ".join(["the cat sat on the mat"] * 30 + ["stocks fell on heavy trading"] * 30)
    out = split_semantic(text, 200, "en", HashingEmbedder())
    assert len(out) > 1 and " ".join(out).split() == text.replace(".", "").split() and all(len(x) >= 50 for x in out[:-1])
    assert split_semantic("one", 200, "en", HashingEmbedder()) == ["one"] and split_semantic("...", 200, "en", HashingEmbedder()) == []


def test_recursive_overlap_repeats_the_end(spark):
    from folio.operators.chunking import SEPARATORS, split_recursive

    out = split_recursive(" ".join(f"w{i}" for i in range(50)), 20, SEPARATORS["en"], 8)
    assert all(len(x) <= 20 for x in out)
    for a, b in zip(out[:-1], out[1:], strict=True):
        assert any(a.endswith(b[:n]) and 0 < n <= 8 for n in range(1, 9))


def test_replies_are_stripped_and_apostrophes_can_be_read(spark):
    from folio.operators import control

    df = spark.createDataFrame([("save\n",), ("\tRetrieve",), ("x",)], "reply string")
    assert [r[0] for r in df.select(control.route(F.col("reply"))).collect()] == ["save", "retrieve", "unknown"]
    plan = spark.createDataFrame([('{"切片方式": ["it\'s"], "切片大小": [1]}',)], "reply string").select(control.parse_plan(F.col("reply")).alias("p")).head().p
    assert plan.error is None and plan.strategies == ["it's"]


def test_attach_goes_on_from_the_last_place(spark):
    from folio.operators import attach as A

    base = ["1.0.1 x", "1.0.2 y", "1.0.1 again", "1.0.2 again"]
    heads = list(enumerate(["1.0.2 a", "1.0.1 b", "1.0.2 c", "9 d"]))
    assert list(A.by_number(heads, list(enumerate(base)))) == [(0, 1), (1, 2), (2, 3), (3, 3)]
