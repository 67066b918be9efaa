"""Outlines: parts of a document, its headings, and their hierarchy.

Parts, headings and features are column expressions; only the depth of a heading depends on all before it, so that is a
fold over one document's headings, which never hold its text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.headings import features, let, starts_level
from folio.functions.text import outline_entry, strip
from folio.session import materialize, sent, ship

# What ends the front matter, the table of contents and the second table of contents. The last is the first
# heading sign whose line neither holds a leader nor ends in a page number.
FRONT_END = r"#+[ 　]目\s*(?:次|录)"
TOC_END = r"(?i)#+\s*(?:CONTENTS|TABLE\s*OF\s*CONTENTS)"
BODY_START = r"#+[ \t]*(?!.*(?:\.{3,}|……))(?:[^ \t\n0-9]+|[^ \t\n]+.*[^ \t\n0-9]+)(?:[ \t]+(?!\d+(?:[ \t]*$))[^ \t\n]+)?[ \t]*\n"
TOP = ("plain", "appendix", "annex")
PARENT = "array<struct<title: string, en: string>>"


def _cut(c: Column, pattern: str) -> Column:
    """struct<before, hit, after> of the first match; all null where there is none."""
    found = F.struct(F.regexp_instr(c, F.lit(pattern)).alias("at"), F.regexp_substr(c, F.lit(pattern)).alias("hit"))
    return let(found, lambda x: F.struct(F.when(x["at"] > 0, F.substring(c, F.lit(1), x["at"] - 1)).alias("before"), x["hit"].alias("hit"), F.when(x["at"] > 0, F.substring(c, x["at"] + F.length(x["hit"]), F.length(c))).alias("after")))


def partition(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with front, toc, toc_en and body. A part that is missing lends its place to the next one that is there; without
    any table of contents all text is body, but for what comes before its first heading."""
    kept = list(docs.columns)
    c = F.col(text)
    rows = docs.withColumn("_front", _cut(c, FRONT_END))
    rows = rows.withColumn("_toc", _cut(F.coalesce("_front.after", c), TOC_END))
    rows = rows.withColumn("_rest", F.coalesce("_toc.after", "_front.after", c))
    rows = rows.withColumn("_en", _cut(F.col("_rest"), BODY_START)).withColumn("_head", _cut(c, r"(?m)^#+ +.*$"))
    has = lambda name: F.coalesce(F.col(f"{name}.before"), F.lit("")) != ""
    # only one table of contents: it is the first one, whatever its heading was
    first = F.when(has("_toc"), F.col("_toc.before")).when(has("_front") & has("_en"), F.col("_en.before"))
    rows = rows.withColumn("_first", first).withColumn("_second", F.when(has("_toc") & has("_en"), F.col("_en.before")))
    known = F.col("_first").isNotNull()
    body = F.when(known, F.coalesce(F.concat("_en.hit", "_en.after"), "_rest")).otherwise(F.coalesce(F.concat("_head.hit", "_head.after"), c))
    front = F.coalesce(F.when(known, F.col("_front.before")).otherwise(F.col("_head.before")), F.lit(""))
    return rows.select(*kept, front.alias("front"), F.coalesce("_first", F.lit("")).alias("toc"), F.coalesce("_second", F.lit("")).alias("toc_en"), body.alias("body"))


def _entries(part: Column) -> Column:
    """The lines of a part with their places, without the empty ones and the rest of its first line."""
    return F.filter(F.transform(F.split(part, r"\R"), lambda x, i: F.struct(i.alias("pos"), strip(x).alias("text"))), lambda x: (x["text"] != "") & (x["pos"] > 0))


def toc_titles(parts: DataFrame) -> DataFrame:
    """(doc_id, pos, title) of the first table of contents."""
    rows = parts.select("doc_id", F.explode(_entries(F.col("toc"))).alias("x"))
    return rows.select("doc_id", F.col("x.pos").alias("pos"), outline_entry(F.col("x.text")).alias("title")).where("title is not null")


def unwrap_titles(parts: DataFrame, column: str = "toc_en") -> DataFrame:
    """(doc_id, pos, title) of a table of contents whose titles may go over several lines: a title ends with its page number.
    A title that equals the one before is left out."""
    page = r"(?U)\s\d+$"
    by = Window.partitionBy("doc_id").orderBy("pos")
    rows = parts.select("doc_id", F.explode(_entries(F.col(column))).alias("x")).select("doc_id", "x.pos", "x.text")
    entry = F.coalesce(F.sum(F.col("text").rlike(page).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    titles = rows.withColumn("entry", entry).groupBy("doc_id", "entry").agg(F.min("pos").alias("pos"), joined.alias("title"))
    titles = titles.withColumn("title", strip(F.regexp_replace(F.regexp_replace("title", page, ""), "^# +", "")))
    return titles.withColumn("before", F.lag("title").over(by)).where("before is null or title <> before").select("doc_id", "pos", "title")


def body_titles(parts: DataFrame) -> DataFrame:
    """(doc_id, pos, title) of the lines of the body with a heading sign, for documents without a table of contents."""
    rows = parts.where("toc = ''").select("doc_id", F.posexplode(F.split("body", r"\R")).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    return rows.where(F.col("line").rlike("^#+")).select("doc_id", "pos", strip(F.regexp_replace("line", "^#+ *", "")).alias("title")).where("title <> ''")


def zip_titles(titles: DataFrame, en: DataFrame) -> DataFrame:
    """titles with `en`, the title at the same place of the second table, where both have as many; else empty."""
    by, whole = Window.partitionBy("doc_id").orderBy("pos"), Window.partitionBy("doc_id")
    a = titles.withColumn("nth", F.row_number().over(by)).withColumn("n", F.count(F.lit(1)).over(whole))
    b = en.select("doc_id", F.row_number().over(by).alias("nth"), F.count(F.lit(1)).over(whole).alias("n"), F.col("title").alias("en"))
    return a.join(b, ["doc_id", "nth", "n"], "left").select("doc_id", "pos", "title", F.coalesce("en", F.lit("")).alias("en"))


def titles(parts: DataFrame) -> DataFrame:
    """(doc_id, pos, title, en): from the tables of contents, or else from the body."""
    return zip_titles(toc_titles(parts), unwrap_titles(parts)).unionByName(body_titles(parts).withColumn("en", F.lit("")))


@dataclass
class Heading:
    """A heading with its place in the hierarchy; parents are (title, en), None for a level that was skipped."""

    title: str
    en: str
    style: tuple[str, int]
    first: bool
    inner: tuple[str, int] | None = None
    depth: int = 0
    parents: list = field(default_factory=list)

    @property
    def path(self) -> list:
        return [*self.parents, (self.title, self.en)]


def level_of(tree: list[list], style: tuple[str, int], low: int = 0, high: int | None = None) -> int | None:
    """The first level from low (up to high) that has the style."""
    return next((k for k in range(low, len(tree) if high is None else min(high, len(tree))) if style in tree[k]), None)


def learn(tree: list[list], level: int, style: tuple[str, int]) -> None:
    while len(tree) <= level:
        tree.append([])
    tree[level].append(style)


def infer(headings: list[Heading]) -> list[list]:
    """Fills in depth and parents, and returns the tree: the styles of each level.

    A heading goes beside one of its own style, above or below one of its kind with other dots; another style goes
    where the tree has it below, below the heading before if it is the first of its numbering, and else to the level above that
    has it. A style that later moves deeper takes earlier headings along, and the levels between are gaps."""
    tree: list[list] = []
    before: Heading | None = None
    for h in headings:
        kind, dots = h.style
        if before is None:
            learn(tree, 0, h.style)
        elif kind in TOP:
            if h.style not in tree[0]:
                learn(tree, 0, h.style)
        elif kind == before.style[0]:
            level = before.depth + dots - before.style[1]
            if dots == before.style[1]:
                h.depth, h.parents = before.depth, list(before.parents)
            elif dots < before.style[1]:
                level = max(level, 0)
                known = level_of(tree, h.style, 0, level + 1)
                if known is None:
                    learn(tree, level, h.style)
                h.depth = level if known is None else known
                h.parents = before.parents[: h.depth]
            else:
                if level_of(tree, h.style, level) is None:
                    learn(tree, level, h.style)
                h.depth, h.parents = level, before.path
        elif (deeper := level_of(tree, h.style, before.depth + 1)) is not None:
            h.depth, h.parents = deeper, before.path
        elif h.first:
            if h.style in tree[before.depth]:
                tree[before.depth].remove(h.style)
            learn(tree, before.depth + 1, h.style)
            h.depth, h.parents = before.depth + 1, before.path
        else:
            above = level_of(tree, h.style, 0, before.depth + 1)
            h.depth = before.depth if above is None else above
            h.parents = before.parents[: h.depth]
        before = h
    styles = {h.title: h.inner or h.style for h in headings}
    for h in headings:
        now = level_of(tree, h.style, h.depth)
        if now is None or now == h.depth:
            continue
        above, padded = list(h.parents), []
        for level in range(now):
            fits = above and (above[0] is None or styles.get(above[0][0]) in tree[level] or len(above) >= now - level)
            padded.append(above.pop(0) if fits else None)
        h.depth, h.parents = now, padded
    return tree


def headings_of(rows: pd.DataFrame) -> list[Heading]:
    """Headings of one document from rows with title, en, type, dot_count, first, in order."""
    return [Heading(t, e, (k, int(d)), bool(f), ("content", 0) if k == "plain" else None) for t, e, k, d, f in zip(rows["title"], rows["en"], rows["type"], rows["dot_count"], rows["first"], strict=True)]


def featured(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Titles with type, prefix, dot_count and first."""
    out = rows.withColumn("f", features(F.col("title"), outline=True, strict=strict))
    return out.select(*rows.columns, F.col("f.type").alias("type"), F.col("f.prefix").alias("prefix"), F.col("f.dot_count").alias("dot_count"), F.coalesce(starts_level(F.col("f")), F.lit(False)).alias("first"))


def hierarchy(rows: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, pos, title, en, depth, parents) of headings (doc_id, pos, title, en); parents go from the root, null for a gap."""
    ship(rows.sparkSession)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        found = headings_of(frame)
        infer(found)
        parents = [[None if p is None else {"title": p[0], "en": p[1]} for p in h.parents] for h in found]
        return pd.DataFrame({"doc_id": frame["doc_id"], "pos": frame["pos"], "title": frame["title"], "en": frame["en"], "depth": [h.depth for h in found], "parents": parents})

    return featured(rows, strict).groupBy("doc_id").applyInPandas(fold, f"doc_id long, pos int, title string, en string, depth int, parents {PARENT}")


def is_ancestor(path: Column, title: Column) -> Column:
    """Does a path of parents (gaps aside) have the title?"""
    return F.coalesce(F.exists(F.filter(path, lambda x: x.isNotNull()), lambda x: x["title"] == title), F.lit(False))


def split_annexes(parts: DataFrame, outline: DataFrame) -> DataFrame:
    """(doc_id, part, header, body): the body before the annexes that end the outline, part 0, and the annexes. An annex starts where its title
    (without `附：`) first occurs in what is left of the body; one that does not occur is left out."""
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    last = outline.withColumn("ends", F.min(F.col("title").rlike("^(附|付|符)：")).over(by)).where("ends")
    heads = last.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("heads"))
    joined = parts.join(sent(materialize(heads, "heads")), "doc_id", "left")
    start = F.struct(F.col("body").alias("rest"), F.array().cast("array<struct<header: string, body: string>>").alias("found"))

    def step(acc: Column, head: Column) -> Column:
        at = F.instr(acc["rest"], F.substring(head["title"], F.lit(3), F.length(head["title"])))
        piece = F.struct(head["title"].alias("header"), F.substring(acc["rest"], at, F.length(acc["rest"])).alias("body"))
        return F.when(at > 0, F.struct(F.substring(acc["rest"], F.lit(1), at - 1).alias("rest"), F.concat(F.array(piece), acc["found"]).alias("found"))).otherwise(acc)

    cut = F.aggregate(F.reverse(F.coalesce("heads", F.array().cast("array<struct<pos: int, title: string>>"))), start, step)
    rows = joined.select("doc_id", cut.alias("x"))
    pieces = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("header"), F.col("x.rest").alias("body"))), F.col("x.found"))
    return rows.select("doc_id", F.posexplode(pieces).alias("part", "p")).select("doc_id", "part", "p.header", "p.body")


def flatten_tree(tree: list[list]) -> Iterator[tuple[str, int]]:
    """All styles of a tree."""
    return (style for level in tree for style in level)
