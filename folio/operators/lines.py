"""Ordered-row operators on lines (doc_id, pos, text): windows within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from folio.functions.text import clean_line, figure_link, is_figure_caption, is_page_number, is_table_title


def by_pos() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("pos")


def so_far() -> WindowSpec:
    return by_pos().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def split_lines(docs: DataFrame) -> DataFrame:
    """The lines of each text that are not empty."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where("text <> ''")


def clean_lines(lines: DataFrame) -> DataFrame:
    """Without page numbers, heading signs and lines that are empty then."""
    return lines.where(~is_page_number(F.col("text"))).withColumn("text", clean_line(F.col("text"))).where("text <> ''")


def number(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk_id", F.row_number().over(by_pos()) - 1)


def sections(lines: DataFrame, is_heading: Column) -> DataFrame:
    """Lines with the number of the heading they belong to (0: before the first)."""
    return lines.withColumn("section", F.sum(F.when(is_heading, 1).otherwise(0)).over(so_far()))


def section_texts(lines: DataFrame, is_heading: Column) -> DataFrame:
    """(doc_id, section, n_lines, text) with the lines of a section joined."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    return sections(lines, is_heading).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), parts.alias("text"))


def dedupe_adjacent(lines: DataFrame) -> DataFrame:
    """Without lines that equal the one before."""
    return lines.withColumn("before", F.lag("text").over(by_pos())).where("before is null or text <> before").drop("before")


def unwrap(lines: DataFrame, ends: Column) -> DataFrame:
    """Lines joined, without a separator, up to the next line that ends an entry; entries lose their page numbers."""
    marked = lines.withColumn("ends", ends.cast("int"))
    entry = F.coalesce(F.sum("ends").over(by_pos().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.regexp_replace(x["text"], r"\s+\d+$", "")), "")
    return marked.withColumn("entry", entry).groupBy("doc_id", "entry").agg(joined.alias("text"))


def figures(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, link, name, text): image lines bound to the caption that follows, which is consumed."""
    after = F.lead("text").over(by_pos())
    rows = lines.withColumn("name", F.when(is_figure_caption(after), after)).withColumn("link", figure_link(F.col("text"))).where("link <> ''")
    return rows.select("doc_id", "pos", "link", "name", F.concat_ws("\n", "text", "name").alias("text"))


def fences(lines: DataFrame, mark: str = "$$") -> DataFrame:
    """Lines with the number of the fenced block they are in, fences included; null outside."""
    is_mark = F.trim("text") == mark
    seen = F.sum(is_mark.cast("int")).over(so_far())
    return lines.withColumn("block", F.when(is_mark | (seen % 2 == 1), F.ceil(seen / 2).cast("int")))


def equations(lines: DataFrame, mark: str = "$$") -> DataFrame:
    """(doc_id, block, name, text): fenced blocks with the line before that ends in a colon, and the explanations that follow."""
    marked = fences(lines, mark).withColumn("name", F.lag("text").over(by_pos())).withColumn("shut", F.last(F.col("block"), True).over(so_far()))
    tail = F.col("block").isNull() & F.col("shut").isNotNull() & F.col("text").rlike(r"——|^[注主]：")
    other = F.sum(F.when(F.col("block").isNull() & ~F.coalesce(tail, F.lit(False)), 1).otherwise(0)).over(so_far())
    grouped = marked.withColumn("other", other).withColumn("tail", tail)
    first = F.min(F.when(F.col("block").isNotNull(), F.col("other"))).over(Window.partitionBy("doc_id", "shut"))
    kept = grouped.withColumn("first", first).where("block is not null or (tail and other = first)")
    body = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    named = F.min_by(F.when(F.col("block").isNotNull() & F.col("name").rlike("[:：]$"), F.col("name")), "pos")
    out = kept.groupBy("doc_id", F.col("shut").alias("block")).agg(named.alias("name"), body(F.col("block").isNotNull()).alias("body"), body(F.col("block").isNull()).alias("more"))
    return out.select("doc_id", "block", "name", F.concat_ws("\n\n", "name", "body", F.nullif("more", F.lit(""))).alias("text"))


def table_titles(lines: DataFrame, lookback: int = 4) -> DataFrame:
    """(doc_id, pos, name): the nearest title at most `lookback` lines before each table."""
    near = by_pos().rowsBetween(-lookback, -1)
    name = F.last(F.when(is_table_title(F.col("text")), F.col("text")), True).over(near)
    return lines.withColumn("name", name).where(F.col("text").startswith("<table")).select("doc_id", "pos", "name")


def note_runs(notes: DataFrame) -> DataFrame:
    """Numbered notes (doc_id, pos, code) that follow on without a gap from the first."""
    island = F.col("code") - F.row_number().over(by_pos())
    marked = notes.withColumn("island", island)
    first = F.first("island").over(by_pos())
    return marked.withColumn("first", first).where("island = first").select("doc_id", "pos", "code")


def trailing_annexes(titles: DataFrame) -> DataFrame:
    """The annex titles (`附：…`) after which no other title comes."""
    rest = by_pos().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    is_annex = F.col("text").rlike("^附：")
    return titles.withColumn("all", F.min(is_annex).over(rest)).where("all").select("doc_id", "pos", F.regexp_replace("text", "^附：", "").alias("text"))
