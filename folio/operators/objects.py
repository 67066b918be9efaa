"""Figures, equations and tables of a document: lines bound to the object they belong to, and the objects as chunks.

Every operator marks lines (doc_id, pos, text) by windows within a document; a line that an object takes in keeps its place in the
document through the object, whose place is that of its first line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.headings import features, ordinal, starts_level
from folio.functions.text import figure_link, is_figure_caption, is_table_title, strip
from folio.operators.lines import by_pos, so_far

NOTE = r"(?i)^(?:[注主][:：]|Notes[:：])"
ROW = "array<struct<markup: string, cells: array<string>>>"


def table_rows(html: Column) -> Column:
    """array<struct<markup, cells>>: the rows of an HTML table and the texts of their cells."""
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), lambda x: strip(F.regexp_replace(x, "<[^>]*>", "")))
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>.*?</tr\s*>"), F.lit(0)), lambda r: F.struct(r.alias("markup"), cells(r).alias("cells")))


def merge_tables(first: Column, second: Column) -> Column:
    """The first table with the rows of its continuation, but for those at the start that both have; text around the
    first table stays."""
    a, b = table_rows(first), table_rows(second)
    same = F.aggregate(F.arrays_zip(F.transform(a, lambda x: x["cells"]).alias("a"), F.transform(b, lambda x: x["cells"]).alias("b")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.when(s["on"] & x["a"].eqNullSafe(x["b"]), F.struct((s["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("on"))))["n"]
    more = F.array_join(F.transform(F.slice(b, same + 1, F.greatest(F.size(b), F.lit(1))), lambda x: x["markup"]), "")
    end = F.instr(first, F.lit("</table>"))
    return F.when(end > 0, F.concat(F.substring(first, F.lit(1), end - 1), more, F.substring(first, end, F.length(first)))).otherwise(first)


def bind_figures(lines: DataFrame) -> DataFrame:
    """Lines with type, name and link where they are images; the caption that follows an image is joined to it and goes."""
    is_image = F.col("text").startswith("![")
    after, image_before = F.lead("text").over(by_pos()), F.lag("text").over(by_pos()).startswith("![")
    taken = F.coalesce(image_before, F.lit(False)) & is_figure_caption(F.col("text"))
    name = F.when(is_image & is_figure_caption(after), after)
    rows = lines.withColumn("name", name).withColumn("taken", taken).withColumn("type", F.when(is_image, "figure")).withColumn("link", F.when(is_image, F.nullif(figure_link(F.col("text")), F.lit(""))))
    return rows.where("not taken").withColumn("text", F.concat_ws("\n", "text", "name")).drop("taken")


def bind_equations(lines: DataFrame, mark: str = "$$") -> DataFrame:
    """Lines with blocks between marks joined to one line of type `equation`, together with a line before that ends in a colon
    (its name) and the explanations, notes and further blocks that follow."""
    free = F.col("type").isNull()
    is_mark = free & (F.trim("text") == mark)
    seen = F.sum(is_mark.cast("int")).over(so_far())
    rows = lines.withColumn("inside", is_mark | (free & (seen % 2 == 1))).withColumn("opens", is_mark & (seen % 2 == 1))
    rows = rows.withColumn("names", free & F.lead("opens").over(by_pos()) & F.col("text").rlike("[:：]$"))
    tail = free & ~F.col("inside") & ~F.col("names") & F.col("text").rlike(r"——\s*\S|^[注主]：")
    rows = rows.withColumn("part", F.when(F.col("names") | F.col("inside"), "core").when(tail, "tail"))
    # a run goes on over cores and tails; a name or a block after anything else begins one
    before = F.lag("part").over(by_pos())
    begins = (F.col("names") & F.coalesce(before.isNull(), F.lit(True))) | (F.col("opens") & before.isNull()) | (F.col("names") & before.isNotNull())
    run = F.sum(F.when(begins, 1).otherwise(0)).over(so_far())
    breaks = F.sum(F.when(F.col("part").isNull(), 1).otherwise(0)).over(so_far())
    rows = rows.withColumn("run", run).withColumn("breaks", breaks)
    first = F.min(F.when(F.col("part") == "core", F.col("breaks"))).over(Window.partitionBy("doc_id", "run"))
    rows = rows.withColumn("member", F.col("part").isNotNull() & (F.col("run") > 0) & (F.col("breaks") == first))
    block = F.when(F.col("member"), F.concat(F.lit("e"), F.col("run"))).otherwise(F.concat(F.lit("p"), F.col("pos")))
    ends = F.col("names") | (is_mark & (seen % 2 == 0))
    rows = rows.withColumn("gap", F.when(~F.col("member"), "").when(ends, "\n\n").otherwise("\n")).withColumn("block", block)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text", "gap"))), lambda x: F.concat(x["text"], x["gap"]))
    one = lambda c: F.min_by(c, "pos").alias(c)
    out = rows.groupBy("doc_id", "block").agg(F.min("pos").alias("pos"), F.regexp_replace(F.array_join(parts, ""), r"\n+$", "").alias("text"), one("member"), one("type"), one("name"), one("link"), F.max(F.when(F.col("names"), F.col("text"))).alias("named"))
    of = lambda mine, other: F.when(F.col("member"), mine).otherwise(F.col(other)).alias(other)
    return out.select("doc_id", "pos", "text", of(F.lit("equation"), "type"), of(F.col("named"), "name"), "link")


def bind_tables(lines: DataFrame, lookback: int = 4) -> DataFrame:
    """Lines with tables joined to one line of type `table`: the nearest title at most `lookback` lines before and all lines between,
    continuations (a line `续表 …` or the title again, and a table after it), and notes with the numbered lines that follow them."""
    free = F.col("type").isNull()
    is_table = free & F.col("text").startswith("<table")
    rows = lines.withColumn("table", is_table)
    # a table goes on with one whose line before says so: `续表 …`, or the title again
    is_title = free & is_table_title(F.col("text"))
    prior = F.last(F.when(is_title, F.col("text")), True).over(by_pos().rowsBetween(Window.unboundedPreceding, -2))
    since = F.max(F.when(F.col("table"), F.col("pos"))).over(by_pos().rowsBetween(Window.unboundedPreceding, -1))
    before = F.lag("text").over(by_pos())
    rows = rows.withColumn("again", F.col("table") & since.isNotNull() & F.coalesce(before.rlike("^续表 ") | before.startswith(prior), F.lit(False)))
    rows = rows.withColumn("bridge", F.coalesce(F.lead("again").over(by_pos()), F.lit(False)))
    # a title before another table is that table's
    near = by_pos().rowsBetween(-lookback, -1)
    title_at, last_table = (F.last(F.when(test, F.col("pos")), True).over(near) for test in (is_title & ~F.col("bridge"), F.col("table")))
    rows = rows.withColumn("title_at", F.when(F.col("table") & ~F.col("again") & (last_table.isNull() | (title_at > last_table)), title_at))
    until = F.min(F.when(F.col("title_at").isNotNull(), F.struct("pos", "title_at"))).over(by_pos().rowsBetween(Window.currentRow, lookback))
    rows = rows.withColumn("lead_of", F.when(~F.col("table") & (until["title_at"] <= F.col("pos")), until["pos"]))
    head = F.last(F.when(F.col("table") & ~F.col("again"), F.col("pos")), True).over(so_far())
    rows = rows.withColumn("head", head)
    # notes: note lines, then lines in the style of the first of them with codes that go on by one
    rows = rows.withColumn("note", free & ~F.col("table") & F.col("text").rlike(NOTE))
    body = F.when(F.col("note"), strip(F.regexp_replace("text", NOTE, ""))).otherwise(F.col("text"))
    f = features(body)
    rows = rows.withColumn("f", f).withColumn("code", ordinal(F.col("f.prefix"))).withColumn("style", F.when(F.col("f.prefix") != "", F.concat_ws("/", "f.type", "f.dot_count"))).withColumn("starts", F.coalesce(starts_level(F.col("f")), F.lit(False)))
    lag = lambda c: F.lag(c).over(by_pos())
    bare = F.lag(F.col("note") & (F.length("text") <= 6)).over(by_pos())
    follows = (F.coalesce(lag("style").eqNullSafe(F.col("style")) & (F.col("code") == lag("code") + 1), F.lit(False)) | (F.coalesce(bare, F.lit(False)) & F.col("starts"))) & F.col("style").isNotNull()
    link = F.col("note") | (free & ~F.col("table") & follows)
    rows = rows.withColumn("link_on", F.col("table") | F.col("bridge") | link)
    broken = F.sum(F.when(F.col("link_on"), 0).otherwise(1)).over(so_far())
    rows = rows.withColumn("broken", broken)
    head_broken = F.max(F.when(F.col("pos") == F.col("head"), F.col("broken"))).over(Window.partitionBy("doc_id", "head"))
    tail = F.col("head").isNotNull() & F.col("link_on") & (F.col("broken") == head_broken)
    rows = rows.withColumn("owner", F.coalesce("lead_of", F.when(tail, F.col("head"))))
    key = F.coalesce("owner", F.when(F.col("table"), F.col("pos")))
    rows = rows.withColumn("key", F.coalesce(key, -1 - F.col("pos")))
    piece = F.struct("pos", "text", "table", "again", "bridge", "note", (F.col("lead_of").isNotNull()).alias("leads"), "type", "name", "link")
    grouped = rows.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(piece)).alias("parts"))
    join = lambda xs, sep: F.array_join(F.transform(xs, lambda x: x["text"]), sep)
    pick = lambda test: F.filter("parts", test)
    leads, notes = pick(lambda x: x["leads"]), pick(lambda x: ~x["leads"] & ~x["table"] & ~x["bridge"])
    whole = F.aggregate(pick(lambda x: x["table"]), F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x["text"]).otherwise(merge_tables(acc, x["text"])))
    note_text = F.aggregate(notes, F.lit(""), lambda acc, x: F.concat(acc, F.when(x["note"], "\n\n").otherwise("\n"), x["text"]))
    text = F.concat(F.when(F.size(leads) > 0, F.concat(join(leads, "\n\n"), F.lit("\n\n"))).otherwise(""), whole, note_text)
    name = F.element_at(F.filter(leads, lambda x: is_table_title(x["text"])), -1)["text"]
    one = F.col("parts")[0]
    is_object = F.col("key") >= 0
    return grouped.select("doc_id", one["pos"].alias("pos"), F.when(is_object, text).otherwise(one["text"]).alias("text"), F.when(is_object, "table").otherwise(one["type"]).alias("type"), F.when(is_object, F.when(F.size(leads) > 0, name)).otherwise(one["name"]).alias("name"), F.when(is_object, F.lit(None)).otherwise(one["link"]).alias("link"))


def bind_objects(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, text, type, name, link): the lines of documents with figures, equations and tables as one line each; type is null for text."""
    return bind_tables(bind_equations(bind_figures(lines)))


def flags() -> list[Column]:
    """Aggregates of lines with type, name and link: which objects a chunk has, and their names and links in order."""
    names = lambda kind, c: F.transform(F.array_sort(F.collect_list(F.when((F.col("type") == kind) & F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("x"))))), lambda x: x["x"])
    has = lambda kind: F.coalesce(F.bool_or(F.col("type") == kind), F.lit(False)).alias(f"has_{kind}")
    return [has("table"), has("equation"), has("figure"), names("table", "name").alias("table_names"), names("equation", "name").alias("equation_names"), names("figure", "link").alias("figure_links"), names("figure", "name").alias("figure_names")]


FLAGS = ["has_table", "has_equation", "has_figure"]
NAMES = ["table_names", "equation_names", "figure_links", "figure_names"]


def merge_metadata(chunks: DataFrame, *keys: str, order: str = "pos") -> DataFrame:
    """One row of the metadata for each group of chunks: flags or-ed, names in order, each once."""
    ordered = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c])))
    return chunks.groupBy(*keys).agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in FLAGS), *(ordered(c).alias(c) for c in NAMES))
