"""The structural chunker: sections by headings, explanations attached, objects, and packing by size.

Lines, features, objects and texts are DataFrame operations. Where a section starts depends on all lines before, so that
decision is a fold over one document's lines; so is packing, over one document's sections."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.headings import features, last_digits, ordinal, starts_level
from folio.functions.matching import match
from folio.functions.text import breadcrumb, clean_line, fold_spelling, fuzzy_match, is_page_number
from folio.operators import attach as A
from folio.operators.chunking import fold_packs
from folio.operators.lines import clean_lines, number
from folio.operators.objects import FLAGS, NAMES, bind_objects, flags
from folio.operators.outline import PARENT, TOP, Heading, featured, headings_of, infer, learn, level_of, partition, split_annexes, titles
from folio.session import materialize, sent, ship

MATCH, DEEPER = 0.6, 2
PLACE = "doc_id long, part int, pos int, section int, opens boolean, named boolean, title string, en string, cut int, depth int, parents " + PARENT


@dataclass
class Line:
    """A line that may start a section; code and last are the order and the last number of its prefix."""

    pos: int
    text: str
    style: tuple[str, int]
    prefix: str
    head: str
    content: str
    first: bool
    code: int
    last: int | None


@dataclass
class Section:
    """A section that lines belong to: where it starts, its title and path, and how much of its first line is heading.

    named: the title goes before the text; not so for a bare number, which stays in the text."""

    line: Line | None
    title: str
    en: str = ""
    depth: int = 0
    parents: list = field(default_factory=list)
    cut: int = 0
    named: bool = True
    style: tuple[str, int] = ("plain", 0)

    @property
    def path(self) -> list:
        return [*self.parents, (self.title, self.en)]


def whole(digits: str) -> int:
    """A number of any length; int() refuses over 4,300 digits."""
    n = 0
    for i in range(0, len(digits), 1000):
        n = n * 10 ** len(digits[i : i + 1000]) + int(digits[i : i + 1000])
    return n


def follows(line: Line, before: Line | None) -> bool:
    """Does a heading go on from an earlier one of its style? A dotted one by up to ten, another by less than three, unless the earlier is a range."""
    if before is None:
        return True
    if len(line.prefix) == len(before.prefix):
        step = line.code - before.code
    elif line.last is not None and before.last is not None:
        step = line.last - before.last
    else:
        return False
    return step > 0 and (step <= 10 if line.style[1] else step < 3 or "~" in before.head)


def place(lines: list[Line], outline: list[Heading]) -> list[tuple[int, Section]]:
    """(index of the line, section) where sections start, for the lines of one body in order.

    The next outline entry is looked for first. Else a styled line starts a section if it is the first of a numbering that is not known above and not
    more than DEEPER levels below the outline, or goes on from the last heading of its style on the path. Any other line is text."""
    tree = infer(outline)
    deepest = len(tree) + DEEPER
    out: list[tuple[int, Section]] = []
    path: list[Section] = []  # the open section and those above it
    nth = 0
    for i, line in enumerate(lines):
        entry = outline[nth] if nth < len(outline) else None
        hit, end = match(entry.title, line.text, MATCH) if entry else (False, -1)
        kind = line.style[0]
        now = path[-1] if path else None
        if hit or now is None:
            # what comes first belongs to the first entry, whatever it says
            section = Section(line, entry.title if entry else "", entry.en if entry else "", entry.depth if entry else 0, list(entry.parents) if entry else [], end if hit else 0, True, entry.style if entry else ("plain", 0))
            nth += 1
        elif kind == "content":
            continue
        elif kind in TOP:
            if line.style not in tree[0]:
                learn(tree, 0, line.style)
            section = Section(line, line.content, cut=len(line.content), style=line.style)
        else:
            bare = line.head == line.content
            title, cut = (line.prefix if bare and line.prefix != line.head else line.content), 0 if bare else len(line.content)
            same = next((s for s in reversed(path) if s.style == line.style), None)
            if same is not None:
                if line.first or not follows(line, same.line):
                    continue
                section = Section(line, title, "", same.depth, list(same.parents), cut, not bare, line.style)
            else:
                known = level_of(tree, line.style)
                related = kind == now.style[0] and line.style[1] > now.style[1]
                if known is not None and known <= now.depth:
                    if line.first:
                        continue
                    section = Section(line, title, "", known, now.parents[:known], cut, not bare, line.style)
                elif line.first or known is not None or related:
                    depth = known if known is not None else now.depth + (line.style[1] - now.style[1] if related else 1)
                    if depth > deepest:
                        continue
                    if known is None:
                        learn(tree, depth, line.style)
                    section = Section(line, title, "", depth, now.path + [None] * (depth - now.depth - 1), cut, not bare, line.style)
                else:
                    continue
        path = [s for s in path if s.depth < section.depth] + [section]
        out.append((i, section))
    return out


def locate(rows: DataFrame, outline: DataFrame, strict: bool = True) -> DataFrame:
    """Lines (doc_id, part, pos, text) with the section each belongs to; outline is (doc_id, part, pos, title, en)."""
    ship(rows.sparkSession)
    f = features(F.regexp_replace("text", "^[注主][:：]\\s*", ""), strict=strict)
    lines = rows.withColumn("f", f).select("doc_id", "part", "pos", "text", F.col("f.type").alias("type"), F.col("f.prefix").alias("prefix"), F.col("f.dot_count").alias("dot_count"), F.col("f.head").alias("head"), F.col("f.content").alias("content"), F.coalesce(starts_level(F.col("f")), F.lit(False)).alias("first"), ordinal(F.col("f.prefix")).alias("code"), last_digits(F.col("f.prefix")).alias("last"))

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("pos")
        found = [Line(*x) for x in zip(left["pos"], left["text"], zip(left["type"], left["dot_count"], strict=True), left["prefix"], left["head"], left["content"], left["first"], left["code"], [None if pd.isna(x) else whole(x) for x in left["last"]], strict=True)]
        starts = dict(place(found, headings_of(right.sort_values("pos")))) if len(left) else {}
        out, nth, section = [], -1, None
        for i, line in enumerate(found):
            opens = i in starts
            if opens:
                nth, section = nth + 1, starts[i]
            parents = [None if p is None else {"title": p[0], "en": p[1]} for p in section.parents]
            out.append((left["doc_id"].iloc[0], left["part"].iloc[0], line.pos, nth, opens, section.named, section.title, section.en, min(section.cut, len(line.text)) if opens else 0, section.depth, parents))
        return pd.DataFrame(out, columns=["doc_id", "part", "pos", "section", "opens", "named", "title", "en", "cut", "depth", "parents"])

    entries = featured(outline, strict)
    lines, entries = lines.toDF(*lines.columns), entries.toDF(*entries.columns)  # both come from one table: new names tell their columns apart
    return lines.groupBy("doc_id", "part").cogroup(entries.groupBy("doc_id", "part")).applyInPandas(fold, PLACE)


def sections(rows: DataFrame, located: DataFrame) -> DataFrame:
    """Sections with path and text: a row for each, without the sections that have no text of their own before their child starts.

    rows are lines with type, name and link."""
    both = rows.join(located, ["doc_id", "part", "pos"])
    own = F.when(F.col("opens"), F.substring("text", F.col("cut") + 1, F.length("text"))).otherwise(F.col("text"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", own.alias("text")))), lambda x: x["text"])
    one = lambda c: F.min_by(c, "pos").alias(c)
    grouped = both.groupBy("doc_id", "part", "section").agg(F.min("pos").alias("pos"), one("named"), one("title"), one("en"), one("depth"), one("parents"), F.array_join(texts, "\n").alias("text"), *flags())
    after = Window.partitionBy("doc_id", "part").orderBy("section")
    title = F.struct("title", "en")
    handed = F.coalesce(F.exists(F.filter(F.lead("parents").over(after), lambda x: x.isNotNull()), lambda x: x == title), F.lit(False))
    return grouped.withColumn("handed", handed).where("not (handed and trim(text) = '')").drop("handed").withColumn("lead", breadcrumb(F.when(F.col("named"), F.concat("parents", F.array(title))).otherwise(F.col("parents"))))


def is_explanation(header: Column) -> Column:
    """Is an annex the explanation of the body's provisions?"""
    return fuzzy_match(F.lit("附：条文说明"), header, 0.8)["matched"]


def attach_explanations(base: DataFrame, notes: DataFrame) -> DataFrame:
    """base sections with the texts of notes (of the same document) that belong to them appended, and where these begin (addition_start).

    A note's head is the first word of its text for a bare number, else its title; sections go by their titles' first words, and a note without a number
    by its title or that of a parent."""
    head = F.when(F.col("named"), F.col("title")).otherwise(F.split_part(F.ltrim("text"), F.lit(" "), F.lit(1)))
    asked = notes.select("doc_id", F.col("section").alias("pos"), head.alias("head"), F.col("text").alias("note"), "header")
    titled = fold_spelling(F.col("head"))
    byword = A.attach(asked.select("doc_id", "pos", F.col("head").alias("text")), base.select("doc_id", F.col("section").alias("pos"), F.col("title").alias("text")))
    byname = A.attach_titles(asked.where(~F.col("head").rlike(r"^\d")).select("doc_id", "pos", titled.alias("text")), base.select("doc_id", F.col("section").alias("pos"), fold_spelling(F.col("title")).alias("text"), "parents"))
    target = byword.join(byname.select("doc_id", "pos"), ["doc_id", "pos"], "left_anti").unionByName(byname)
    body = F.concat(F.lit("\n\n"), F.col("header"), F.lit("："), F.trim("note"))
    found = target.join(asked, ["doc_id", "pos"]).groupBy("doc_id", F.col("target").alias("section")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", body.alias("note")))), lambda x: x["note"]).alias("notes"))
    out = base.join(found, ["doc_id", "section"], "left")
    start = F.length(F.concat("lead", "text"))
    begins = F.aggregate("notes", F.struct(F.array().cast("array<int>").alias("at"), start.alias("n")), lambda s, x: F.struct(F.concat(s["at"], F.array(s["n"])).alias("at"), (s["n"] + F.length(x)).alias("n")))["at"]
    none = F.array().cast("array<int>")
    return out.select(*base.columns, F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), F.coalesce(begins, none).alias("addition_start"))


@dataclass
class Chunk:
    text: str
    titles: list
    en: list
    parents: list
    meta: dict
    notes: list


def crumb(path: list) -> str:
    bare = lambda x: re.sub("[:：]$", "", x)
    return "".join(f"{bare(t)}（{bare(e)}）：" if e else f"{bare(t)}：" for t, e in (x for x in path if x is not None))


def pack(chunks: list[Chunk], size: int) -> list[Chunk]:
    """Neighbours packed while the chunk is below the size and the next below 0.8 of it, or the chunk below 0.4; none starts above 0.8.

    Neighbours below one parent keep it once; a chunk that goes on into its child takes the child's place; of other neighbours the ancestors that
    both have are written once. A note that the next chunk has as well is dropped from the first."""
    out: list[Chunk] = []
    open_ = False
    for c in chunks:
        last = out[-1] if out else None
        if last is None or not open_ or not ((len(last.text) < size and len(c.text) < 0.8 * size) or len(last.text) < 0.4 * size):
            out.append(c)
            open_ = len(c.text) <= 0.8 * size
            continue
        below = len(last.parents) <= len(c.parents) and all(p in c.parents for p in last.parents) and any((t, e) in c.parents for t, e in zip(last.titles, last.en, strict=True))
        text, notes = last.text, last.notes
        if last.parents == c.parents or below:
            kept = []
            for note in notes:
                if any(note.strip() in more for more in c.notes):
                    text = text.replace(note, "", 1)
                else:
                    kept.append(note)
            notes = kept
        if last.parents == c.parents:
            cut = crumb(c.parents)
        elif below:
            own = next((t, e) for t, e in zip(last.titles, last.en, strict=True) if (t, e) in c.parents)
            cut = crumb([*last.parents, own])
        else:
            common = []
            for a, b in zip(last.parents, c.parents, strict=False):
                if a != b:
                    break
                common.append(a)
            cut = crumb(common)
        text = text + "\n\n" + c.text.removeprefix(cut)
        meta = {k: last.meta[k] or c.meta[k] for k in FLAGS} | {k: list(dict.fromkeys([*last.meta[k], *c.meta[k]])) for k in NAMES}
        same = last.parents == c.parents
        out[-1] = Chunk(text, last.titles + c.titles if same else c.titles, last.en + c.en if same else c.en, c.parents, meta, notes + c.notes)
    return out


def pack_outline(chunks: DataFrame, size: int) -> DataFrame:
    """Chunks (doc_id, chunk_id, text, outline_titles, outline_en, outline_parents, flags, names, notes) packed within a document; numbered anew."""
    ship(chunks.sparkSession)
    pair = lambda p: None if p is None else (p["title"], p["en"])

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("chunk_id").to_dict("records")
        packed = pack([Chunk(r["text"], list(r["outline_titles"]), list(r["outline_en"]), [pair(p) for p in r["outline_parents"]], {k: r[k] if k in FLAGS else list(r[k]) for k in FLAGS + NAMES}, list(r["notes"])) for r in rows], size)
        back = [{"doc_id": rows[0]["doc_id"], "chunk_id": i, "text": c.text, "outline_titles": c.titles, "outline_en": c.en, "outline_parents": [None if p is None else {"title": p[0], "en": p[1]} for p in c.parents], "notes": c.notes} | c.meta for i, c in enumerate(packed)]
        return pd.DataFrame(back)[[f.name for f in schema]]

    names = ["doc_id", "chunk_id", "text", "outline_titles", "outline_en", "outline_parents", *FLAGS, *NAMES, "notes"]
    schema = chunks.select(*names).schema
    return chunks.select(*names).groupBy("doc_id").applyInPandas(fold, schema)


def _tagged(chunks: DataFrame, kind: str, rank: int) -> DataFrame:
    return chunks.withColumn("type", F.lit(kind)).withColumn("rank", F.lit(rank))


def structural(docs: DataFrame, size: int = 500, lookback: int = 4, strict: bool = True, text: str = "text") -> DataFrame:
    """(doc_id, chunk_id, type, text, name, link, outline_titles, outline_en, outline_parents, flags, names, addition_start) of documents (doc_id, text).

    Chunks of the front matter come first, then those of the body, then figures, equations and tables once more on their own. A document without
    headings is packed by size. A size of -1 packs nothing."""
    # tables that several branches read are written once
    parts = materialize(partition(docs.select("doc_id", F.col(text).alias("text"))).drop("text"), "parts")
    outline = materialize(titles(parts), "titles")
    has = sent(materialize(outline.select("doc_id").distinct().withColumn("headed", F.lit(True)), "headed"))
    annexes = materialize(split_annexes(parts, outline).join(has, "doc_id", "left").withColumn("headed", F.coalesce("headed", F.lit(False))), "annexes")
    # windows of the object operators run within a document's part; where no object can be, lines stay as they are, and without headings none are needed
    holds = F.coalesce(F.col("body").contains("![") | F.col("body").contains("$$") | F.col("body").contains("<table"), F.lit(False))
    rows = lambda some: clean_lines(some.select("doc_id", "part", F.posexplode(F.split("body", r"\R")).alias("pos", "text")).where("text <> ''"))
    keyed = rows(annexes.where(holds)).select(F.struct("doc_id", "part").alias("doc_id"), "pos", "text")
    none = F.lit(None).cast("string")
    bare = rows(annexes.where(~holds & F.col("headed"))).select("doc_id", "part", "pos", "text", none.alias("type"), none.alias("name"), none.alias("link"))
    bound = materialize(bind_objects(keyed).select("doc_id.doc_id", F.col("doc_id.part").alias("part"), "pos", "text", "type", "name", "link").unionByName(bare), "objects")
    own = outline.join(annexes.where("part > 0").select("doc_id", F.col("header").alias("title")), ["doc_id", "title"], "left_anti").withColumn("part", F.lit(0))
    inner = body_outline(annexes)
    headed = bound.join(has, "doc_id", "left_semi")
    located = locate(headed, own.select("doc_id", "part", "pos", "title", "en").unionByName(inner), strict)
    found = sections(bound, located).join(annexes.select("doc_id", "part", "header"), ["doc_id", "part"])
    known = materialize(found, "sections")
    explains = (F.col("part") > 0) & is_explanation(F.col("header"))
    base = attach_explanations(known.where("part = 0"), known.where(explains))
    rest = known.where((F.col("part") > 0) & ~explains)
    rest = rest.withColumn("lead", F.concat("header", F.lit("："), "lead")).withColumn("notes", F.array().cast("array<string>")).withColumn("addition_start", F.array().cast("array<int>"))
    body = base.unionByName(rest)
    body = number(body.select("*", (F.col("part") * 1_000_000 + F.col("section")).alias("at")).drop("pos").withColumnRenamed("at", "pos"))
    body = body.select("doc_id", "chunk_id", F.concat("lead", "text", F.array_join("notes", "")).alias("text"), F.array("title").alias("outline_titles"), F.array("en").alias("outline_en"), F.col("parents").alias("outline_parents"), *FLAGS, *NAMES, "notes", "addition_start")
    if size >= 0:
        body = pack_outline(body, size)
        starts = F.transform("notes", lambda x: F.instr(F.col("text"), x) - 1)
        body = body.withColumn("addition_start", F.filter(starts, lambda x: x >= 0))
    # a document without headings is one part, packed where it is
    lines = lambda c: F.filter(F.transform(F.filter(F.split(c, r"\R"), lambda x: (x != "") & ~is_page_number(x)), clean_line), lambda x: x != "")
    plain = parts.select("doc_id", F.lit(0).alias("rank"), lines(F.col("front")).alias("lines")).unionByName(annexes.where("not headed").select("doc_id", F.lit(1).alias("rank"), lines(F.col("body")).alias("lines")))
    simple = plain.select("doc_id", "rank", F.posexplode(fold_packs(F.col("lines"), size if size >= 0 else 0)).alias("chunk_id", "text"))
    objects = bound.where("type is not null").select("doc_id", (F.col("part") * 1_000_000 + F.col("pos")).alias("chunk_id"), "text", "type", "name", "link", F.when(F.col("type") == "figure", 2).when(F.col("type") == "equation", 3).otherwise(4).alias("rank"))
    every = _tagged(body.drop("notes"), "chunk", 1).unionByName(simple.withColumn("type", F.lit("text")), allowMissingColumns=True).unionByName(objects, allowMissingColumns=True)
    out = number(every.select("*", F.struct("rank", "chunk_id").alias("pos")).drop("chunk_id"))
    flagged = [F.coalesce(c, F.lit(False)).alias(c) for c in FLAGS] + [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in NAMES]
    return out.select("doc_id", "chunk_id", "type", "text", "name", "link", "outline_titles", "outline_en", "outline_parents", *flagged, "addition_start")


def body_outline(annexes: DataFrame) -> DataFrame:
    """(doc_id, part, pos, title, en) of the headings that annexes have in their text."""
    rows = annexes.where("part > 0").select("doc_id", "part", F.posexplode(F.split("body", r"\R")).alias("pos", "line"))
    title = F.trim(F.regexp_replace("line", "^#+ *", ""))
    return rows.where(F.col("line").rlike("^#+")).select("doc_id", "part", "pos", title.alias("title"), F.lit("").alias("en")).where("title <> ''")
