"""Text column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_NUMBER = r"^-?\d+(\.\d+)?$"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_line(c: Column) -> Column:
    """Without leading number signs, then stripped."""
    return strip(F.regexp_replace(c, r"^#+", ""))


def is_page_number(c: Column) -> Column:
    return c.rlike(PAGE_NUMBER)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance(a, the first length(a) characters of b) / length(a); null for an empty a."""
    return F.lit(1.0) - F.levenshtein(a, F.substring(b, F.lit(1), F.length(a))) / F.nullif(F.length(a), F.lit(0))


def breadcrumb(path: Column) -> Column:
    """A path of struct<title, en> as `title：` or `title（en）：` joined; gaps (null) are skipped, a trailing colon is dropped first."""
    bare = lambda c: F.regexp_replace(c, "[:：]$", "")
    one = lambda x: F.concat(bare(x["title"]), F.when(F.coalesce(x["en"], F.lit("")) != "", F.concat(F.lit("（"), bare(x["en"]), F.lit("）"))).otherwise(""), F.lit("："))
    return F.array_join(F.transform(F.filter(path, lambda x: x.isNotNull()), one), "")


def figure_link(c: Column) -> Column:
    return F.regexp_extract(c, r"images/([\s\S]*?)\.jpg", 0)


def is_figure_caption(c: Column) -> Column:
    return c.rlike(r"(?i)^(图|figure|image)\s*\S*(\s+.*)?")


def is_table_title(c: Column) -> Column:
    return c.rlike(r"(?i)^(表|table\s+)")


def fold_spelling(c: Column) -> Column:
    """The two usual misspellings of the word for appendix corrected."""
    return F.replace(F.replace(c, F.lit("付录"), F.lit("附录")), F.lit("符录"), F.lit("附录"))


def without_contained(text: Column, note: Column, later: Column) -> Column:
    """A text without a note of its own that, white space at its ends aside, a later text has as well."""
    return F.when(F.contains(later, strip(note)), F.replace(text, note, F.lit(""))).otherwise(text)


def outline_entry(c: Column) -> Column:
    """A line of a table of contents without its leader and page number: cut at an ellipsis, else before a page number at
    the end, else at a run of two dots or more; then without number signs. Entries of one character are null."""
    cut = F.when(c.rlike("…+"), F.regexp_extract(c, "^(.*?)…+", 1)).when(c.rlike(r" \d+$"), F.regexp_replace(c, r" \d+$", "")).otherwise(F.regexp_extract(c, r"^(.*?)(?:\.{2,}.*)?$", 1))
    out = strip(F.regexp_replace(cut, r"^#+ +", ""))
    return F.when(F.length(out) > 1, out)


def tokens(c: Column) -> Column:
    """Lower-cased words split at white space, without empty ones."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def line_facts(line: Column, longest: Column | int) -> Column:
    """struct of what fuzzy_match needs of a line and no heading changes, for headings of up to `longest` characters: where a line meets many, it is made once."""
    first_mark = F.regexp_extract(line, r"(?U)([^\w\s（）()、.\-—])", 1)
    never = line.rlike(r"^\d+\.\d+\.\d+") | first_mark.isin("。", "！", "？", "，", ",")
    start = F.substring(line, F.lit(1), 2 * (longest if isinstance(longest, Column) else F.lit(longest)) + 2)
    return F.struct(never.alias("never"), F.split_part(line, F.lit(" "), F.lit(1)).alias("token"), F.regexp_replace(start, r"(?U)\s", "").alias("bare"), start.alias("start"))


def fuzzy_match(outline: Column, line: Column, threshold: float | Column = 0.8, facts: Column | None = None, bare: Column | None = None) -> Column:
    """struct<matched, end>: does a line start with a heading, and where does the heading end in it?

    In this order: a literal prefix; a prefix but for white space; no, if the line has a three-level number or its first
    punctuation is a sentence's; equal number tokens of a dotted heading; Levenshtein similarity of at least the threshold. facts: line_facts of the line; `line` may
    then be its start. bare: the heading without white space."""
    n = F.length(outline)
    facts = line_facts(line, n) if facts is None else facts
    bare, window = F.regexp_replace(outline, r"(?U)\s", "") if bare is None else bare, F.substring(line, F.lit(1), 2 * n)
    bare_line = F.regexp_replace(window, r"(?U)\s", "")
    # the position in the line after as many characters other than blanks as the heading has
    chars = F.split(window, "")
    count = F.aggregate(chars, F.struct(F.lit(0).alias("seen"), F.lit(0).alias("at"), F.lit(0).alias("end")), lambda acc, x: F.struct((acc["seen"] + F.when(x.rlike(r"(?U)^\s$"), 0).otherwise(1)).alias("seen"), (acc["at"] + 1).alias("at"), F.when((acc["end"] == 0) & (acc["seen"] + F.when(x.rlike(r"(?U)^\s$"), 0).otherwise(1) == F.length(bare)), acc["at"] + 1).otherwise(acc["end"]).alias("end")))["end"]
    result = lambda ok, end: F.struct(F.lit(ok).alias("matched"), end.cast("int").alias("end"))
    no = result(False, F.lit(-1))
    token = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    ends = F.filter(F.sequence(F.greatest(n - 2, F.lit(1)), n + 2), lambda e: e <= F.length(line))
    best = F.array_min(F.transform(ends, lambda e: F.struct(F.levenshtein(outline, F.substring(line, F.lit(1), e)).alias("d"), F.abs(e - n).alias("off"), e.alias("e"))))["e"]
    # a distance that is too large is not found out: with two to spare the comparison itself decides
    most = (F.ceil(n * (1 - (threshold if isinstance(threshold, Column) else F.lit(threshold)))) + 2).cast("int")
    distance = F.call_function("levenshtein", outline, F.substring(line, F.lit(1), n), most)
    alike = (distance >= 0) & (F.lit(1.0) - distance / F.nullif(n, F.lit(0)) >= threshold)
    return (
        F.when(F.startswith(line, outline), result(True, n))
        .when((bare != "") & F.startswith(facts["bare"], bare) & F.startswith(bare_line, bare), result(True, count))
        .when(facts["never"], no)
        .when(outline.contains(".") & (token(outline) == facts["token"]), result(True, F.least(n, F.length(line))))
        .when(alike, result(True, F.coalesce(best, n)))
        .otherwise(no)
    )
