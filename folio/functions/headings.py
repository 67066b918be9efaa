"""Column builders for headings: style, number, depth marks and order of a line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import strip

# The kinds of a number or letter inside parentheses, in order of precedence.
KINDS = [
    ("number", r"^\d+$"),
    ("cn_number", "^[一二三四五六七八九十]+$"),
    ("upper_cn_number", "^[壹贰叁肆伍陆柒捌玖拾]+$"),
    ("upper_roma", r"^[IVXⅠ-ⅿ]+$"),
    ("lower_roma", "^[ivxⅰ-ⅿ]+$"),
    ("lower_alpha", "^[a-z]+$"),
    ("upper_alpha", "^[A-Z]+$"),
]
# The heading styles in order of precedence, group 1 being the prefix. All but the annex need white space after it.
STYLES = [
    ("appendix", r"(?i)^((?:附|付|符)\s*录\s*[A-Za-z0-9]|Appendix\s*[A-Za-z0-9])\s+"),
    ("annex", r"(?i)^((?:附|付|符|Addition|Annex)(?::|：)\s*(?:.*?))(?:\s+|\n|$)"),
    ("number", r"^(\d+(?:\.\d+)*)(?:[0-9.~\\、]*?)\s+"),
    ("cn_number", r"^([一二三四五六七八九十]+)(?:[、：；.，]?)\s+"),
    ("upper_cn_number", r"^([壹贰叁肆伍陆柒捌玖拾]+)(?:[、：；.，]?)\s+"),
    ("circle", r"^([①-⑳㉑-㉟㊱-㊿]+)(?:.*?)\s+"),
    ("upper_roma", r"^([IVXⅠ-ⅿ]+)(?:.*?)\s+"),
    ("lower_roma", r"^([ivxⅰ-ⅿ]+)(?:.*?)\s+"),
    ("lower_alpha", r"^([a-z]\.(?:[a-zA-Z0-9]+\.)*)(?:.*?)\s+"),
    ("upper_alpha", r"^([A-Z]\.(?:[a-zA-Z0-9]+\.)*)(?:.*?)\s+"),
]
# A Roman numeral that is a token of its own, so that words that begin with i, v or x are none.
STRICT = {"upper_roma": r"^([IVXⅠ-ⅿ]+)[.、：)]?\s+", "lower_roma": r"^([ivxⅰ-ⅿ]+)[.、：)]?\s+"}
# What the last part of a numbering is for the first of its level, and the marks that end a heading.
FIRST = "^[1一壹aAIⅠiⅰ①]$"
MARKS = "[,!?;。，！？；:：]"
FIELDS = "type string, prefix string, inside string, dot_count int, head string, content string"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first_group(c: Column, pattern: str) -> Column:
    return F.regexp_extract(c, "(?U)" + pattern, 1)


def is_first(number: Column) -> Column:
    """Is the last part of a numbering (a dot at its end aside) the first of its level?"""
    last = F.element_at(F.split(F.regexp_replace(number, r"\.$", ""), r"\."), -1)
    return last.rlike(FIRST)


def ordinal(prefix: Column) -> Column:
    """The sum of the code points of a prefix: it grows by one from a heading to the next while no digit is added."""
    return F.aggregate(F.split(prefix, ""), F.lit(0), lambda s, c: s + F.when(c == "", 0).otherwise(F.ascii(c)))


def last_digits(prefix: Column) -> Column:
    """The digits that a prefix ends in (a dot aside), however many; null where there are none."""
    return F.nullif(F.regexp_extract(prefix, r"(\d+)\.?$", 1), F.lit(""))


def last_number(prefix: Column) -> Column:
    """last_digits as a number; null where there is none or it does not fit an int."""
    return last_digits(prefix).try_cast("int")


def dot_count(prefix: Column) -> Column:
    """Dots of a prefix, one at its end aside."""
    return F.length(prefix) - F.length(F.replace(F.regexp_replace(prefix, r"\.$", ""), F.lit("."), F.lit(""))) - F.when(prefix.endswith("."), 1).otherwise(0)


def first_match(c: Column, patterns: list[str], group: int = 0) -> Column:
    """struct<text, pattern> of the first pattern that matches at the start; empty and null where none does."""
    found = F.lit(None).cast("struct<text: string, pattern: string>")
    for p in reversed(patterns):
        at_start = "^(?:" + p.removeprefix("^") + ")"
        found = F.when(c.rlike(at_start), F.struct(F.regexp_extract(c, at_start, group).alias("text"), F.lit(p).alias("pattern"))).otherwise(found)
    return F.coalesce(found, F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("pattern")))


def features(line: Column, outline: bool = False, strict: bool = True) -> Column:
    """struct<type, prefix, inside, dot_count, head, content> of a line, by the first style that it begins with.

    inside: what parentheses hold; head: the line up to its first white space; content: the heading, which ends at a mark in dotted numberings.
    outline: lines are known headings, so the whole line is content and a line without a style is `plain`, not `content`.
    strict: Roman numerals must be tokens of their own; else a word that begins with i, v or x counts as one."""
    no = F.lit(None).cast("string")

    def kind(inner: Column, ending: str) -> Column:
        out = F.lit("other")
        for name, pattern in reversed(KINDS):
            out = F.when(inner.rlike("(?U)" + pattern), name).otherwise(out)
        return F.concat(out, F.lit(ending))

    def enclosed(pattern: str, ending: str, left: int, most: int) -> Column:
        """The style of a prefix that holds its number in parentheses."""
        inner = lambda p: strip(F.substring(p, F.lit(left + 1), F.length(p) - left - 1))
        return let(_first_group(line, pattern), lambda p: let(inner(p), lambda x: F.struct(kind(x, ending).alias("type"), F.when(F.length(x) <= most, p).otherwise("").alias("prefix"), x.alias("inside"))))

    found = [enclosed(r"^([（(][^）)]+[）)])(?:.*?)\s+", "_parentthese", 1, 3), enclosed(r"^(.{1,3}[）)])(?:.*?)\s+", "_right_parentthese", 0, 9)]
    for name, pattern in STYLES:
        found.append(F.struct(F.lit(name).alias("type"), _first_group(line, STRICT.get(name, pattern) if strict else pattern).alias("prefix"), no.alias("inside")))
    nothing = F.struct(F.lit("plain" if outline else "content").alias("type"), F.lit("").alias("prefix"), no.alias("inside"))
    first = F.coalesce(F.get(F.filter(F.array(*found), lambda x: x["prefix"] != ""), F.lit(0)), nothing)

    def described(f: Column) -> Column:
        styled = f["prefix"] != ""
        tail = F.regexp_extract(F.substring(line, F.length(f["prefix"]) + 1, F.length(line)), r"(?U)^\S*\s+", 0)
        head = let(tail, lambda t: F.when(~styled, "").when(t != "", F.concat(f["prefix"], t)).otherwise(line))
        dots = F.when(styled, dot_count(f["prefix"])).otherwise(0)

        def whole(h: Column) -> Column:
            rest = F.regexp_extract(F.substring(line, F.length(h) + 1, F.length(line)), r"^[^\n]*", 0)
            content = line if outline else let(rest, lambda r: F.when(~styled, line).when((dots > 0) & r.rlike(MARKS), strip(h)).otherwise(strip(F.concat(h, r))))
            return F.struct(f["type"].alias("type"), f["prefix"].alias("prefix"), f["inside"].alias("inside"), dots.cast("int").alias("dot_count"), strip(h).alias("head"), content.alias("content"))

        return let(head, whole)

    return let(first, described)


def starts_level(feature: Column) -> Column:
    """Is a heading with these features the first of its level?"""
    return is_first(F.coalesce(feature["inside"], feature["prefix"]))
