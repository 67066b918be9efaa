"""Attaching explanations to sections. Each explanation looks on from the place where the one before was found, so this is
a fold over the heads and titles of one document; texts stay where they are."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.matching import match
from folio.session import ship

TARGETS = "doc_id long, pos int, target int"


def _word(text: str) -> str:
    return (text or "").replace("　", " ").split(" ")[0]


def by_number(heads: list[tuple[int, str]], titles: list[tuple[int, str]]) -> Iterator[tuple[int, int]]:
    """(pos, target) of heads by the first words of titles: `a~b` goes to all from a to b, `a、b` to both, `a` to a.

    An end that is not found leaves the start alone; what is not found at all goes to the last one found before."""
    places: dict[str, list[int]] = {}
    for i, (_, title) in enumerate(titles):
        places.setdefault(_word(title), []).append(i)
    at, last = 0, None

    def find(label: str, low: int) -> int | None:
        found = places.get(label, [])
        k = bisect_left(found, low)
        return found[k] if k < len(found) else None

    for pos, text in heads:
        head = _word(text)
        mark = next((m for m in "~、" if m in head), None)
        labels = head.split(mark) if mark else [head]
        low = find(labels[0], at)
        ends = [find(x, at if low is None else low) for x in labels[1:]]
        high = max((x for x in ends if x is not None), default=None)
        if mark == "~" and low is not None and high is not None:
            found = list(range(low, high + 1))
        elif mark == "~":
            found = [x for x in (low if low is not None else last,) if x is not None]
        else:
            found = [x for x in (low, *ends) if x is not None] or [x for x in (last,) if x is not None]
        for x in found:
            yield pos, titles[x][0]
        reached = [x for x in (low, high) if x is not None]
        if reached:
            at, last = reached[0], max(reached)


def by_title(heads: list[tuple[int, str]], titles: list[tuple[int, str, list]]) -> Iterator[tuple[int, int]]:
    """(pos, target) of heads by titles that match them, or that have a parent that does; what is not found goes to the last one found before."""
    at, last = 0, None
    for pos, head in heads:
        for i in range(at, len(titles)):
            _, title, parents = titles[i]
            above = any(p is not None and match(head, p)[0] for p in parents)
            if above or match(head, title)[0]:
                at, last = i if above else i + 1, i
                break
        else:
            if last is None:
                continue
        yield pos, titles[last][0]


def _fold(heads: DataFrame, base: DataFrame, find: Callable) -> DataFrame:
    ship(base.sparkSession)

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"doc_id": [], "pos": [], "target": []}, dtype="int64")
        left, right = left.sort_values("pos"), right.sort_values("pos")
        titles = list(right.drop(columns="doc_id").itertuples(index=False, name=None))
        found = list(find(list(zip(left["pos"], left["text"], strict=True)), titles))
        return pd.DataFrame({"doc_id": [left["doc_id"].iloc[0]] * len(found), "pos": [a for a, _ in found], "target": [b for _, b in found]})

    # both may come from one table: new names tell their columns apart
    heads, base = heads.select("doc_id", "pos", "text").toDF("doc_id", "pos", "text"), base.toDF(*base.columns)
    return heads.groupBy("doc_id").cogroup(base.groupBy("doc_id")).applyInPandas(fold, TARGETS)


def attach(explanations: DataFrame, base: DataFrame) -> DataFrame:
    """(doc_id, pos, target): by_number on explanations and base sections (doc_id, pos, text)."""
    return _fold(explanations, base.select("doc_id", "pos", "text"), by_number)


def attach_titles(explanations: DataFrame, base: DataFrame) -> DataFrame:
    """(doc_id, pos, target): by_title on explanations (doc_id, pos, text) and base sections (doc_id, pos, text, parents)."""
    names = F.transform("parents", lambda p: p["title"])
    return _fold(explanations, base.select("doc_id", "pos", "text", names.alias("parents")), by_title)
