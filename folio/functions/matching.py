"""The heading match of folio.functions.text.fuzzy_match for functions that run within a document's fold."""

from __future__ import annotations

import re

_MARK = re.compile(r"[^\w\s（）()、.\-—]")


def distance(a: str, b: str) -> int:
    """Levenshtein distance."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def match(outline: str, line: str, threshold: float = 0.8) -> tuple[bool, int]:
    """Does a line start with a heading, and where does the heading end in it? As fuzzy_match says."""
    n = len(outline)
    if line.startswith(outline):
        return True, n
    bare = "".join(outline.split())
    if bare:
        seen = 0
        for i, c in enumerate(line[: 2 * n]):
            if c.isspace():
                continue
            if c != bare[seen]:
                break
            seen += 1
            if seen == len(bare):
                return True, i + 1
    if re.match(r"\d+\.\d+\.\d+", line):
        return False, -1
    mark = _MARK.search(line)
    if mark and mark.group() in "。！？，,":
        return False, -1
    if "." in outline and outline.split(" ")[0] == line.split(" ")[0]:
        return True, min(n, len(line))
    if not n or 1 - distance(outline, line[:n]) / n < threshold:
        return False, -1
    ends = range(max(n - 2, 1), min(n + 2, len(line)) + 1)
    return True, min(ends, key=lambda e: (distance(outline, line[:e]), abs(e - n), e), default=n)
