"""Pluggable models with offline defaults: embedder, re-ranker, text model and tokenizer.

An embedder takes texts and gives a matrix, a re-ranker takes queries and texts and gives scores, a text model takes a task and a text and
gives a text. Any callable with that shape serves; the defaults depend on their input alone, so results can be repeated."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[Sequence[str]], np.ndarray]
Reranker = Callable[[Sequence[str], Sequence[str]], Sequence[float]]
TextModel = Callable[[str, str], str]

_WORD = re.compile(r"[㐀-䶿一-鿿]|[^\W_㐀-䶿一-鿿]+")


_HAN, _PLAIN = re.compile("[㐀-䶿一-鿿]"), re.compile(r"[^\W_]+")
#: Words whose hashes an embedder keeps.
KEPT = 200_000


def words(text: str) -> list[str]:
    """Lower-cased words; of runs of Han characters all pairs of neighbours, a lone one alone."""
    if not _HAN.search(lower := text.lower()):
        return _PLAIN.findall(lower)
    out: list[str] = []
    end, single = -1, ""
    for m in _WORD.finditer(lower):
        w = m.group()
        if "㐀" <= w <= "鿿":
            if single and m.start() == end:
                if out and out[-1] == single:
                    out.pop()
                out.append(single + w)
            else:
                out.append(w)
            single, end = w, m.end()
        else:
            out.append(w)
            single = ""
    return out


class HashingEmbedder:
    """Bags of words hashed to `dim` places with a sign, of length one; a text without words is the zero vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._known: dict[str, tuple[int, int]] = {}

    def __getstate__(self) -> dict:
        return {"dim": self.dim, "_known": {}}

    def bags(self, texts: Sequence[str]) -> np.ndarray:
        """Whole numbers, a row for each text; the bag of texts joined by blanks is the sum of theirs."""
        out = np.zeros((len(texts), self.dim))
        known = self._known
        for i, text in enumerate(texts):
            row = [0] * self.dim
            for w, n in Counter(words(text or "")).items():
                if w not in known:
                    if len(known) >= KEPT:
                        known.clear()
                    h = zlib.crc32(w.encode())
                    known[w] = (h >> 1) % self.dim, 1 if h & 1 else -1
                at, sign = known[w]
                row[at] += sign * n
            out[i] = row
        return out

    @staticmethod
    def unit(bags: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(bags, axis=1, keepdims=True)
        return (bags / np.where(size == 0, 1, size)).astype(np.float32)

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        return self.unit(self.bags(texts))


class OverlapReranker:
    """The share of words that two texts have in common (Jaccard)."""

    def __call__(self, queries: Sequence[str], texts: Sequence[str]) -> list[float]:
        sets = [(set(words(q or "")), set(words(t or ""))) for q, t in zip(queries, texts, strict=True)]
        return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in sets]


class OfflineText:
    """A text model without a network. Tasks: `translate` and `hyde` give the text back, `route` and `plan` go by words, `answer` adds what is new in the
    content to the answer so far, and the judges count words."""

    def __call__(self, task: str, text: str) -> str:
        if task == "route":
            return "save" if re.search(r"(?i)\b(save|store|upload|index)\b|保存|存储|上传|入库", text) else "retrieve" if text.strip() else "unknown"
        if task == "answer":
            query, content, answer = text.split("\x1f")
            wanted = set(words(query))
            best = max(re.split(r"(?<=[.!?。！？])\s*|\n", content), key=lambda s: (len(wanted & set(words(s))), -len(s)), default="").strip()
            return answer if not best or best in answer else f"{answer} {best}".strip()
        if task in ("faithfulness", "relevance", "completeness"):
            a, b = (set(words(x)) for x in text.split("\x1f"))
            return f"score: {1 + round(4 * len(a & b) / len(a)) if a else 1}"
        return text


def embed(text: Column, embedder: Embedder | None = None) -> Column:
    """array<float> of a text, by batches."""
    model = embedder or HashingEmbedder()

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        found = np.asarray(model([t or "" for t in texts.to_pylist()]), np.float32).reshape(len(texts), -1)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel()))

    return vectors(text)


def rerank_score(query: Column, text: Column, reranker: Reranker | None = None) -> Column:
    model = reranker or OverlapReranker()

    @F.arrow_udf("double")
    def score(queries: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([float(x) for x in model(queries.to_pylist(), texts.to_pylist())], pa.float64())

    return score(query, text)


def ask(task: str, text: Column, model: TextModel | None = None) -> Column:
    """A text model's reply for each row."""
    reply = model or OfflineText()

    @F.arrow_udf("string")
    def replies(texts: pa.Array) -> pa.Array:
        return pa.array([reply(task, t or "") for t in texts.to_pylist()], pa.string())

    return replies(text)


def tokenize(text: Column) -> Column:
    """array<string>: words() of a text, for languages that do not put blanks between words."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([words(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

    return split(text)
