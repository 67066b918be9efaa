"""Language ID by cross-parsing entropy: suffix automata of labelled text, and the fewest phrases to write a text with.

Fitting takes a bounded sample: of each language the SAMPLE_DOCS labelled documents with a letter in their middle that come first in a hashed order of
doc_id (ties by doc_id), SAMPLE_CHARS / SAMPLE_DOCS code points from the middle of each. Whatever the size of the corpus, no more is read
to the driver, and the rank is limited in each task before rows are shuffled. From each language's sample a suffix
automaton is built, which accepts every substring; its size is linear in the sample.

Prediction parses the whole text, in segments of SEGMENT code points: a phrase goes on as long as the automaton has it, and the
next starts where it fails. The cost is the bits to write the text: log2(size) for a phrase as a pointer, where the size is
that of the largest sample for all languages, so that a small sample makes nothing cheaper, and LITERAL for a symbol that the
language's sample does not have, which is a phrase of its own. The language with the fewest wins, ties go to the first by name. The score is second / (best + second) of these
counts: 0.5 for a tie, near 1 for a clear case, 1 if only one language was learned. All languages and many segments are
stepped together by table look-ups, so Python code runs per code point of a segment, not of a text.

Text is lower-cased, and each run of other characters than letters counts as one blank. All symbols of the samples are known: the SYMBOLS most
frequent have columns in the table of moves (about 20 MB a language), the moves of the others, as of scripts with many signs, are listed and searched.
A null text, one without a letter, or a model without a language gives `und` with score 0. held_out is
crc32(doc_id as text) mod 4 = 2, false for a null doc_id. Rows that repeat a doc_id are judged alone. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm._common import begin, caches, ship, slices, utf8

SAMPLE_DOCS, SAMPLE_CHARS, SEGMENT, SYMBOLS = 80, 24_000, 256, 95
_OTHER = re.compile(r"[\W\d_]+")
_GROUP = 8192
LITERAL = np.log2(0x110000)
_built: dict[tuple, Model] = {}
caches("language ID", _built.clear)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of the smallest automaton of all substrings; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Model:
    """Suffix automata of (language, sample) pairs as one table of moves: next state * 2, plus 1 where a phrase starts."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        texts = [_OTHER.sub(" ", text.lower()) for _, text in samples]
        count = Counter(c for t in texts for c in t)
        self.known = [c for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))]
        self.total = len(self.known) + 1  # 0 is any other symbol
        self.width = min(self.total, SYMBOLS + 1)  # symbols below have columns in the table, the moves of the others are listed
        self.blank = self.known.index(" ") + 1 if " " in self.known else 0
        self.symbol = np.fromiter((0 if chr(i).isalpha() else self.blank for i in range(0x110000)), np.int32, 0x110000)
        for i, c in enumerate(self.known):
            self.symbol[ord(c)] = i + 1
        self.cost = np.log2(max(map(len, texts), default=0) + 2)
        self.unseen = np.ones((self.total, len(texts)), np.int64)
        self.roots, tables, at = [], [], 0
        listed: list[tuple[int, int]] = []
        self.first_moves = np.zeros((len(texts), self.total), np.int32)  # of each language: how a phrase starts with a symbol
        for i, t in enumerate(texts):
            moves = suffix_automaton(self._symbols(t).tolist())
            for m in moves:
                m.pop(0, None)
            table = np.zeros((len(moves), self.width), np.int32)  # unknown: a phrase of its own, then the root
            self.unseen[list(moves[0]), i] = 0
            self.first_moves[i] = 2 * at + 1
            for c, to in moves[0].items():
                self.first_moves[i, c] = 2 * (at + to) + 1
            table[:] = self.first_moves[i, : self.width]
            for s, m in enumerate(moves):
                dense = [c for c in m if c < self.width]
                if dense:
                    table[s, dense] = [2 * (at + m[c]) for c in dense]
                listed += [((at + s) * self.total + c, 2 * (at + to)) for c, to in m.items() if c >= self.width]
            self.roots.append(at)
            tables.append(table)
            at += len(moves)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        listed.sort()
        self.rare_keys = np.array([k for k, _ in listed] + [1 << 62], np.int64)
        self.rare_moves = np.array([v for _, v in listed] + [0], np.int32)

    def _symbols(self, text: str) -> np.ndarray:
        """Symbols of a lower-case text, with one blank for each run of other characters than letters."""
        found = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if self.blank and len(found):
            again = np.zeros(len(found), bool)
            again[1:] = (found[1:] == self.blank) & (found[:-1] == self.blank)
            found = found[~again]
        return found

    def phrases(self, texts: list[str]) -> np.ndarray:
        """The number of phrases of each text in each language."""
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        parts = [self._symbols(t.lower()) for t in texts]
        whole = np.concatenate([np.zeros(0, np.int32), *parts])
        sizes = np.array([len(p) for p in parts], np.int64)
        many = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        start = np.repeat(np.cumsum(sizes) - sizes, many) + nth * SEGMENT
        length = np.minimum(SEGMENT, np.repeat(sizes, many) - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        whole = np.concatenate([whole, np.zeros(SEGMENT, np.int32)])
        for at in range(0, len(order), _GROUP):
            own = order[at : at + _GROUP]
            symbols = np.ascontiguousarray(whole[start[own][:, None] + np.arange(int(length[own[0]]))].T)
            active = np.searchsorted(-length[own], -np.arange(symbols.shape[0]), side="left")
            state = np.repeat(np.array(self.roots, np.int32)[:, None], len(own), axis=1)
            count = np.zeros(state.shape, np.int32)
            for step, n in enumerate(active.tolist()):
                now = symbols[step, :n]
                rare = np.flatnonzero(now >= self.width) if self.total > self.width else ()
                move = self.table.take(state[:, :n] * np.int32(self.width) + (np.where(now < self.width, now, 0) if len(rare) else now))
                if len(rare):
                    key = state[:, rare].astype(np.int64) * self.total + now[rare]
                    found = np.searchsorted(self.rare_keys, key)
                    move[:, rare] = np.where(self.rare_keys[found] == key, self.rare_moves[found], self.first_moves[:, now[rare]])
                count[:, :n] += move & 1
                state[:, :n] = move >> 1
            np.add.at(total, owner[own], count.T + 1)
        return total

    def literals(self, texts: list[str]) -> np.ndarray:
        """The number of symbols of each text that each language's sample does not have."""
        counts = [np.bincount(self._symbols(t.lower()), minlength=self.total) for t in texts]
        return np.array(counts, np.int64).reshape(-1, self.total) @ self.unseen

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and the score."""
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        if at:
            lettered = [texts[i] for i in at]
            cost = self.phrases(lettered) * self.cost + self.literals(lettered) * (LITERAL - self.cost)
            best = cost.argmin(axis=1)
            ranked = np.sort(cost, axis=1)
            sure = ranked[:, 1] / (ranked[:, 0] + ranked[:, 1]) if len(self.langs) > 1 else np.ones(len(at))
            score[at] = sure
            for i, b in zip(at, best.tolist(), strict=True):
                langs[i] = self.langs[b]
        return langs, score


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """The samples, by language name, of the rows that are not held out and have a language and a text."""
    take = SAMPLE_CHARS // SAMPLE_DOCS
    middle = F.substring(F.col(text), F.greatest(F.lit(1), F.floor((F.length(text) - take) / 2).cast("int") + 1), F.lit(take))
    lettered = docs.where(middle.rlike(r"\p{L}"))  # a null text has none
    rows = lettered.select(F.col(key).cast("long").alias("id"), F.col(lang).cast("string").alias("name"), middle.alias("part"))
    train = rows.where(F.col("name").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.xxhash64("id"), "id", "part"))
    found = sorted(tuple(r) for r in train.select("name", "id", "part", rank.alias("nth")).where(F.col("nth") <= SAMPLE_DOCS).select("name", "id", "part").collect())
    samples: dict[str, list[str]] = {}
    for name, _, part in found:
        samples.setdefault(name, []).append(part)
    return tuple((name, " ".join(parts[:SAMPLE_DOCS])) for name, parts in sorted(samples.items()) if any(map(has_letter, parts)))


def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    """The model of these samples, built once in each Python worker."""
    if samples not in _built:
        _built.clear()
        _built[samples] = Model(samples)
    return _built[samples]


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...] | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row."""
    ship(docs.sparkSession)
    samples = fit(docs, key, text, lang) if samples is None else samples

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("language ID")
        model = _model(samples)
        for b in slices(batches, 2000):
            langs, score = model.predict(b.column(2).to_pylist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, samples: tuple[tuple[str, str], ...] | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs whose language is found (not `und`), unchanged."""
    ship(docs.sparkSession)
    samples = fit(docs, key, text, lang) if samples is None else samples
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("language ID")
        model = _model(samples)
        for b in slices(batches, 2000):
            langs, _ = model.predict(utf8(b.column(at)).to_pylist())
            yield b.filter(pa.array([x != "und" for x in langs], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
