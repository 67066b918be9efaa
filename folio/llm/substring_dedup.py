"""Substring dedup (fixed-block anchors): removes every later copy of a passage of at least `window` words.

A word is a maximal run of bytes other than space and 0x09-0x0D. Blocks of `block` = (window + 1) // 2 words at word
0, block, 2 * block, ... of each document are the index; every rolling window of `block` words probes it. Any
`window` words hold one whole aligned block, so a passage that occurs twice has a hit in both places. Hits are
extended: each `window`-word window that holds a hit is compared, by a 96-bit hash, with all such windows, and all but
the first (smaller doc_id, or earlier in the same document) are repeats; the union of the repeats' words is the
maximal exact repeat, and goes.

Layout: documents are dealt to ranges of doc_id, so that "earlier" between ranges is the order of range numbers. A range
sends each hash bucket one packed, sorted array of its distinct hashes (32 bits, then 96) and gets one bit for each
back. So a passage that a third of all rows share costs one entry a range, texts move once, and no candidate pairs
are made. A bucket or range holds a share of the input that does not grow with it.

Nulls: a null text has no words and stays null; a null doc_id counts as the last. Rows that repeat a doc_id are taken
in the order of their text. Empty tables give empty results. Other columns pass through unchanged.
Hashes are polynomials mod 2**64 over mixed word hashes; for two different windows to be confused both of two
independent ones must agree (96 bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm._common import begin, caches, parallelism, range_bounds, range_group, raw, ship, utf8

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers (so that they have an inverse mod 2**64): for bytes in a word, for words in a window, twice.
_BASE, _ROLL, _ROLL2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_SLICE = 2 << 20
_powers: dict[int, np.ndarray] = {}
caches("substring dedup", _powers.clear)


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) mod 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        got = _powers[base] = np.cumprod(steps)
    return got[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _spans(cut: np.ndarray, base: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values [lo, hi) given all values: sums of value * base ** index, moved to index 0."""
    n = len(cut)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(cut * _power(base, n), out=total[1:])
    return (total[hi] - total[lo]) * _power(_inverse(base), n + 1)[lo]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and the index of each text's first word (n + 1 numbers)."""
    data, offs = raw(texts)
    n, parts, firsts, seen, at = len(texts), [], [np.zeros(1, np.int64)], 0, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + _SLICE, side="right")) - 1)
        buf, rel = data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        size = len(buf)
        if size:
            word = ~_SPACE[buf]
            edge = np.zeros(size + 1, bool)
            edge[rel] = True
            start = word.copy()
            start[1:] &= ~word[:-1] | edge[1:-1]
            end = word.copy()
            end[:-1] &= ~word[1:] | edge[1:-1]
            lo, hi = np.flatnonzero(start), np.flatnonzero(end) + 1
            parts.append(_mix(_spans(_BYTES[buf], _BASE, lo, hi) ^ ((hi - lo).astype(np.uint64) * np.uint64(_ROLL2))))
        else:
            lo = np.zeros(0, np.int64)
        firsts.append(np.searchsorted(lo, rel[1:]) + seen)
        seen += len(lo)
        at = to
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(firsts).astype(np.int64)


class _Group:
    """The documents of a range in order, with their words' hashes."""

    def __init__(self, table: pa.Table, key: str, text: str, window: int, bits: int):
        self.window, self.block, self.bits = window, (window + 1) // 2, bits
        self.table = table.take(pc.sort_indices(table, [(key, "ascending"), (text, "ascending")], null_placement="at_end"))
        self.texts = utf8(self.table[text])
        self.words, self.first = word_hashes(self.texts)
        n = len(self.words)
        counts = np.diff(self.first)
        self.start, self.end = np.repeat(self.first[:-1], counts), np.repeat(self.first[1:], counts)
        self.at = np.arange(n)

    def _rolling(self, k: int, base: int, where: np.ndarray) -> np.ndarray:
        return _mix(_spans(self.words, base, where, where + k))

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all rolling windows of `block` words: where they start and their hashes of bits + 32 bits; of the
        distinct hashes, sorted: the hash, if an index block has it, if it occurs twice here."""
        where = self.at[self.at + self.block <= self.end]
        top = self._rolling(self.block, _ROLL, where) >> np.uint64(32 - self.bits)
        anchor = (where - self.start[where]) % self.block == 0
        run = np.sort(top << np.uint64(1) | anchor.astype(np.uint64))
        value = run >> np.uint64(1)
        last = np.ones(len(run), bool)
        last[:-1] = value[1:] != value[:-1]
        ends = np.flatnonzero(last)
        return where, top, value[ends], (run[ends] & np.uint64(1)).astype(bool), np.diff(ends, prepend=-1) > 1

    def candidates(self, repeated: np.ndarray, where: np.ndarray, top: np.ndarray) -> np.ndarray:
        """A bit for each word: a window starts there and holds a hit."""
        hit = np.zeros(len(self.words) + self.window + 1, np.int32)
        if len(repeated):
            at = np.minimum(np.searchsorted(repeated, top), len(repeated) - 1)
            hit[where + 1] = repeated[at] == top
        total = np.cumsum(hit)
        n, reach = len(self.words), self.window - self.block + 1
        return (total[reach : reach + n] > total[:n]) & (self.at + self.window <= self.end)

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows that start there: the order by hash and place, the hashes in that order (64 and 32 bits), and
        if each is the first of its hash here."""
        x, y = self._rolling(self.window, _ROLL, starts), (self._rolling(self.window, _ROLL2, starts) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        head = np.ones(len(x), bool)
        head[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        return order, x, y, head


_TO_BUCKET = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("grp", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("body", T.BinaryType())])
_TO_GROUP = T.StructType([T.StructField("grp", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("body", T.BinaryType())])
_BUCKET_ARROW = pa.schema([("bucket", pa.int64()), ("grp", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
_GROUP_ARROW = pa.schema([("grp", pa.int32()), ("bucket", pa.int64()), ("n", pa.int32()), ("body", pa.binary())])


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _replies(table: pa.Table) -> dict[int, tuple[int, bytes]]:
    return {b: (n, body) for b, n, body in zip(*(table[c].to_pylist() for c in ("bucket", "n", "body")), strict=True)}


def _flags(replies: dict[int, tuple[int, bytes]], buckets: np.ndarray) -> np.ndarray:
    """The bits that came back, in the order of the sorted hashes that were sent."""
    return np.concatenate([np.zeros(0, bool), *(_unbits(replies[b][1], replies[b][0]) for b in np.unique(buckets).tolist())])


def mark(docs: DataFrame, key: str, text: str, window: int = 20, per_group=None, schema: T.StructType | None = None) -> DataFrame:
    """Applies per_group(table of a range's documents in order, its texts, first word of each, bool array: word goes)
    -> pa.Table of `schema` to each range of documents. Documents are whole rows of docs."""
    spark = docs.sparkSession
    ship(spark)
    if window < 2:
        raise ValueError("window must be at least 2 words")
    groups = parallelism(docs)
    bounds = range_bounds(docs, key, groups)
    bits = max(1, (max(len(bounds), 1) - 1).bit_length())
    inner = [f"c{i}" for i in range(len(docs.columns))]
    names = list(docs.columns)
    k, t = inner[names.index(key)], inner[names.index(text)]
    dealt = docs.toDF(*inner).withColumn("grp", range_group(bounds, F.col(k)))

    def group(table: pa.Table) -> tuple[int, _Group]:
        begin("substring dedup")
        return table["grp"][0].as_py(), _Group(table.drop_columns(["grp"]), k, t, window, bits)

    def probe(table: pa.Table) -> pa.Table:
        g, own = group(table)
        _, _, value, anchor, twice = own.probes()
        bucket = (value >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        low = (value & np.uint64(0xFFFFFFFF)).astype("<u4")
        rows = [(b, g, j - i, low[i:j].tobytes() + _bits(anchor[i:j]) + _bits(twice[i:j])) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if j > i]
        return _rows(_BUCKET_ARROW, rows)

    def look_up(table: pa.Table) -> pa.Table:
        sent = list(zip(*(table[c].to_pylist() for c in ("bucket", "grp", "n", "body")), strict=True))
        low, anchor, times = [], [], []
        for _, _, n, body in sent:
            size = -(-n // 8)
            low.append(np.frombuffer(body, "<u4", n))
            anchor.append(_unbits(body[4 * n : 4 * n + size], n))
            times.append(1 + _unbits(body[4 * n + size :], n))
        _, back = np.unique(np.concatenate(low), return_inverse=True)
        indexed = np.bincount(back, np.concatenate(anchor)) > 0
        repeated = (indexed & (np.bincount(back, np.concatenate(times)) > 1))[back]
        cut = np.cumsum([0, *(s[2] for s in sent)])
        return _rows(_GROUP_ARROW, [(g, b, n, _bits(repeated[i : i + n])) for (b, g, n, _), i in zip(sent, cut[:-1].tolist(), strict=True)])

    def extend(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows(_BUCKET_ARROW, [])
        g, own = group(docs)
        where, top, value, _, _ = own.probes()
        hot = value[_flags(_replies(replies), (value >> np.uint64(32)).astype(np.int64))] if len(value) else value
        mask = own.candidates(hot, where, top)
        _, x, y, head = own.windows(np.flatnonzero(mask))
        x, y = x[head], y[head]
        bucket = (x >> np.uint64(64 - bits)).astype(np.int64)
        cut = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        rows = [(b, g, j - i, x[i:j].astype("<u8").tobytes() + y[i:j].astype("<u4").tobytes()) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if j > i]
        return _rows(_BUCKET_ARROW, [*rows, (-1 - g, g, len(mask), _bits(mask))])  # the last comes back as it is

    def first_of(table: pa.Table) -> pa.Table:
        sent = sorted(zip(*(table[c].to_pylist() for c in ("bucket", "grp", "n", "body")), strict=True), key=lambda s: s[1])
        if sent[0][0] < 0:
            return _rows(_GROUP_ARROW, [(g, b, n, body) for b, g, n, body in sent])
        x = np.concatenate([np.frombuffer(body, "<u8", n) for _, _, n, body in sent])
        y = np.concatenate([np.frombuffer(body, "<u4", n, 8 * n) for _, _, n, body in sent])
        order = np.lexsort((y, x))
        head = np.ones(len(x), bool)
        head[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
        first = np.zeros(len(x), bool)
        first[order] = head
        cut = np.cumsum([0, *(s[2] for s in sent)])
        return _rows(_GROUP_ARROW, [(g, b, n, _bits(first[i : i + n])) for (b, g, n, _), i in zip(sent, cut[:-1].tolist(), strict=True)])

    def finish(docs: pa.Table, replies: pa.Table) -> pa.Table:
        g, own = group(docs)
        got = _replies(replies)
        n, body = got[-1 - g]
        starts = np.flatnonzero(_unbits(body, n))
        order, x, _, head = own.windows(starts)
        again = np.ones(len(starts), bool)
        heads = np.flatnonzero(head)
        first = _flags(got, (x[heads] >> np.uint64(64 - bits)).astype(np.int64))
        again[order[heads[first]]] = False
        depth = np.zeros(len(own.words) + 1, np.int64)
        np.add.at(depth, starts[again], 1)
        np.subtract.at(depth, starts[again] + window, 1)
        goes = np.cumsum(depth)[:-1] > 0
        return per_group(own.table.rename_columns(names), own.texts, own.first, goes)

    asked = dealt.groupBy("grp").applyInArrow(probe, _TO_BUCKET)
    told = asked.groupBy("bucket").applyInArrow(look_up, _TO_GROUP)
    asked = dealt.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(extend, _TO_BUCKET)
    told = asked.groupBy("bucket").applyInArrow(first_of, _TO_GROUP)
    return dealt.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(finish, schema)


def _kept(texts: pa.Array, first: np.ndarray, goes: np.ndarray) -> Iterator[tuple[int, int, bytes | None]]:
    """Of each text: its words, those that go, and what is left joined by spaces (None where it had no word)."""
    total = np.concatenate([[0], np.cumsum(goes)])
    for i, value in enumerate(texts):
        lo, hi = int(first[i]), int(first[i + 1])
        gone = int(total[hi] - total[lo])
        words = value.as_buffer().to_pybytes().split()
        if gone:
            words = [words[j] for j in np.flatnonzero(~goes[lo:hi]).tolist()]
        yield hi - lo, gone, b" ".join(words)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row: the words that stay, joined by one space, as SHA-256."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def per_group(table: pa.Table, texts: pa.Array, first: np.ndarray, goes: np.ndarray) -> pa.Table:
        n, gone, sha = [], [], []
        for a, b, left in _kept(texts, first, goes):
            n.append(a)
            gone.append(b)
            sha.append(hashlib.sha256(left).hexdigest())
        return pa.table({"doc_id": table[key].cast(pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return mark(docs.select(key, text), key, text, window, per_group, schema)


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """docs with the later copies of repeated passages taken out of `text`. A text that loses nothing is unchanged; one
    that loses words keeps the others joined by one space. Columns and rows are those of docs; n_chars, if there is
    one, stays the length of the text."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def per_group(table: pa.Table, texts: pa.Array, first: np.ndarray, goes: np.ndarray) -> pa.Table:
        old, new = table[text].to_pylist(), []
        for value, (_, gone, left) in zip(old, _kept(texts, first, goes), strict=True):
            new.append(left.decode() if gone else value)
        return table.set_column(table.column_names.index(text), text, pa.array(new, pa.string()))

    out = mark(docs, key, text, window, per_group, schema)
    if "n_chars" in docs.columns and docs.schema["n_chars"].dataType in (T.LongType(), T.IntegerType()):
        out = out.withColumn("n_chars", F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out
