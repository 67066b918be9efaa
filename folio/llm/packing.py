"""Best-fit packing (pattern packing by non-negative least squares): documents into sequences of `capacity` tokens.

Documents longer than the capacity are cut into full pieces and a rest; nothing else is cut. The plan needs only the
histogram of piece lengths, `capacity` numbers whatever the size of the corpus.

1. Patterns are multisets of at most DEPTH length classes (of capacity / CLASSES tokens, each counted by its middle) that fill a sequence.
   Those of one and two documents are listed; of all deeper ones the one that would lower what is unfitted most is found by dynamic programming and
   joins, until none would.
2. Repeat counts of the patterns are fitted to the histogram of classes by non-negative least squares, rounded down and held to the supply;
   then those with a large rest are rounded up while classes last. What is left is fitted again, until little more can be placed so.
3. Places of a pattern take the longest and the shortest lengths of their class by turns, so that lengths even out, and the last place takes the
   longest piece that fits: it closes what classes leave.
4. The residual (all pieces without a place) goes longest first into the fullest sequence that has room, or a new one.

The plan is runs of equal placements, (length, how many, first sequence, offset), and their number depends on the lengths,
not on the documents. Pieces are numbered within (length, salt) and moved by the counts before, so a length that a third of
all pieces share is no task's burden; piece number n of a length takes the n-th place planned for it.

Nulls: a null text is empty; each document ends with the id 1, so an empty one has length 1. A null doc_id is a document
like any other. Rows that repeat a doc_id are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm._common import begin, caches, materialize, raw, ship, slices, utf8

CAPACITY, CLASSES, DEPTH = 4096, 128, 24
#: Parts of words whose ids a Python worker keeps: two generations of so many each, the older of which goes when the
#: younger is full (at most about 75 MB in all).
CACHE_PARTS = 200_000
#: Bytes of text whose words are told apart at a time.
SLICE_BYTES = 8 << 20
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_BLANK, _LETTER, _MARK, _OTHER = range(4)
#: What a byte is: < may begin a special token and ' a contraction, so they are no marks.
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[list(b" \t\n\x0b\x0c\r")] = _BLANK
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _LETTER
_KIND[list(b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~")] = _MARK
#: Second bytes, after C3, of the letters of Latin-1; of the capitals among them and of A to Z, what makes them small.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_SMALL = np.zeros(256, np.uint8)
_SMALL[0x41:0x5B] = 32
_SMALL[0x80:0x9F] = 32


def word_parts(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The parts of the words of texts (UTF-8 data; text k is data[offs[k]:offs[k + 1]], offs from 0), and at which part each
    text begins and the last ends. A word of nothing but letters of Latin-1 and ASCII marks is cut where these meet, as the
    tokenizer cuts it, and made small; any other word (digits, apostrophes, other scripts) is one part, unchanged."""
    kind = _KIND[data]
    leads = np.flatnonzero(data[:-1] == 0xC3)
    leads = leads[_SECOND[data[leads + 1]]]
    kind[leads] = kind[leads + 1] = _LETTER
    inside = kind != _BLANK
    fresh = np.zeros(len(data) + 1, bool)  # a text begins
    fresh[offs] = True
    fresh = fresh[:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:]
    words = np.flatnonzero(begins)
    if not len(words):
        return pa.array([], pa.binary()), np.zeros(len(offs), np.int64)
    data, kind, begins = data[inside], kind[inside], begins[inside]
    firsts = np.flatnonzero(begins)
    other = np.repeat(np.maximum.reduceat(kind, firsts) == _OTHER, np.diff(firsts, append=len(data)))
    data = np.where(other | (kind != _LETTER), data, data + _SMALL[data])
    begins[1:] |= (kind[1:] != kind[:-1]) & ~other[1:]
    starts = np.flatnonzero(begins)
    parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)])
    return parts, np.append(np.searchsorted(starts, firsts), len(starts))[np.searchsorted(words, offs)]


class WordIds:
    """Ids of words. The tokenizer drops white space and never joins across it, nor between letters and marks, so
    parts of words are encoded once each. Runs of letters go to its merges at once; all else goes its whole way."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def part(self, part: bytes) -> bytes:
        """The ids of a part that is not among the younger generation."""
        found = self.old.get(part)
        if found is None:
            text = part.decode()
            if part.isalpha():  # letters of ASCII only
                ids = [t.id for t in self.merges.tokenize(text)]
            elif _LETTERS.fullmatch(text):
                ids = [t.id for t in self.merges.tokenize(text.translate(self.table))]
            else:
                ids = self.whole.encode(text, add_special_tokens=False).ids
            found = array("I", ids).tobytes()
        if len(self.young) >= CACHE_PARTS:
            self.young, self.old = {}, self.young
        self.young[part] = found
        return found

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """Of each of a few texts the ids as native unsigned 32-bit numbers."""
        data, offs = raw(texts)
        parts, ends = word_parts(data[offs[0] : offs[-1]], offs - offs[0])
        parts = parts.dictionary_encode()
        found = [self.young.get(p) or self.part(p) for p in parts.dictionary.to_pylist()]
        flat = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        index = parts.indices.to_numpy()
        n = sizes[index]
        before = np.append(0, np.cumsum(n))
        ids = flat[np.repeat(starts[index] - before[:-1], n) + np.arange(before[-1])]
        for low, high in zip(before[ends[:-1]].tolist(), before[ends[1:]].tolist(), strict=True):
            yield ids[low:high].tobytes()


@cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


caches("packing", _word_ids.cache_clear)


def word_ids(texts: pa.Array, path: str) -> Iterator[bytes]:
    """Of each text (large_string) the ids as native unsigned 32-bit numbers, by slices of about SLICE_BYTES."""
    ids = _word_ids(path)
    _, offs = raw(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offs, offs[low] + SLICE_BYTES, side="right")) - 1)
        yield from ids.texts(texts.slice(low, high - low))
        low = high


def pieces(docs: DataFrame, tokenizer: str, capacity: int, key: str, text: str, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's pieces."""
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing")
        for b in slices(batches, 2000):
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), word_ids(utf8(b.column(1)), tokenizer), strict=True):
                ids += last
                rows += [(doc, i // (4 * capacity), i // 4, len(p := ids[i : i + 4 * capacity]) // 4, zlib.crc32(p)) for i in range(0, len(ids), 4 * capacity)]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active set method of Lawson and Hanson, from x on (0 where it has no entry)."""
    n = a.shape[1]
    x = np.zeros(n) if x is None else np.append(x, np.zeros(n - len(x)))
    active = x > 0
    limit = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * n):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        at = int(np.argmax(gain))
        if gain[at] <= limit:
            break
        active[at] = True
        while True:
            cols = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[cols] = s
                break
            low = s <= 0
            step = (x[cols][low] / np.maximum(x[cols][low] - s[low], 1e-300)).min()
            x[cols] += step * (s - x[cols])
            active[cols[x[cols] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def best_pattern(worth: np.ndarray, depth: int) -> np.ndarray | None:
    """Of all patterns of at most `depth` documents that fill a sequence, how many of each class the one with the largest sum of worths has;
    None where none has a sum above 0. A class k (from 1) counts with its middle, 2 k - 1 half widths."""
    classes = len(worth)
    full, size = 2 * classes, 2 * np.arange(1, classes + 1) - 1
    best = np.full((full + 1, depth + 1), -np.inf)  # by what is filled and by documents at most
    best[0] = 0
    came = np.zeros((full + 1, depth + 1), np.int32)
    for u in range(1, full + 1):
        fits = size[size <= u]
        sums = best[u - fits, :-1] + worth[: len(fits), None]
        at = sums.argmax(axis=0)
        came[u, 1:] = at
        best[u, 1:] = sums[at, np.arange(depth)]
    if not best[full, depth] > 0:
        return None
    out, u, d = np.zeros(classes), full, depth
    while u:
        k = came[u, d]
        out[k] += 1
        u, d = u - int(size[k]), d - 1
    return out


def fitted(have: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often each is wanted, fitted to the histogram of classes by non-negative least squares.

    All patterns of one or two documents are enumerated; deeper ones join in the order in which they would lower the rest most, until none would."""
    classes = len(have)
    columns = [np.bincount([k, classes - 1 - k], minlength=classes).astype(float) for k in range((classes + 1) // 2)]  # middles of k and its mirror fill a sequence
    x = np.zeros(0)
    scale = max(1.0, float(have.max(initial=0)))
    for _ in range(3 * classes):
        a = np.array(columns).T
        x = nnls(a, have, x)
        new = best_pattern(have - a @ x, depth)
        if new is None or (new @ (have - a @ x)) <= 1e-6 * scale or any((new == c).all() for c in columns):
            break
        used = np.flatnonzero(x > 0)
        columns, x = [*(columns[i] for i in used), new], x[used]
    return np.array(columns).T, np.append(x, np.zeros(len(columns) - len(x)))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH) -> tuple[np.ndarray, int, int]:
    """Runs (length, place of the first among its length, how many, first sequence, offset) sorted by length and place,
    the number of sequences, and how many pieces patterns have placed."""
    left = {n: c for n, c in histogram.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    runs: list[tuple[int, int, int, int, int]] = []
    placed = dict.fromkeys(left, 0)
    bins = 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, placed[length], count, first, offset))
        placed[length] += count
        left[length] -= count

    if left:  # full sequences need no plan
        if full := left.get(capacity, 0):
            place(capacity, full, 0, 0)
            bins = full
    width = capacity / classes
    of = lambda n: int(-(-n // width)) - 1
    stock = sorted(n for n in left if left[n])
    by_class: list[list[int]] = [[] for _ in range(classes)]
    for n in stock:
        by_class[of(n)].append(n)
    have = np.array([sum(left[n] for n in ns) for ns in by_class], float)
    spare: dict[int, list[tuple[int, int]]] = {}  # room -> groups (first sequence, count)
    rooms: list[int] = []

    def open_up(room: int, first: int, count: int) -> None:
        if not count or not room:
            return
        if room not in spare:
            insort(rooms, room)
            spare[room] = []
        spare[room].append((first, count))

    supply = have.astype(np.int64)  # of each class, less what patterns have taken

    def fill(shape: list[int], times: int) -> None:
        """Opens `times` sequences of a pattern's classes, the largest first. Places take the longest and the shortest of their class by turns,
        so that lengths even out; the last one takes the longest piece that fits."""
        nonlocal bins
        groups = [(bins, times, 0)]
        bins += times
        for nth, c in enumerate(shape[:-1]):
            after = []
            for first, count, used in groups:
                while count:
                    end = -1 if nth % 2 == 0 else 0
                    n = by_class[c][end]
                    take = min(count, left[n]) if used + n <= capacity else 0
                    if not take:
                        after.append((first, count, used))
                        break
                    place(n, take, first, used)
                    supply[c] -= take
                    after.append((first, take, used + n))
                    first, count = first + take, count - take
                    if not left[n]:
                        by_class[c].pop(end)
                        stock.pop(bisect_left(stock, n))
            groups = after
        for first, count, used in groups:
            while count and used < capacity:
                at = bisect_right(stock, capacity - used) - 1
                while at >= 0 and not supply[of(stock[at])]:
                    at -= 1
                if at < 0:
                    break
                n = stock[at]
                take = int(min(count, left[n], supply[of(n)]))
                place(n, take, first, used)
                supply[of(n)] -= take
                open_up(capacity - used - n, first, take)
                first, count = first + take, count - take
                if not left[n]:
                    by_class[of(n)].remove(n)
                    stock.pop(at)
            open_up(capacity - used, first, count)

    while supply.any():  # what rounding leaves is fitted again, until nothing more can be placed so
        before = supply.sum()
        a, x = fitted(supply.astype(float), depth)
        shapes = [sorted(np.repeat(np.arange(classes), a[:, k].astype(int)).tolist(), reverse=True) for k in range(a.shape[1])]
        whole = np.floor(x + 1e-9)
        for repeats in (whole, (x - whole > 0.25).astype(float)):  # whole repeats, then those rounded up while the classes last
            for k in sorted(np.flatnonzero(repeats), key=lambda k: (-repeats[k], whole[k] - x[k], shapes[k])):
                times = min([int(repeats[k]), *(int(supply[c]) // shapes[k].count(c) for c in set(shapes[k]))])
                if times > 0:
                    fill(shapes[k], times)
        if supply.sum() > 0.9 * before:
            break
    by_pattern = sum(placed.values())
    for n in sorted(left, reverse=True):
        while left[n]:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                first, count = spare[room].pop()
                if not spare[room]:
                    del spare[room]
                    rooms.pop(at)
                take = min(count, left[n])
                place(n, take, first, capacity - room)
                open_up(room, first + take, count - take)
                open_up(room - n, first, take)
            else:
                per = capacity // n
                count = -(-left[n] // per)
                place(n, min(count, left[n]), bins, 0)
                open_up(capacity - n, bins, count)
                bins += count
    runs.sort()
    return np.array(runs, np.int64).reshape(-1, 5), bins, by_pattern


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", salts: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece."""
    spark = docs.sparkSession
    ship(spark)
    cut = materialize(pieces(docs, tokenizer, capacity, key, text), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _, _ = plan(histogram, capacity)
    shared = spark.sparkContext.broadcast(runs)
    salts = salts or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), sum(histogram.values()) // 500_000)  # no part of a length passes that
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    nth = salted.select("*", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).alias("nth"))
    counts = salted.groupBy("length", "salt").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("length", "salt", before.alias("before"))
    ranked = nth.join(offsets, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).cast("long").alias("place"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 44) | table[:, 1]
        for b in batches:
            length, nth = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(keys, (length << 44) | nth, side="right") - 1
            sequence = table[at, 3] + nth - table[at, 1]
            yield pa.record_batch([*b.columns[:5], pa.array(sequence), pa.array(table[at, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
