"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprint: ASCII letters lower-cased, words split at the bytes 0x20 and 0x09-0x0D, shingles of 3 words joined by a space,
repeats included; a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42). Fewer than 3 words make one
shingle, none the fingerprint 0.

Links: two fingerprints at 3 or fewer differing bits. The 64 bits are three segments (22, 21, 21 bits), each padded to a
23-bit word of the perfect binary Golay code, where every word decodes to just one of 4,096 codewords. Of 3 errors at most, two
segments have 1 each at most (pigeonhole). The codewords near a segment are those that it and its one-bit
neighbours decode to: 1 to 6 of them. So for each pair of segments a fingerprint is filed under its own two codewords, and
looks up all pairs of near codewords; every link is met there, and met candidates are verified by counting bits.

Only distinct fingerprints are filed, so copies cost nothing. Equal keys are sorted together and compared in blocks;
what leaves a task is a forest of the links it found, never all pairs of a group. Components come from distributed
union-find. Nulls: a null text has no words; a null doc_id is a member that never names a component unless all are
null. Rows that repeat a doc_id are members of their own. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._common import begin, caches, connected_components, materialize, numbered, ship, utf8

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
LIMIT = 3
#: Comparisons that one numpy call makes.
_BLOCK = 1 << 21
_decoder: list[np.ndarray] = []
caches("simhash", _decoder.clear)


def fingerprint(text: bytes, size: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= size:
        bounds = [(0, len(whole))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        bounds = list(zip([0, *ends[: -size].tolist()], (ends[size - 1 :] - 1).tolist(), strict=True))
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for i in range(0, len(bounds), 1 << 16):
        part = b"".join([digest(whole[a:b], 42) for a, b in bounds[i : i + (1 << 16)]])
        total += np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > len(bounds)).tobytes(), "big")


def decoder() -> np.ndarray:
    """Of each 23-bit word the index of its codeword in the perfect binary Golay code."""
    if not _decoder:
        generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
        words = np.zeros(4096, np.uint32)
        for bit in range(12):
            words ^= np.where(np.arange(4096) >> bit & 1, np.uint32(generator << bit), np.uint32(0)).astype(np.uint32)
        ones = [1 << i for i in range(23)]
        errors = [0, *ones, *(a | b for a in ones for b in ones if a < b), *(a | b | c for a in ones for b in ones if a < b for c in ones if b < c)]
        table = np.full(1 << 23, -1, np.int16)
        index = np.arange(4096, dtype=np.int16)
        for e in errors:
            table[words ^ np.uint32(e)] = index
        _decoder.append(table)
    return _decoder[0]


def _near(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment: own codeword of each fingerprint; all near codewords (n x (bits + 1), sorted, repeats as -1)."""
    table, out = decoder(), []
    for low, bits in SEGMENTS:
        part = (prints >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.uint32)
        flips = np.array([0, *(1 << i for i in range(bits))], np.uint32)
        near = table[part[:, None] ^ flips]
        own = near[:, 0].astype(np.int64)
        near = np.sort(near, axis=1).astype(np.int64)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        out.append((own, near))
    return out


def fuzzy_keys(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair of segments: row numbers, keys (pair, codeword, codeword), if the row is filed there."""
    near = _near(prints)
    for pair, (i, j) in enumerate(PAIRS):
        (own_i, near_i), (own_j, near_j) = near[i], near[j]
        row_i, at_i = np.nonzero(near_i >= 0)
        count = (near_j >= 0).sum(axis=1)
        list_j = near_j[near_j >= 0]
        start = np.cumsum(count) - count
        times = count[row_i]
        row = np.repeat(row_i, times)
        first = np.repeat(near_i[row_i, at_i], times)
        step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        second = list_j[start[row] + step]
        yield row, pair << 24 | first << 12 | second, (first == own_i[row]) & (second == own_j[row])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, root of x) that join what links (a, b) join, one for each x that is no root."""
    names, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = back[: len(a)], back[len(a) :]
    root = np.arange(len(names))
    while True:
        x, y = root[i], root[j]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def _links(key: np.ndarray, prints: np.ndarray, filed: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the verified links among rows whose equal keys stand together."""
    order = np.lexsort((~filed, key))
    key, prints, filed = key[order], prints[order], filed[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    group = np.cumsum(head) - 1
    size = np.bincount(group)
    start = np.flatnonzero(head)
    index = np.flatnonzero(filed & (size[group] > 1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    reach = size[group[index]]
    done = np.concatenate([[0], np.cumsum(reach)])
    at = 0
    while at < len(index):
        to = max(at + 1, int(np.searchsorted(done, done[at] + _BLOCK, side="right")) - 1)
        times = reach[at:to]
        a = np.repeat(index[at:to], times)
        b = np.repeat(start[group[index[at:to]]] - (done[at:to] - done[at]), times) + np.arange(len(a))
        ok = (prints[a] != prints[b]) & (np.bitwise_count(prints[a] ^ prints[b]) <= limit)
        if ok.any():
            found.append(forest(prints[a[ok]], prints[b[ok]]))
            if len(found) > 16:
                found = [forest(*(np.concatenate(x) for x in zip(*found, strict=True)))]
        at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(*(np.concatenate(x) for x in zip(*found, strict=True)))


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): links between the distinct longs of column fp that connect all that differ in at most `limit` (3) bits."""
    ship(prints.sparkSession)
    if not 0 <= limit <= LIMIT:
        raise ValueError("the segments find at most 3 differing bits")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for b in batches:
            all_of = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_of), 2000):
                fp = all_of[at : at + 2000]
                for row, key, filed in fuzzy_keys(fp):
                    yield pa.record_batch([pa.array(key.astype(np.int32)), pa.array(fp[row].view(np.int64)), pa.array(filed)], names=["key", "fp", "filed"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def emit(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            a, b = _links(rows[0], rows[1].view(np.uint64), rows[2], limit)
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held.append(rows)
            n += len(rows[0])
            if n < 200_000 or rows[0][0] == rows[0][-1]:
                continue
            whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last key may go on
            yield from emit(tuple(x[:cut] for x in whole))
            held, n = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
        if n:
            yield from emit(tuple(np.concatenate(x) for x in zip(*held, strict=True)))

    keyed = prints.select("fp").mapInArrow(file, "key int, fp long, filed boolean")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def fingerprints(docs: DataFrame, key: str, text: str, size: int = 3) -> DataFrame:
    """(doc_id, fp) of each row; fp has the fingerprint's bits as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), size) for t in utf8(b.column(1))), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(hashed, "doc_id long, fp long")


def simhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row; component_id is the smallest doc_id that links reach."""
    spark = docs.sparkSession
    ship(spark)
    rows = materialize(fingerprints(docs, key, text, size), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(links(distinct, limit), "a", "b").select(F.col("node").alias("fp"), "root")
    named = roots.join(distinct, "fp")
    names = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    groups = distinct.join(names, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    groups = materialize(groups, "groups")  # both sides of the join are then exchanged, and Spark splits a hot group's rows
    return rows.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, limit: int = LIMIT) -> DataFrame:
    """One row of each component: of the smallest doc_id, where rows repeat it the first by hash of the text and running number.
    Rows with a null doc_id stay."""
    ship(docs.sparkSession)
    inner = [f"c{i}" for i in range(len(docs.columns))]
    k, t = inner[docs.columns.index(key)], inner[docs.columns.index(text)]
    rows = numbered(docs.toDF(*inner), "row", t)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_buffer().to_pybytes(), size) for x in utf8(b.column(2))), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["row", "doc_id", "fp"])

    known = rows.where(F.col(k).isNotNull()).select("row", F.col(k).cast("long").alias("doc_id"), F.col(t))
    prints = materialize(known.mapInArrow(hashed, "row struct<text: long, n: long>, doc_id long, fp long"), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("first")), "distinct")
    roots = connected_components(links(distinct, limit), "a", "b").select(F.col("node").alias("fp"), "root")
    stays = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    gone = prints.join(stays.select(F.col("first.row").alias("row")), "row", "left_anti").select("row")
    return rows.join(gone, "row", "left_anti").select(*(F.col(c).alias(n) for c, n in zip(inner, docs.columns, strict=True)))
