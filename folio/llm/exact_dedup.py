"""Exact dedup (two-pass Bloom filtering): only rows whose hash may repeat are shuffled, the rest pass straight through.

Texts are equal when they are identical without the bytes 0x20 and 0x09-0x0D. Pass one sends the filter's bit
positions of each row, packed by segment of the filter, and a segment keeps the positions that at least two rows set.
Pass two tests each row against these: a row with a position that no other row set is unique and passes; all others go by
SHA-256 to their group, of which the row with most code points, then the smallest doc_id, stays. A false positive
only shuffles a unique row in vain; results are exact whatever the filter's size.

The filter has BITS_PER_ROW bits a row, MAX_BITS at most (a documented bound of 32 MB, the only data that reaches the driver
and is broadcast); beyond it more unique rows are shuffled and nothing else changes. A group of copies that holds a third of
all rows is summed in each task before it is shuffled.

Nulls: a null text counts as empty; all texts without other characters are equal. A null doc_id is a row like any
other and stays only if all of its group are null. Rows that repeat a doc_id are rows of the group. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._common import materialize, ship, utf8

BITS_PER_ROW, MAX_BITS, SEGMENT_BITS, HASHES = 16, 1 << 28, 1 << 20, 2


def normalised_digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, n_chars, sha) of each row; n_chars are code points of the text as it is."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(1))
            sha = [hashlib.sha256(t.as_buffer().to_pybytes().translate(None, b" \t\n\x0b\x0c\r")).digest() for t in texts]
            yield pa.record_batch([b.column(0).cast(pa.int64()), pc.utf8_length(texts).cast(pa.int64()), pa.array(sha, pa.binary())], names=["doc_id", "n_chars", "sha"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(digest, "doc_id long, n_chars long, sha binary")


def _positions(sha: pa.Array, bits: int) -> np.ndarray:
    """HASHES filter positions of each SHA-256, from its first bytes."""
    words = np.frombuffer(b"".join(sha.to_pylist()), dtype=">u8").reshape(-1, 4)[:, :HASHES]
    return words.astype(np.uint64) & np.uint64(bits - 1)


def repeated_filter(rows: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bit array of the positions that two or more rows set, and its size in bits."""
    bits = SEGMENT_BITS
    while bits < min(MAX_BITS, BITS_PER_ROW * count):
        bits *= 2

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, times = np.unique(_positions(b.column(0), bits).ravel(), return_counts=True)
            segment = (at // SEGMENT_BITS).astype(np.int64)
            heads = np.flatnonzero(np.diff(segment, prepend=-1))
            low = (at % SEGMENT_BITS).astype("<u4") | ((times > 1).astype("<u4") << np.uint32(31))
            parts = np.split(low, heads[1:])
            yield pa.record_batch([pa.array(segment[heads]), pa.array([p.tobytes() for p in parts], pa.binary())], names=["segment", "body"])

    def add(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
        for body in table["body"].to_pylist():
            low = np.frombuffer(body, "<u4")
            at = low & np.uint32(0x7FFFFFFF)
            twice[at] |= once[at] | (low >> np.uint32(31)).astype(bool)
            once[at] = True
        return pa.table({"segment": table["segment"].slice(0, 1), "body": pa.array([np.packbits(twice).tobytes()], pa.binary())})

    sent = rows.select("sha").mapInArrow(positions, "segment long, body binary")
    filled = np.zeros(bits // 8, np.uint8)
    for segment, body in sent.groupBy("segment").applyInArrow(add, "segment long, body binary").toLocalIterator():
        at = segment * SEGMENT_BITS // 8
        filled[at : at + SEGMENT_BITS // 8] = np.frombuffer(body, np.uint8)
    return filled, bits


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row."""
    spark = docs.sparkSession
    ship(spark)
    rows = materialize(normalised_digests(docs, key, text), "digests")
    filled, bits = repeated_filter(rows, rows.count())
    shared = spark.sparkContext.broadcast(filled)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            at = _positions(b.column(2), bits)
            maybe = ((table[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=1)
            yield pa.record_batch([*b.columns, pa.array(maybe)], names=["doc_id", "n_chars", "sha", "maybe"])

    tested = rows.mapInArrow(test, "doc_id long, n_chars long, sha binary, maybe boolean")
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    alone = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed)
    maybe = tested.where("maybe")
    best = F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("minus"))).alias("best")
    groups = maybe.groupBy("sha").agg(best, F.count(F.lit(1)).alias("group_size")).select("sha", (-F.col("best.minus")).alias("keep_id"), "group_size")
    groups = materialize(groups, "groups")  # both sides of the join are then exchanged, and Spark splits a hot group's rows
    joined = maybe.join(groups, "sha").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), hexed)
    return alone.unionByName(joined)
