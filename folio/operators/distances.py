"""Edit distances of all pairs of heads and starts of texts, exactly: a column of the distance matrix is a few 64-bit words for each text (Myers, Hyyrö),
and a step of it is one numpy operation for ROWS texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.session import ship

#: Texts and heads that meet at once.
ROWS, HEADS = 2048, 32
_NULL = np.iinfo(np.int64).min
_ONE, _TOP = np.uint64(1), np.uint64(63)


def starts(cells: np.ndarray, sizes: np.ndarray, head: str) -> np.ndarray:
    """The distance of an ASCII head to the first len(head) characters of each text; cells has a row for each place and a column for each text."""
    m, n = len(head), len(sizes)
    if not m:
        return np.zeros(n, np.int64)
    within = np.minimum(sizes, m)
    w = -(-m // 64)
    peq = np.zeros((w, 256), np.uint64)
    for i, c in enumerate(head.encode("ascii")):
        peq[i // 64, c] |= _ONE << np.uint64(i % 64)
    pv, mv = np.full((w, n), ~np.uint64(0)), np.zeros((w, n), np.uint64)
    score = np.full(n, m, np.int64)
    a, xv, xh, ph = (np.empty(n, np.uint64) for _ in range(4))
    last = np.uint64((m - 1) % 64)
    steps = int(within.max(initial=0))
    least = int(within.min(initial=0))
    for j in range(steps):
        plus, minus = None, None  # what comes in from the word above; above all it is one more
        for k in range(w):
            eq = peq[k][cells[j]]
            p, q = pv[k], mv[k]
            np.bitwise_or(eq, q, out=xv)
            if minus is not None:
                np.bitwise_or(eq, minus, out=eq)
            np.bitwise_and(eq, p, out=xh)
            np.add(xh, p, out=xh)
            np.bitwise_xor(xh, p, out=xh)
            np.bitwise_or(xh, eq, out=xh)
            np.bitwise_or(xh, p, out=ph)
            np.bitwise_not(ph, out=ph)
            np.bitwise_or(ph, q, out=ph)
            np.bitwise_and(xh, p, out=xh)  # now what goes down
            at = last if k == w - 1 else _TOP
            out_plus, out_minus = (ph >> at) & _ONE, (xh >> at) & _ONE
            np.left_shift(ph, _ONE, out=ph)
            np.left_shift(xh, _ONE, out=xh)
            np.bitwise_or(ph, _ONE if plus is None else plus, out=ph)
            if minus is not None:
                np.bitwise_or(xh, minus, out=xh)
            np.bitwise_or(xv, ph, out=a)
            np.bitwise_not(a, out=a)
            np.bitwise_or(a, xh, out=p)
            np.bitwise_and(ph, xv, out=q)
            plus, minus = out_plus, out_minus
        change = plus.astype(np.int64) - minus.astype(np.int64)
        score += change if j < least else np.where(j < within, change, 0)
    return score


def head_distances(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, item_id, d, n) of all pairs of docs (doc_id, plain) and heads (item_id, head), both of ASCII characters: the distance d of a head of n characters to
    as many at the start of a text; null where either is."""
    ship(docs.sparkSession)
    width = heads.agg(F.max(F.length("head"))).head()[0] or 0
    packed = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("cells", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, ROWS):
                part = b.slice(begin, ROWS)
                sizes = pc.fill_null(pc.binary_length(part.column(1)), -1).to_numpy().astype(np.int32)
                cells = np.zeros((len(sizes), width), np.uint8)
                for i, t in enumerate(part.column(1).to_pylist()):
                    if t:
                        cells[i, : len(t)] = np.frombuffer(t.encode("ascii"), np.uint8)
                ids = pc.fill_null(part.column(0), _NULL).to_numpy()
                columns = [ids.tobytes(), sizes.tobytes(), np.ascontiguousarray(cells.T).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], names=packed.names)

    found = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("d", T.IntegerType()), T.StructField("n", T.IntegerType())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, sizes = np.frombuffer(b.column(0)[i].as_buffer(), np.int64), np.frombuffer(b.column(1)[i].as_buffer(), np.int32)
                cells = np.frombuffer(b.column(2)[i].as_buffer(), np.uint8).reshape(width, len(ids))
                for x in b.column(3)[i].as_py():
                    head, n = x["head"], len(ids)
                    d = starts(cells, sizes, head or "")
                    columns = [pa.array(ids, mask=ids == _NULL), pa.array([x["item_id"]] * n, pa.int64()), pa.array(d.astype(np.int32), mask=(sizes < 0) | (head is None)), pa.array([None if head is None else len(head)] * n, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=found.names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring("plain", 1, width).alias("plain")).mapInArrow(pack, packed)
    asked = heads.select(F.col("item_id").cast("long").alias("item_id"), "head", F.pmod(F.xxhash64("item_id"), F.lit(-(-heads.count() // HEADS) or 1)).alias("block"))
    asked = asked.groupBy("block").agg(F.collect_list(F.struct("item_id", "head")).alias("heads")).select("heads")
    # dealt out anew: a file may hold many texts that take long
    pairs = texts.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism).crossJoin(F.broadcast(asked))
    out = pairs.mapInArrow(meet, found)
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), F.col("item_id").cast(heads.schema["item_id"].dataType), "d", "n")
