"""Plumbing shared by the training-data operators: shipping, shared tables, range groups, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import materialize, shared_dir, ship, sweep

__all__ = ["begin", "caches", "connected_components", "materialize", "numbered", "parallelism", "range_bounds", "range_group", "range_start", "raw", "shared_dir", "ship", "slices", "sweep", "utf8"]

#: Parquet bytes of input that one group or bucket should hold at most.
GROUP_BYTES = 8 << 20


_caches: dict[str, Callable[[], None]] = {}
_busy = [""]


def caches(operator: str, clear: Callable[[], None]) -> None:
    """Names what an operator keeps in a Python worker from batch to batch, and how to let it go."""
    _caches[operator] = clear


def begin(operator: str) -> None:
    """An operator's work begins in a Python worker: what others keep there goes, so a worker that Spark uses again never holds more than
    one operator's tables."""
    if _busy[0] == operator:
        return
    _busy[0] = operator
    for name, clear in _caches.items():
        if name != operator:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it has
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that a worker holds the texts of few at a time."""
    for b in batches:
        for low in range(0, b.num_rows, rows):
            yield b.slice(low, rows)


def numbered(df: DataFrame, row: str, text: str) -> DataFrame:
    """df as a table in the shared folder with an identity of each row, told from all others even where rows are equal: column
    `row` = struct<text: hash of the text, n: running number>. It is written, so it stays the same however often it is read."""
    return materialize(df.withColumn(row, F.struct(F.xxhash64(text).alias("text"), F.monotonically_increasing_id().alias("n"))), "rows")


def leaf_bytes(df: DataFrame) -> int:
    """Bytes of what df scans, as the optimizer knows them; 0 where it does not."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        size = int(str(leaves.apply(i).stats().sizeInBytes()))
        total += size if size < 1 << 60 else 0
    return total


def parallelism(df: DataFrame) -> int:
    """How many groups to deal df into: the shuffle partitions, more where groups would pass GROUP_BYTES."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-leaf_bytes(df) // GROUP_BYTES), 1)


def range_bounds(df: DataFrame, key: str, groups: int) -> list[int]:
    """First keys of at most `groups` ranges with about equal rows. Every bound but none other is a key that occurs;
    the first is the smallest key. At most `groups` numbers reach the driver. Empty where no key is there."""
    if groups < 2:
        row = df.agg(F.min(key)).head()
        return [] if row[0] is None else [int(row[0])]
    at = [i / groups for i in range(1, groups)]
    row = df.agg(F.min(key), F.percentile_approx(key, at, max(10_000, 20 * groups))).head()
    return [] if row[0] is None else sorted({int(row[0]), *map(int, row[1] or [])})


def range_group(bounds: list[int], key: Column) -> Column:
    """The range (0 up) that key lies in; null keys go to the last."""
    firsts = np.array(bounds, dtype=np.int64)

    @F.arrow_udf("int")
    def group(keys: pa.Array) -> pa.Array:
        last = max(len(firsts) - 1, 0)
        at = np.searchsorted(firsts, keys.fill_null(0).to_numpy(zero_copy_only=False), side="right") - 1
        at = np.clip(at, 0, last)
        if keys.null_count:
            at[keys.is_null().to_numpy(zero_copy_only=False)] = last
        return pa.array(at.astype(np.int32))

    return group(key.cast("long"))


def range_start(bounds: list[int], key: Column) -> Column:
    """Is key the first of a range?"""
    firsts = np.array(bounds, dtype=np.int64)

    @F.arrow_udf("boolean")
    def start(keys: pa.Array) -> pa.Array:
        k = keys.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(firsts, k), len(firsts) - 1)
        return pa.array((firsts[at] == k) & keys.is_valid().to_numpy(zero_copy_only=False))

    return start(key.cast("long"))


def _priority(c: Column) -> Column:
    return F.struct(F.xxhash64(c).alias("h"), c.alias("v"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the undirected graph whose edges are rows (a, b) of longs.

    Distributed union-find by contraction: each node hooks onto the neighbour that comes first in a hashed order,
    the edges are relabelled with what their ends hooked onto, and rounds go on until none is left; then the hooks
    of all rounds are composed. A hashed order keeps chains short whatever the ids are. Minima are aggregated before
    they are shuffled, so a hub with any number of edges costs one row a task. Each round ends in a shared table.
    Loops and repeated edges count as none; an empty input gives an empty result."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    rounds: list[DataFrame] = []
    while e.head() is not None:
        hook = e.groupBy("u").agg(F.min(_priority(F.col("v"))).alias("m"))
        hook = hook.select(F.col("u").alias("node"), F.when(F.col("m") < _priority(F.col("u")), F.col("m.v")).otherwise(F.col("u")).alias("p"))
        hook = materialize(hook, "hooks")
        rounds.append(hook)
        left = hook.select(F.col("node").alias("u"), F.col("p").alias("pu"))
        right = hook.select(F.col("node").alias("v"), F.col("p").alias("pv"))
        e = e.join(left, "u").join(right, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct()
        e = materialize(e, "edges")
    if not rounds:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = rounds[-1].select("node", F.col("p").alias("root"))
    for hook in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("p"), "root")
        out = hook.join(later, "p", "left").select("node", F.coalesce("root", "p").alias("root"))
    return materialize(out, "components")


def utf8(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A text column as one array of UTF-8, null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    return col.cast(pa.large_string()).fill_null("")


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and the offsets of its n + 1 values."""
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs

