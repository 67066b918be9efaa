"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Law `key`: the key and the set of shards decide alone. Each shard scores each key, -weight / ln(u) with u in (0, 1) from
MD5(key ":" shard), and the highest score wins (ties: the smaller shard). A new shard changes no other score, so it takes
rows only into itself: about 1 / (n + 1) of them for equal weights. All scores are column expressions.

Slots count a shard's rows from 0 without gaps in ascending order of doc_id. Rows are numbered within (shard, range of
doc_id) and moved by the rows of the shard in earlier ranges, so no task holds a whole shard. Copies of a text go where
their own keys say; a group that holds a third of all rows is spread like any other rows.

Nulls: a null text is as long as none (size 1, CRC 0); a null key is hashed as the empty text and comes last. Rows that
repeat a key go to the same shard and get slots of their own, by size and CRC. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm._common import materialize, parallelism, range_bounds, range_group, ship


def best(key: Column, weights: Sequence[float], since: int = 0) -> Column:
    """struct<score, minus> of the best shard from number `since` on; minus is its number below 0."""
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be numbers of at least 0, and one above 0")
    name = F.coalesce(key.cast("string"), F.lit(""))

    def score(shard: int, weight: float) -> Column:
        digits = F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{shard}")).cast("binary")), 1, 13), 16, 10).cast("long")
        u = (digits + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(-shard).alias("minus"))

    scores = [score(i, w) for i, w in enumerate(weights) if w and i >= since]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 up) of key among shards of these weights; a weight of 0 gets no rows."""
    return -best(key, weights)["minus"]


def shard(docs: DataFrame, shards: int = 16, weights: Sequence[float] | None = None, new_weight: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    ship(docs.sparkSession)
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards:
        raise ValueError("one weight a shard")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    bounds = range_bounds(docs, key, parallelism(docs))
    k = F.col(key)
    rows = docs.select(k.cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"), best(k, weights).alias("old"), best(k, [*weights, new_weight], len(weights)).alias("new") if new_weight else F.lit(None).cast("struct<score: double, minus: int>").alias("new"))
    grown = -F.greatest("old", "new")["minus"]  # the new shard's score is the only one that joins
    rows = rows.select("doc_id", "size", "text_crc32", "law", (-F.col("old.minus")).cast("int").alias("shard"), grown.cast("int").alias("grown_shard"))
    rows = materialize(rows.withColumn("part", range_group(bounds, F.col("doc_id"))), "shards")  # read for slots and for counts
    within = Window.partitionBy("shard", "part")
    order = [F.col("doc_id").asc_nulls_last(), "size", "text_crc32"]
    rows = rows.select("*", F.row_number().over(within.orderBy(*order)).alias("nth"))
    counts = rows.groupBy("shard", "part").agg(F.max("nth").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "part", before.alias("before"))
    out = rows.join(offsets, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard")
