"""Vector column builders on array<float> or array<double>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def mean_cosine(vectors: DataFrame, query: DataFrame, column: str = "embedding", q: str = "q") -> DataFrame:
    """query with avg_cosine, its mean cosine with all vectors: that with the mean of the vectors, each divided by its length, so no pair is made. A vector
    without length does not count, nor does one of another size; null where none counts."""
    size = norm(F.col(column))
    units = vectors.select(F.size(column).alias("_dim"), F.transform(column, lambda x: x.cast("double") / F.nullif(size, F.lit(0.0))).alias("u")).where(size > 0)
    sums = units.select("_dim", F.posexplode("u").alias("pos", "x")).groupBy("_dim", "pos").agg(F.sum("x").alias("x"), F.count("x").alias("n"))
    mean = sums.groupBy("_dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("x") / F.col("n")).alias("x")))), lambda p: p["x"]).alias("_mean"))
    found = query.withColumn("_dim", F.size(q)).join(F.broadcast(mean), "_dim", "left")
    return found.select(*query.columns, (dot(F.col("_mean"), F.col(q)) / F.nullif(norm(F.col(q)), F.lit(0.0))).alias("avg_cosine"))
