"""Searches by blocks of vectors against the expressions of folio.functions.vectors on every pair."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions.vectors import cosine, squared_l2
from folio.operators import blocks
from folio.operators import retrieval as R


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(7)
    some = lambda: [round(rnd.uniform(-1, 1), 2) for _ in range(5)]
    same = some()
    rows = [(i, i % 3, some()) for i in range(300)] + [(300 + i, i % 3, same) for i in range(40)]
    rows += [(400, 0, None), (401, 1, [0.0] * 5), (402, 2, [1.0, None, 0.0, 0.0, 0.0]), (403, 0, [1.0, 2.0]), (404, 3, None), (405, 3, None), (406, None, some())]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    asked = [(i, some()) for i in range(20)] + [(30, same), (31, [0.0] * 5), (32, None), (33, [1.0, 2.0])]
    return vectors, spark.createDataFrame(asked, "query_id long, q array<float>")


def expected(vectors, query, score, k, order, *by):
    pairs = vectors.crossJoin(query).select("query_id", "label", "vec_id", F.round(score(F.col("embedding"), F.col("q")), 6).alias("score"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", *by).orderBy(order, "vec_id"))).where(F.col("rank") <= k)


@pytest.mark.parametrize("most", [10_000, 4])
def test_searches_by_blocks(spark, odd, monkeypatch, most):
    vectors, query = odd
    monkeypatch.setattr(R, "BROADCAST", most)
    names = ["query_id", "vec_id", "score", "rank"]
    rows = lambda df, *more: sorted((tuple(r) for r in df.select(*names, *more).collect()), key=repr)
    assert rows(R.knn(vectors, query, 10)) == rows(expected(vectors, query, squared_l2, 10, F.asc_nulls_last("score")))
    assert rows(R.knn(vectors, query, 10, "cosine")) == rows(expected(vectors, query, cosine, 10, F.desc_nulls_last("score")))
    # labels with fewer vectors than asked for, and nulls after numbers
    assert rows(R.knn_by(vectors, query, "label", 3), "label") == rows(expected(vectors, query, squared_l2, 3, F.asc_nulls_last("score"), "label"), "label")


def test_no_row_for_each_pair(odd):
    vectors, query = odd
    plan = R.knn(vectors, query, 10)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


def test_cosine_by_label(odd):
    vectors, query = odd
    c = cosine(F.col("embedding"), F.col("q"))
    usual = vectors.crossJoin(query).groupBy("query_id", "label").agg(F.round(F.avg(c), 6).alias("avg_cosine"), F.round(F.max(c), 6).alias("max_cosine"))
    rows = lambda df: sorted((tuple(r) for r in df.select("query_id", "label", "avg_cosine", "max_cosine").collect()), key=repr)
    assert rows(blocks.cosine_stats(vectors, query, "label", "vec_id", "embedding", 10_000)) == rows(usual)


def test_rounding_is_that_of_spark(spark):
    import numpy as np

    values = [0.0000005, 1.0000005, 2.1234565, -0.1234565, 0.1234564999, 1e12, 3.5, 0.0]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", F.round("x", 6)).collect()
    assert blocks.rounded(np.array(values)).tolist() == [r[1] for r in sorted(found)]
