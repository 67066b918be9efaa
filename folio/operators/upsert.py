"""Keyed upsert of chunks by source. Replaced sources are removed by anti-join, so nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame


def existing(batch: DataFrame, store: DataFrame, key: str = "source") -> DataFrame:
    return batch.join(store.select(key).distinct(), key, "left_semi")


def new(batch: DataFrame, store: DataFrame, key: str = "source") -> DataFrame:
    return batch.join(store.select(key).distinct(), key, "left_anti")


def upsert(store: DataFrame, batch: DataFrame, replace: bool = True, key: str = "source") -> DataFrame:
    """With replace, sources of the batch lose their old rows; without, only rows of unknown sources are added."""
    if replace:
        return store.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)
    return store.unionByName(new(batch, store, key))
