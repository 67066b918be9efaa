"""Markdown files into a store as they arrive, and sessions of heartbeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.sources.markdown import PATTERN, valid_documents
from folio.sources.store import Store


def markdown_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The Markdown files of a folder and all below it, each once, as documents (doc_id, source, file_path, text)."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN).load(folder)
    path = F.col("_metadata.file_path")
    return rows.select(F.xxhash64(path).alias("doc_id"), F.col("_metadata.file_name").alias("source"), path.alias("file_path"), F.col("value").alias("text"))


def ingest(documents: DataFrame, store: Store, chunk: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Chunks each micro-batch and adds it to the store; chunk gives (doc_id, chunk_id, text, ...). A batch that is run again replaces its own
    sources, so the store is the same. once: what is there now, and no more."""

    def add(batch: DataFrame, number: int) -> None:
        docs = valid_documents(batch)
        rows = chunk(docs).join(docs.select("doc_id", "source"), "doc_id")
        store.add(rows)

    out = documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def heartbeat_sessions(events: DataFrame, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(user_id, session, beats) of a stream of events (user_id, ts): a session ends once a user was silent for the gap; state is dropped
    when the watermark has passed."""
    session = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", session.alias("session")).agg(F.count(F.lit(1)).alias("beats"))
