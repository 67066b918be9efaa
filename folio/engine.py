"""One object for the whole way from a folder of Markdown to answers, with what it keeps between calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.models import Embedder, Reranker, TextModel
from folio.operators import answer as A
from folio.operators.retrieval import mentioned_sources, named, retrieve
from folio.operators.structural import structural
from folio.session import temporary
from folio.sources.markdown import markdown_dir, valid_documents
from folio.sources.store import TABLES, Store


@dataclass
class Ingested:
    """What an ingest did: its batch, how many chunks each source has, and what could not be read."""

    batch: int
    features: dict[str, int]
    warnings: list[str]


class Engine:
    """root: the store's folder; without one the store is the session's own, in the shared folder, and goes with it.

    Tables of the store that calls ask for are kept in executor storage until the store changes or `clear()`; storage that is lost is read again."""

    def __init__(self, spark: SparkSession, root: str | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None, model: TextModel | None = None):
        self.spark, self.reranker, self.model = spark, reranker, model
        self.store = Store(spark, root or temporary(spark, "store"), embedder)
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A table of the store, kept once it is asked for."""
        if name not in self._kept:
            self._kept[name] = self.store.table(name).persist()
        return self._kept[name]

    def preload(self) -> None:
        for name in TABLES[:-1]:
            self.table(name).count()

    def loaded(self) -> list[str]:
        return sorted(self._kept)

    def clear(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()

    def ingest(self, docs: DataFrame, chunk_size: int = 500, replace: bool = True) -> int:
        """Documents (doc_id, source, text) as chunks by the structural chunker; returns the batch."""
        docs = valid_documents(docs)
        chunks = structural(docs.select("doc_id", "text"), chunk_size).join(docs.select("doc_id", "source"), "doc_id")
        batch = self.store.add(chunks, replace)
        self.clear()
        return batch

    def ingest_dir(self, path: str, chunk_size: int = 500, replace: bool = True) -> Ingested:
        """The Markdown files of a folder and all below it. Raises where there is none; files that cannot be read are warnings."""
        docs, unreadable = markdown_dir(self.spark, path)
        batch = self.ingest(docs, chunk_size, replace)
        features = {r["source"]: r["count"] for r in self.store.chunks().groupBy("source").count().collect()}
        return Ingested(batch, features, [f"{r.file_path}: {r.error}" for r in unreadable.collect()])

    def retrieve(self, query: str | DataFrame, top_k: int = 10, method: str = "bm25rerank", sources: list[str] | None = None) -> DataFrame:
        """The top_k chunks of a question, or of each row of a table (query_id, query)."""
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string") if isinstance(query, str) else named(query)
        return retrieve(self.store, asked, method, top_k, sources, self.model, self.reranker)

    def answer(self, query: str | DataFrame, top_k: int = 10, method: str = "default") -> DataFrame:
        """(query_id, query, sources, answer): a question that mentions sources is answered from them, all others from the whole store. Queries
        that mention the same sources are asked together."""
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string") if isinstance(query, str) else named(query)
        meant = mentioned_sources(asked, self.store.registry()).persist()
        out = None
        for (sources,) in [tuple(r) for r in meant.select("sources").distinct().collect()]:
            rows = meant.where(F.col("sources").eqNullSafe(F.array(*map(F.lit, sources)) if sources else F.lit(None))).select("query_id", "query")
            found = A.refine(self.retrieve(rows, top_k, method, sources), rows, self.model)
            out = found if out is None else out.unionByName(found)
        return meant.join(out, "query_id", "left") if out is not None else meant.withColumn("answer", F.lit(A.EMPTY))
