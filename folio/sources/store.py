"""A store of chunks with their vectors and postings, in a folder of any file system that Spark can write.

Every ingest is a batch: a partition of each table, which counts once its mark is written, so a reader never sees half of one and a failed
ingest leaves nothing behind that counts. Nothing is rewritten: a source's rows are those of the last batch that brought it, which
is an equi-join with the table of sources. Rows are named by source and number, so ids never collide between batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.models import Embedder, embed
from folio.functions.text import tokens
from folio.operators.objects import FLAGS, NAMES
from folio.operators.terms import count_terms

#: Sources of a store that are broadcast.
FEW = 100_000
TABLES = ("chunks", "vectors", "postings", "sources")


class Store:
    """Tables: chunks (id, source, chunk_id, text, ...), vectors (id, source, embedding), postings (id, source, dl, term, tf), sources (source)."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, tokenizer=tokens):
        self.spark, self.root, self.embedder, self.tokenizer = spark, root.rstrip("/"), embedder, tokenizer

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def batches(self) -> list[int]:
        """Numbers of the batches that count."""
        fs, target = self._fs(f"{self.root}/committed")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(target)) if fs.exists(target) else []

    def exists(self) -> bool:
        """Is there a batch, with all of its tables?"""
        known = self.batches()
        return bool(known) and all(self._fs(f"{self.root}/{t}")[0].exists(self._fs(f"{self.root}/{t}")[1]) for t in TABLES)

    def _all(self, name: str) -> DataFrame:
        known = self.batches()
        if not known:
            raise FileNotFoundError(f"there is no store in {self.root}")
        paths = [f"{self.root}/{name}/batch={b}" for b in known]
        return self.spark.read.option("basePath", f"{self.root}/{name}").option("mergeSchema", True).parquet(*paths)

    def sources(self) -> DataFrame:
        """(source, batch): the documents of the store, each with the last batch that brought it."""
        return self._all("sources").groupBy("source").agg(F.max("batch").alias("batch"))

    def table(self, name: str, sources: list[str] | None = None) -> DataFrame:
        """The rows of a table that count, of all sources or of those given."""
        rows = self._all(name)
        if sources is not None:
            rows = rows.where(F.col("source").isin(sources))
        if len(self.batches()) == 1:  # nothing was replaced
            return rows.drop("batch")
        live = self.sources()
        if sources is not None:
            live = live.where(F.col("source").isin(sources))
        # told beforehand, so that the rows are not dealt out by source while Spark finds the table to be small
        small = live.limit(FEW + 1).count() <= FEW
        return rows.join(F.broadcast(live) if small else live, ["source", "batch"], "left_semi").drop("batch")

    def chunks(self, sources: list[str] | None = None) -> DataFrame:
        return self.table("chunks", sources)

    def vectors(self, sources: list[str] | None = None) -> DataFrame:
        return self.table("vectors", sources)

    def postings(self, sources: list[str] | None = None) -> DataFrame:
        return self.table("postings", sources)

    def add(self, chunks: DataFrame, replace: bool = True, emptied: DataFrame | None = None) -> int:
        """Adds chunks (source, chunk_id, text, ...) as a batch and returns its number. With replace the sources' old chunks no longer count;
        without, only chunks of unknown sources are added. Old chunks of the sources in `emptied` no longer count either."""
        known = self.batches()
        if known and not replace:
            chunks = chunks.join(self.sources().select("source"), "source", "left_anti")
        number = known[-1] + 1 if known else 0
        fs, _ = self._fs(self.root)
        place = {t: f"{self.root}/{t}/batch={number}" for t in TABLES}
        for path in place.values():  # what a failed ingest left
            fs.delete(self._fs(path)[1], True)
        rows = chunks.select(row_id().alias("id"), *chunks.columns)
        rows.write.parquet(place["chunks"])
        rows = self.spark.read.parquet(place["chunks"])  # models and tokenizers run on what was written, once
        rows.select("id", "source", embed(F.col("text"), self.embedder).alias("embedding")).write.parquet(place["vectors"])
        count_terms(rows.select("id", "source", self.tokenizer(F.col("text")).alias("words")), "words").write.parquet(place["postings"])
        brought = rows.select("source") if emptied is None else rows.select("source").unionByName(emptied.select("source"))
        brought.distinct().write.parquet(place["sources"])
        fs.mkdirs(self._fs(f"{self.root}/committed/{number}")[1])
        return number

    def remove(self, sources: list[str]) -> int:
        """A batch without chunks in which the sources stand, so that their old chunks no longer count."""
        names = self.spark.createDataFrame([(s,) for s in sources], "source string")
        return self.add(self._all("chunks").drop("batch", "id").limit(0), emptied=names)

    def registry(self) -> DataFrame:
        """The sources that have chunks."""
        return self.chunks().select("source").distinct()

    def compact(self) -> int:
        """One batch of all that counts; the older ones' rows no longer do. Files of older batches are deleted once it is written."""
        known = self.batches()
        number = known[-1] + 1
        fs, _ = self._fs(self.root)
        for t in TABLES:  # vectors and postings are those of the chunks, so they are copied
            fs.delete(self._fs(f"{self.root}/{t}/batch={number}")[1], True)
            (self.table(t) if t != "sources" else self.registry()).write.parquet(f"{self.root}/{t}/batch={number}")
        fs.mkdirs(self._fs(f"{self.root}/committed/{number}")[1])
        for b in known:
            fs.delete(self._fs(f"{self.root}/committed/{b}")[1], True)
            for t in TABLES:
                fs.delete(self._fs(f"{self.root}/{t}/batch={b}")[1], True)
        return number

    def view(self, name: str = "chunks") -> None:
        """The chunks as a temporary view, for a session's own use."""
        self.chunks().createOrReplaceTempView(name)


def row_id() -> Column:
    """A stable id of a chunk."""
    return F.xxhash64("source", "chunk_id")


METADATA = ["type", "outline_titles", "outline_en", "outline_parents", *FLAGS, *NAMES]
