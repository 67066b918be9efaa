"""Chunkers. Greedy packing is a fold over a document's own pieces; recursion and sentence distances use batches of documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.models import Embedder, HashingEmbedder
from folio.session import ship

# The separators of the recursive chunker and the sentence ends of the semantic one.
SEPARATORS = {"en": ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", ""], "cn": ["\n\n", "\n", "。", "！", "？", "；", "，", " ", ""]}
#: Characters of texts whose pieces a worker hands on at once.
HELD = 2_000_000
SENTENCES = {"en": r"[.!?;,\n]+", "cn": r"[。！？；，\n]+"}


def fold_packs(pieces: Column, size: int) -> Column:
    """array<string>: pieces joined by blank lines. A chunk that starts with a piece above 0.8 of the size stays as it is; else
    a piece joins while the chunk is under the size and the piece under 0.8 of it."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(False).alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        fresh = (F.length(piece) <= 0.8 * size).alias("open")
        grows = acc["open"] & (F.length(acc["now"]) < size) & (F.length(piece) < 0.8 * size)
        first = F.struct(acc["done"].alias("done"), piece.alias("now"), fresh)
        more = F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.lit("\n\n"), piece).alias("now"), F.lit(True).alias("open"))
        return F.when(acc["now"].isNull(), first).when(grows, more).otherwise(F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), piece.alias("now"), fresh))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def pack_lines(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(doc_id, pos, text): the lines of each text that are not empty, packed by fold_packs."""
    pieces = F.filter(F.split(F.col(text), "\n"), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(fold_packs(pieces, size)).alias("pos", "text"))


def fixed(docs: DataFrame, size: int, separator: str = "\n\n", overlap: int = 0, text: str = "text") -> DataFrame:
    """(doc_id, pos, text): pieces between separators joined greedily while the chunk stays within the size; a longer
    piece stays whole. A chunk begins with the last pieces of the one before that have at most `overlap` characters and leave room."""
    overlap = max(0, min(overlap, size - 1))
    pieces = F.filter(F.split(F.col(text), r"\Q" + separator + r"\E"), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"))
    whole = lambda xs: F.array_join(xs, separator)

    def step(acc: Column, piece: Column) -> Column:
        now, n = acc["now"], F.size(acc["now"])
        fits = (n == 0) | (F.length(whole(now)) + len(separator) + F.length(piece) <= size)
        tails = F.filter(F.sequence(F.lit(2), n + 1), lambda k: (k == n + 1) | ((F.length(whole(F.slice(now, k, n))) <= overlap) & (F.length(whole(F.slice(now, k, n))) + len(separator) + F.length(piece) <= size)))
        rest = F.slice(now, tails[0], n) if overlap else F.array().cast("array<string>")
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat(now, F.array(piece)).alias("now"))).otherwise(F.struct(F.concat(acc["done"], F.array(whole(now))).alias("done"), F.concat(rest, F.array(piece)).alias("now")))

    packed = F.aggregate(pieces, start, step, lambda acc: F.when(F.size(acc["now"]) == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(whole(acc["now"])))))
    return docs.select("doc_id", F.posexplode(packed).alias("pos", "text"))


def split_recursive(text: str, size: int, separators: list[str], overlap: int = 0) -> list[str]:
    """Pieces of at most `size`: cut at the first separator that occurs, longer pieces at the next ones. Separators stay at the start of the piece
    that follows, so without overlap the pieces joined give the text back."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    out: list[str] = []
    now: list[str] = []
    n = 0
    for p in filter(None, parts):
        if len(p) > size and rest:
            out += ["".join(now)] if now else []
            out += split_recursive(p, size, rest, overlap)
            now, n = [], 0
            continue
        if now and n + len(p) > size:
            out.append("".join(now))
            while now and (n > overlap or n + len(p) > size):
                n -= len(now.pop(0))
        now.append(p)
        n += len(p)
    return out + (["".join(now)] if now else [])


def recursive(docs: DataFrame, size: int, language: str = "en", overlap: int = 0, text: str = "text") -> DataFrame:
    """(doc_id, pos, text): split_recursive on each text; overlap is held below the size."""
    separators, overlap = SEPARATORS[language], max(0, min(overlap, size - 1))
    ship(docs.sparkSession)

    return _pieces(docs, text, lambda t: split_recursive(t, size, separators, overlap))


def _pieces(docs: DataFrame, text: str, split: Callable[[str], list[str]]) -> DataFrame:
    """(doc_id, pos, text): what split makes of each text. A worker holds one text and about HELD characters of pieces, apart from the batch it was sent."""
    types = [pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        places: list = []
        found: list = []
        n = 0
        for b in batches:
            for i in range(b.num_rows):
                t = b.column(1)[i].as_py()
                if not t:
                    continue
                cut, key = split(t), b.column(0)[i].as_py()
                ids += [key] * len(cut)
                places += range(len(cut))
                found += cut
                n += len(t)
                if n >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, places, found), types, strict=True)], names=["doc_id", "pos", "text"])
                    ids, places, found, n = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, places, found), types, strict=True)], names=["doc_id", "pos", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, pos int, text string")


def by_headers(docs: DataFrame, size: int, language: str = "en", levels: int = 2, text: str = "text") -> DataFrame:
    """(doc_id, pos, text): sections below Markdown headers of the first levels, without the headers; a section above the size is cut by split_recursive.
    Lines in fenced code are no headers. Sections whose headers are the same as those before go on."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("line", "text"))
    by = Window.partitionBy("doc_id").orderBy("line")
    fence = F.trim("text").rlike("^(```|~~~)")
    lines = lines.withColumn("fenced", F.sum(fence.cast("int")).over(by) % 2 == 1).withColumn("level", F.when(~F.col("fenced") & ~fence, F.length(F.regexp_extract(F.trim("text"), rf"^(#{{1,{levels}}}) +", 1))))
    lines = lines.withColumn("header", F.coalesce(F.col("level") > 0, F.lit(False)))
    # a header's path: the last header of each level since the last one above it
    path = []
    for k in range(1, levels + 1):
        above = F.max(F.when(F.col("header") & (F.col("level") < k), F.col("line"))).over(by)
        last = F.max_by(F.trim("text"), F.when(F.col("header") & (F.col("level") == k), F.col("line"))).over(by)
        at = F.max(F.when(F.col("header") & (F.col("level") == k), F.col("line"))).over(by)
        path.append(F.when(at > F.coalesce(above, F.lit(-1)), last))
    lines = lines.withColumn("path", F.to_json(F.struct(*path))).where("not header")
    changes = F.sum(F.when(F.lag("path").over(by).eqNullSafe(F.col("path")), 0).otherwise(1)).over(by)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    found = lines.withColumn("part", changes).groupBy("doc_id", "part").agg(F.regexp_replace(texts, r"^\s+|\s+$", "").alias("text")).where("text <> ''")
    cut = _cut_long(found, size, language)
    place = Window.partitionBy("doc_id").orderBy("part", "nth")
    return cut.select("doc_id", (F.row_number().over(place) - 1).alias("pos"), "text")


def _cut_long(parts: DataFrame, size: int, language: str) -> DataFrame:
    """(doc_id, part, nth, text): parts, those above the size cut."""
    separators = SEPARATORS[language]
    ship(parts.sparkSession)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, p, n, c) for i, p, t in zip(b["doc_id"], b["part"], b["text"], strict=True) for n, c in enumerate(split_recursive(t, size, separators))]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "nth", "text"])

    long = parts.where(F.length("text") > size).select("doc_id", "part", "text").mapInPandas(split, "doc_id long, part long, nth int, text string")
    return parts.where(F.length("text") <= size).select("doc_id", "part", F.lit(0).alias("nth"), "text").unionByName(long)


def _around(sentences: list[str], buffer: int, embedder: Embedder) -> np.ndarray:
    """The vectors of each sentence joined with its neighbours. Where bags of words add up each sentence is read once, else once for each neighbour."""
    low, high = (np.clip(np.arange(len(sentences)) + x, 0, len(sentences)) for x in (-buffer, buffer + 1))
    if not isinstance(embedder, HashingEmbedder):
        return embedder([" ".join(sentences[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
    sums = np.concatenate([np.zeros((1, embedder.dim)), np.cumsum(embedder.bags(sentences), axis=0)])
    return embedder.unit(sums[high] - sums[low])


def split_semantic(text: str, size: int, language: str, embedder: Embedder) -> list[str]:
    """Sentences joined where the texts around them are alike: each is embedded with its `buffer` neighbours, and a chunk ends where the
    cosine distance to the next is above a percentile that leaves about as many chunks as the size asks for."""
    sentences = [s for s in re.split(SENTENCES[language], text) if s.strip()]
    if len(sentences) < 2:
        return [s.strip() for s in sentences]
    buffer, wanted, least = int(max(10, size / 15)), int(max(3, len(text) // max(1, int(0.8 * size)))), int(max(50, size / 5))
    vectors = np.asarray(_around(sentences, buffer, embedder), float)
    size_of = np.linalg.norm(vectors, axis=1)
    distances = 1 - (vectors[:-1] * vectors[1:]).sum(axis=1) / np.where(size_of[:-1] * size_of[1:] == 0, 1, size_of[:-1] * size_of[1:])
    n = len(distances)
    percent = 100.0 if n == 1 else 100.0 * (n - max(1, min(wanted, n))) / (n - 1)
    limit = float(np.percentile(np.round(distances, 12), percent))
    out, begin = [], 0
    for i in np.flatnonzero(np.round(distances, 12) > limit).tolist():
        piece = " ".join(s.strip() for s in sentences[begin : i + 1])
        if len(piece) >= least:
            out.append(piece)
            begin = i + 1
    if begin < len(sentences):
        out.append(" ".join(s.strip() for s in sentences[begin:]))
    return out


def semantic(docs: DataFrame, size: int, language: str = "en", embedder: Embedder | None = None, text: str = "text") -> DataFrame:
    """(doc_id, pos, text): split_semantic on each text."""
    model = embedder or HashingEmbedder()
    ship(docs.sparkSession)

    return _pieces(docs, text, lambda t: split_semantic(t, size, language, model))


def by_plan(planned: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """(doc_id, pos, text): documents (doc_id, text, strategy, size, language) by the chunker their plan names: `fixed`, `recursive`, `document`
    (Markdown headers), `semantic`, or else the structural one. Sizes and languages are those of the plan: there are few of them, each a branch."""
    from folio.operators.structural import structural

    makers = {
        "fixed": lambda d, n, lang: fixed(d, n),
        "recursive": lambda d, n, lang: recursive(d, n, lang),
        "document": lambda d, n, lang: by_headers(d, n, lang),
        "semantic": lambda d, n, lang: semantic(d, n, lang, embedder),
        "default": lambda d, n, lang: structural(d, n).select("doc_id", F.col("chunk_id").alias("pos"), "text"),
    }
    known = planned.withColumn("strategy", F.when(F.col("strategy").isin(*makers), F.col("strategy")).otherwise("default")).withColumn("language", F.when(F.col("language").isin(*SEPARATORS), F.col("language")).otherwise("cn"))
    out = None
    for name, n, lang in sorted(map(tuple, known.select("strategy", "size", "language").distinct().collect())):
        rows = known.where((F.col("strategy") == name) & (F.col("size") == n) & (F.col("language") == lang)).select("doc_id", "text")
        part = makers[name](rows, n, lang).select("doc_id", F.col("pos").cast("int").alias("pos"), "text")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else planned.select("doc_id", F.lit(0).alias("pos"), "text")
