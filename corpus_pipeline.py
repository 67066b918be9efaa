"""A corpus pipeline of five operators. Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor
kept, and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.

1. language ID: documents without a known language (`und`) go.
2. line dedup: of equal and fuzzy lines (Jaccard index of 0.8 or more) the first stays.
3. SimHash near-dedup: one document of each group of fingerprints that 3-bit links join stays.
4. substring dedup: later copies of passages of 20 words or more are taken out.
5. best-fit packing: the documents' tokens in sequences of 4,096.

A stage begins by deleting what earlier ones wrote for themselves and no plan reads any more.

Rows keep the columns of documents until the last stage; n_chars follows the text. Nulls, ties and repeated rows are
treated as the operators' docstrings say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import language_id, line_dedup, packing, simhash, substring_dedup
from folio.llm._common import materialize, sweep


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return language_id.keep_identified(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return simhash.keep_one(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return substring_dedup.substring_dedup(docs, window=20)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    sweep(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_passages),
    ("best-fit packing", pack),
]

#: No SQL: cross-parsing, MinHash components, XXH64 and the tokenizer are beyond it. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, with a table in the shared folder between any two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
