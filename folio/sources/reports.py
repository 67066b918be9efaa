"""Reports as text: chunks with their metadata, answers, and metrics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = "=" * 80


def chunk_report(chunks: DataFrame, *order: str) -> DataFrame:
    """(pos, value): each chunk with its number, text and other columns as `name: value`, between lines of `=`."""
    from pyspark.sql import Window

    place = list(order) or ["doc_id", "chunk_id"]
    nth = F.row_number().over(Window.orderBy(*place)) if len(place) else F.lit(1)
    meta = [F.concat(F.lit(f"{c}: "), F.coalesce(_plain(chunks, c), F.lit(""))) for c in chunks.columns if c != "text"]
    value = F.concat_ws("\n", F.concat(F.lit("chunk "), nth.cast("string")), F.col("text"), F.lit(""), *meta, F.lit(LINE))
    return chunks.select(nth.alias("pos"), value.alias("value"))


def _plain(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return F.to_json(name) if isinstance(kind, T.ArrayType | T.StructType | T.MapType) else F.col(name).cast("string")


def write_text(report: DataFrame, path: str, mode: str = "append") -> None:
    """Writes (pos, value) in order. A report is for people to read, so it is one file."""
    report.coalesce(1).sortWithinPartitions("pos").select("value").write.mode(mode).text(path)


def answer_report(answers: DataFrame) -> DataFrame:
    """(pos, value): question and answer of each row (query_id, query, answer)."""
    return answers.select(F.col("query_id").alias("pos"), F.concat_ws("\n", F.concat(F.lit("# "), "query"), "answer", F.lit("")).alias("value"))


def numeric_metrics(rows: DataFrame, key: str = "query_id", describe: dict[str, str] | None = None) -> DataFrame:
    """(key, name, description, score) of the columns that hold numbers; others are no metrics."""
    names = [f.name for f in rows.schema if isinstance(f.dataType, T.NumericType) and f.name != key]
    if not names:
        raise ValueError("there is no column of numbers")
    long = rows.select(key, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(key, names, "name", "score")
    text = F.create_map(*(F.lit(x) for n in names for x in (n, (describe or {}).get(n, n))))
    return long.select(key, "name", F.element_at(text, F.col("name")).alias("description"), "score")


def _four_places(score: Column) -> Column:
    """%.4f by a number's exact value, as C prints it; Java's rounds the digits that the number is written with, so 0.00225, which is less, goes up there."""

    @F.arrow_udf("string")
    def text(scores: pa.Array) -> pa.Array:
        return pa.array([None if x is None else "%.4f" % x for x in scores.to_pylist()], pa.string())

    return text(score)


def metric_report(metrics: DataFrame, key: str = "query_id") -> DataFrame:
    """(pos, value): a Markdown table row for each metric, scores with four places."""
    score = F.coalesce(_four_places(F.col("score")), F.lit("-"))
    return metrics.select(F.struct(key, "name").alias("pos"), F.concat(F.lit("| "), "description", F.lit(" | "), score, F.lit(" | "), "name", F.lit(" |")).alias("value"))
