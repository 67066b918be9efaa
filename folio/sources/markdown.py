"""Markdown files as documents (doc_id, source, file_path, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import strip

MAX_BYTES = 10 << 20
PATTERN = "*.[mM][dD]"


class NotFound(FileNotFoundError):
    """The path does not exist."""


class NotFolder(NotADirectoryError):
    """The path is no folder."""


class NoMarkdown(ValueError):
    """There is no Markdown file that can be read."""


def _status(spark: SparkSession, path: str):
    """What the file system of the path says of it, wherever that is; None where it is not there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(target) if fs.exists(target) else None


def _load(spark: SparkSession, path: str) -> DataFrame:
    """Files as bytes, which are told good from bad by size and encoding. The text of a bad one is null and `error` says why."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN).load(path)
    text = F.try_validate_utf8(F.expr("cast(content as string)"))
    error = F.when(F.col("length") > MAX_BYTES, "larger than 10 MB").when(text.isNull(), "not UTF-8")
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return files.select(name.alias("source"), F.col("path").alias("file_path"), F.when(error.isNull(), text).alias("text"), error.alias("error"))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.xxhash64("file_path").alias("doc_id"), "source", "file_path", "text")


def markdown_file(spark: SparkSession, path: str) -> DataFrame:
    """One Markdown file. Raises where it is missing, of another kind, too large or not UTF-8."""
    status = _status(spark, path)
    if status is None:
        raise NotFound(path)
    if status.isDirectory() or not path.lower().endswith(".md"):
        raise NoMarkdown(f"not a Markdown file: {path}")
    if status.getLen() > MAX_BYTES:
        raise NoMarkdown(f"larger than 10 MB: {path}")
    rows = _load(spark, path)
    if rows.where("error is not null").head() is not None:
        raise NoMarkdown(f"not UTF-8: {path}")
    return _named(rows)


def markdown_dir(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The Markdown files of a folder and all below it, and (file_path, error) of those that cannot be read. Raises where the path is
    missing or no folder, or no file can be read."""
    status = _status(spark, path)
    if status is None:
        raise NotFound(path)
    if not status.isDirectory():
        raise NotFolder(path)
    rows = _load(spark, path)
    if rows.where("error is null").head() is None:
        raise NoMarkdown(f"no Markdown file can be read: {path}")
    return _named(rows.where("error is null")), rows.where("error is not null").select("file_path", "error")


def valid_documents(docs: DataFrame) -> DataFrame:
    """Documents with text and source that can be stored: a blank text is none, a missing source gets the default."""
    for name in ("text", "source"):
        if name not in docs.columns:
            raise ValueError(f"documents need a column {name}")
    return docs.where(F.col("text").isNotNull() & (strip(F.col("text")) != "")).withColumn("source", F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("未知来源")))


def synthetic_documents(spark: SparkSession, n: int, seed: int = 0, sections: int = 4) -> DataFrame:
    """n Markdown news articles on invented companies and products, the same for the same seed."""
    pick = lambda xs, salt: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    company = F.concat(pick(["东方", "北辰", "启明", "长江", "天河"], 1), pick(["科技", "电子", "医药", "能源"], 2), F.lit("有限公司"))
    product = pick(["智能手表", "扫地机器人", "电动汽车", "无线耳机", "净水器", "投影仪"], 3)
    person = F.concat(pick(["王", "李", "张", "刘", "陈"], 4), pick(["伟", "芳", "敏", "静", "磊"], 5))
    job = pick(["总经理", "产品经理", "首席工程师"], 6)
    parts = F.array(*map(F.lit, ["发布会", "产品特点", "市场反应", "未来计划", "专家观点"]))
    body = F.array_join(F.transform(F.slice(parts, 1, sections), lambda x: F.concat(F.lit("## "), x, F.lit("\n"), company, F.lit("的"), job, person, F.lit("介绍了"), product, F.lit("的"), x, F.lit("。"))), "\n\n")
    rows = spark.range(n).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", F.concat(F.lit("news"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), F.concat(F.lit("# "), company, F.lit("推出"), product, F.lit("\n\n"), body, F.lit("\n")).alias("text"))


DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("text", T.StringType())])
