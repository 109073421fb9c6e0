"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``, a rewritten text with its ``n_chars``. Rows are known by
their id and a hash of their text, so that different texts under one id, or under none, are each
judged by themselves.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import bpe, contamination, jaccard, lines, quality
from veriframe.llm.common import shared_dir, table


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows (doc_id, tag)."""
    rows = rows.distinct().select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (jaccard.tag_of(F.col("text")) == F.col("__tag"))
    return docs.join(rows, same, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.judge(docs, out="__quality").filter("__quality.kept").drop("__quality")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier go; a document all of whose lines stand earlier goes with them."""
    columns = docs.columns
    less = lines.dedup(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_removed") == 0))
    if "n_chars" in columns:
        less = less.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return less.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the smallest id; a null id comes last."""
    found = jaccard.join(docs).membership
    return _without(docs, found.filter("NOT first").select("doc_id", "tag"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that show a benchmark item go."""
    found = contamination.find(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(F.col("doc").alias("doc_id"), "tag"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every kept text, with the digests of the ids and of what they decode to."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.encode(docs, f.read(), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL cannot express the encoding; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = shared_dir(spark)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
