"""Paragraphs from the lines of every document, set twelve lines to a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.operators import paragraphs as P
from veriframe.session import table

PAGE = 12


def _lines(spark, sf_dir):
    """Eight words a line; each fifth line stands after a blank one, each ninth is a heading, each seventh numbered."""
    d = table(spark, sf_dir, "documents")
    cut = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+(?:\s+\S+){0,7}"), F.lit(0))
    rows = d.select("doc_id", F.posexplode(cut).alias("k", "said")).withColumn("said", F.regexp_replace("said", r"\s+", " "))
    k = F.col("k")
    text = F.when(k % 9 == 8, F.upper(F.left("said", F.lit(40)))).when(k % 7 == 6, F.concat(F.floor(k / 7) + 1, F.lit(". "), "said")).otherwise(F.col("said"))
    text = F.when(k % 7 == 5, F.concat(text, F.lit("."))).otherwise(text)
    y0 = (k % PAGE) * 14.0 + F.floor((k % PAGE) / 5) * 14.0
    return rows.select(F.col("doc_id").alias("doc"), F.floor(k / PAGE).alias("page"), (k % PAGE).cast("long").alias("no"), F.when(k % 11 == 10, 90.0).otherwise(72.0).alias("x0"), y0.alias("y0"), text.alias("text"))


def q_paragraphs(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return P.joined(lines, P.paragraphs(lines)).select("doc", "para_no", "label", "page", "last_page", "n_lines", F.md5("text").alias("text_md5"))


QUERIES = {"q_paragraphs": q_paragraphs}
ORACLES: dict[str, str] = {}
