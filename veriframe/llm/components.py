"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id of ``edges`` (a, b long): the smallest id of its component.

    Alternates the large-star and the small-star step until the edges are separate stars, which
    takes O(log^2) rounds. Each step is one minimum by key (combined before the shuffle) and one
    join, so a node of many edges costs no task more than its share; Spark splits a skewed join.
    """
    now = cut(edges.select("a", "b").filter("a <> b").distinct())
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = cut(small.select("e.a", "e.b").filter("a <> b").distinct())
        # done when the edges are separate stars: one centre for each id, and no centre has one
        several = now.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
        if several.unionByName(now.select(F.col("b").alias("a")).join(now.select("a"), "a", "left_semi")).isEmpty():
            break
    ids = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("label", F.col("id"))
    return ids.unionByName(roots.join(ids, "id", "left_anti"))
