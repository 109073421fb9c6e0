"""What a selection left out around the records it picked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.operators.timeline import exchanges, thread_order


def passages(records: DataFrame, picks: DataFrame, selection: DataFrame, gap_s: int = 3600) -> DataFrame:
    """One row for each exchange with a pick: rows picked, selected elsewhere, and left out before,
    between and after the picks, and by senders who were never picked in it.

    picks and selection: id.
    """
    mark = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    rows = exchanges(records, gap_s).join(mark(picks, "picked"), "id", "left").join(mark(selection, "selected"), "id", "left").fillna(False, ["picked", "selected"])
    keys = ["thread_id", "exchange"]
    w = Window.partitionBy(*keys).orderBy(*thread_order())
    rows = rows.withColumn("pos", F.row_number().over(w))
    bounds = rows.filter("picked").groupBy(*keys).agg(F.min("pos").alias("first_pick"), F.max("pos").alias("last_pick"), F.collect_set("sender").alias("pick_senders"))
    rows = rows.join(bounds, keys)
    out = ~F.col("picked") & ~F.col("selected")
    stranger = out & F.col("sender").isNotNull() & ~F.array_contains("pick_senders", F.col("sender"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("picked")).alias("picked"), F.count_if(F.col("selected") & ~F.col("picked")).alias("elsewhere"),
        F.count_if(out & (F.col("pos") < F.col("first_pick"))).alias("left_before"), F.count_if(out & F.col("pos").between(F.col("first_pick"), F.col("last_pick"))).alias("left_between"),
        F.count_if(out & (F.col("pos") > F.col("last_pick"))).alias("left_after"), F.count_if(F.coalesce(stranger, F.lit(False))).alias("other_senders"),
    )


def layout(records: DataFrame, picks: DataFrame, before: int = 8, after: int = 8, gap_s: int = 3600) -> DataFrame:
    """(thread_id, exchange, id, part): the rows shown of a passage: at most ``before`` and ``after``
    around the picks, all between them."""
    rows = exchanges(records, gap_s).join(picks.select("id").distinct().withColumn("picked", F.lit(True)), "id", "left")
    keys = ["thread_id", "exchange"]
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*thread_order())))
    bounds = rows.filter("picked").groupBy(*keys).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    part = F.when(F.col("pos") < F.col("lo"), "before").when(F.col("pos") > F.col("hi"), "after").otherwise("between")
    shown = (F.col("pos") >= F.col("lo") - before) & (F.col("pos") <= F.col("hi") + after)
    return rows.join(bounds, keys).filter(shown).select(*keys, "id", part.alias("part"))
