"""Communication records derived from the driver's generic tables, and the same views as SQL.

``records`` is the fact every operator reads: messages and calls of four sources, with times as
microseconds since 1970 UTC (null = no usable time). ``claims`` holds one statement for each
account, with its parties, its window and what it says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.session import table

DAY = 86_400_000_000
START = 1_704_067_200_000_000  # 2024-01-01 UTC


def micros(c):
    """Microseconds of a timestamp without a zone, read as UTC in a session of any zone."""
    whole = F.unix_date(c.cast("date")).cast("long") * DAY + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000
    return whole + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    call = F.col("event_type") == "error"
    other = (F.col("user_id") * 7 + 3) % 150
    source = F.concat(F.lit("item"), (F.col("user_id") % 4).cast("string"))
    return table(spark, sf_dir, "events").select(
        e.alias("seq"),
        F.concat(F.when(call, "call:").otherwise("msg:"), e).alias("id"),
        F.when(call, "call").otherwise("message").alias("kind"),
        source.alias("source_id"),
        F.col("event_type").alias("app"),
        F.concat_ws("/", source, F.col("event_type"), F.least("user_id", other), F.greatest("user_id", other)).alias("thread_id"),
        F.when(e % 71 != 0, F.col("user_id")).alias("sender"),
        F.array(other).alias("recipients"),
        F.when(e % 97 != 0, micros(F.col("ts"))).alias("us"),
        F.when(~call, F.concat(F.lit("note "), F.get_json_object("props", "$.k"))).alias("text"),
        F.when(call & (e % 13 != 0), F.floor("value").cast("long")).alias("duration_s"),
        (e % 53 == 0).alias("deleted"),
        (e % 83 == 0).alias("forwarded"),
        F.concat(F.lit("row/"), e, F.when(e % 89 == 0, "/Embedded[1]").otherwise("")).alias("locator"),
        (e % 101 == 0).alias("numbered_copy"),
    )


def sources(records: DataFrame) -> DataFrame:
    n = F.substring("source_id", 5, 1)
    fidelity = F.when(n.isin("0", "1"), "full_extraction").when(n == "2", "curated_report").otherwise("unknown")
    return records.select("source_id").distinct().withColumn("fidelity", fidelity)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    lo = F.lit(START) + (u % 10) * DAY
    empty = F.array().cast("array<string>")
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        u.alias("claim_id"),
        F.concat(F.lit("item"), (u % 4).cast("string")).alias("source_id"),
        F.array(u).alias("a"),
        F.array((u * 7 + 3) % 150).alias("b"),
        lo.alias("lo"),
        (lo + (5 + u % 15) * DAY - 1).alias("hi"),
        (u % 40).alias("want"),
        F.element_at(F.array(F.lit("eq"), F.lit("ge"), F.lit("le")), (u % 3 + 1).cast("int")).alias("op"),
        (u % 7 == 0).alias("sent_by_a"),
        (u % 11 == 0).alias("each_way"),
        F.when(u % 5 == 0, F.array(F.lit("click"))).when(u % 5 == 1, F.array(F.lit("call"), F.lit("view"))).otherwise(empty).alias("channels"),
        F.concat(F.lit("note "), (u % 100).cast("string")).alias("quote"),
    )


SQL = f"""
records AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'call:' ELSE 'msg:' END || event_id AS id,
  CASE WHEN event_type = 'error' THEN 'call' ELSE 'message' END AS kind, 'item' || (user_id % 4) AS source_id, event_type AS app,
  'item' || (user_id % 4) || '/' || event_type || '/' || least(user_id, (user_id * 7 + 3) % 150) || '/' || greatest(user_id, (user_id * 7 + 3) % 150) AS thread_id,
  CASE WHEN event_id % 71 <> 0 THEN user_id END AS sender, (user_id * 7 + 3) % 150 AS recipient,
  CASE WHEN event_id % 97 <> 0 THEN epoch_us(ts) END AS us,
  CASE WHEN event_type <> 'error' THEN 'note ' || json_extract_string(props, '$.k') END AS text,
  CASE WHEN event_type = 'error' AND event_id % 13 <> 0 THEN floor(value)::BIGINT END AS duration_s,
  event_id % 53 = 0 AS deleted, event_id % 83 = 0 AS forwarded,
  'row/' || event_id || CASE WHEN event_id % 89 = 0 THEN '/Embedded[1]' ELSE '' END AS locator, event_id % 101 = 0 AS numbered_copy
  FROM events),
sources AS (SELECT DISTINCT source_id, CASE WHEN source_id IN ('item0', 'item1') THEN 'full_extraction' WHEN source_id = 'item2' THEN 'curated_report' ELSE 'unknown' END AS fidelity FROM records),
claims AS (SELECT user_id AS claim_id, 'item' || (user_id % 4) AS source_id, user_id AS a, (user_id * 7 + 3) % 150 AS b,
  {START} + (user_id % 10) * {DAY} AS lo, {START} + (user_id % 10) * {DAY} + (5 + user_id % 15) * {DAY} - 1 AS hi, user_id % 40 AS want,
  CASE user_id % 3 WHEN 0 THEN 'eq' WHEN 1 THEN 'ge' ELSE 'le' END AS op, user_id % 7 = 0 AS sent_by_a, user_id % 11 = 0 AS each_way,
  CASE user_id % 5 WHEN 0 THEN ['click'] WHEN 1 THEN ['call', 'view'] ELSE [] END AS channels, 'note ' || (user_id % 100) AS quote
  FROM (SELECT DISTINCT user_id FROM events))
"""


def with_views(body: str) -> str:
    """An oracle query over the views: ``body`` goes on after them."""
    return f"WITH {SQL.strip()}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().lstrip('+')}"
