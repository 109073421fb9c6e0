"""Selections, bundles and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.operators import selection as L
from veriframe.session import shared_path, table
from veriframe.sources import adapter, bundle
from veriframe.sources.adapter import with_views
from veriframe.streaming.exchanges import exchange_sessions, run_to_table

GAP_S = 2 * 86_400


def _picks(r):
    return r.filter("seq % 25 = 0").select("id"), r.filter("seq % 10 = 0").select("id")


def q_selection_passages_left_out(spark, sf_dir):
    r = adapter.records(spark, sf_dir)
    return L.passages(r, *_picks(r), gap_s=GAP_S)


def q_passage_layout(spark, sf_dir):
    r = adapter.records(spark, sf_dir)
    return L.layout(r, _picks(r)[0], 1, 1, GAP_S)


def q_bundle_round_trip(spark, sf_dir):
    tables = {name: table(spark, sf_dir, name) for name in ("customer", "supplier", "part")}
    path = shared_path(spark)
    bundle.write(tables, path)
    return bundle.verify(spark, path, {name: df.schema for name, df in tables.items()})


def q_exchange_stream(spark, sf_dir):
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a glob, so that a single file will do
    rows = stream.select(F.concat_ws("/", "user_id", "event_type").alias("thread_id"), F.col("ts").cast("timestamp").alias("ts"))
    done = run_to_table(rows, exchange_sessions, shared_path(spark))
    return done.select("thread_id", "n", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


QUERIES = {f.__name__: f for f in (q_selection_passages_left_out, q_passage_layout, q_bundle_round_trip, q_exchange_stream)}

_X = """
o AS (SELECT *, lag(us) OVER w AS prev, row_number() OVER w AS tpos FROM records WINDOW w AS (PARTITION BY thread_id ORDER BY us IS NULL, us, seq, locator, id)),
x AS (SELECT *, sum(CASE WHEN prev IS NULL OR us IS NULL OR us - prev > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY tpos)::BIGINT AS exchange FROM o),
y AS (SELECT *, row_number() OVER (PARTITION BY thread_id, exchange ORDER BY tpos) AS pos, seq % 25 = 0 AS picked, seq % 10 = 0 AS selected FROM x),
b AS (SELECT thread_id, exchange, min(pos) AS lo, max(pos) AS hi, list(sender) AS senders FROM y WHERE picked GROUP BY ALL)
"""
ORACLES = {
    "q_selection_passages_left_out": with_views(f"""+{_X} SELECT thread_id, exchange, count(*) AS n, count(*) FILTER (picked) AS picked, count(*) FILTER (selected AND NOT picked) AS elsewhere,
  count(*) FILTER (NOT picked AND NOT selected AND pos < lo) AS left_before, count(*) FILTER (NOT picked AND NOT selected AND pos BETWEEN lo AND hi) AS left_between, count(*) FILTER (NOT picked AND NOT selected AND pos > hi) AS left_after,
  count(*) FILTER (NOT picked AND NOT selected AND sender IS NOT NULL AND NOT list_contains(senders, sender)) AS other_senders FROM y JOIN b USING (thread_id, exchange) GROUP BY thread_id, exchange"""),
    "q_passage_layout": with_views(f"+{_X} SELECT thread_id, exchange, id, CASE WHEN pos < lo THEN 'before' WHEN pos > hi THEN 'after' ELSE 'between' END AS part FROM y JOIN b USING (thread_id, exchange) WHERE pos BETWEEN lo - 1 AND hi + 1"),
    "q_bundle_round_trip": "SELECT 'customer' AS name, count(*) AS n, true AS ok FROM customer UNION ALL SELECT 'supplier', count(*), true FROM supplier UNION ALL SELECT 'part', count(*), true FROM part",
    "q_exchange_stream": """
WITH e AS (SELECT user_id || '/' || event_type AS thread_id, epoch_us(ts) AS us, event_id FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY thread_id ORDER BY us, event_id) <= 3600000000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY thread_id ORDER BY us, event_id) AS no FROM g)
SELECT thread_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY thread_id, no""",
}
