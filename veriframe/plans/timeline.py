"""Timeline queries: exchanges, quiet stretches, strips, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.operators import timeline as T
from veriframe.sources import adapter
from veriframe.sources.adapter import DAY, with_views

GAP_HOURS, EXPECTED = 20, 3  # the driver's month of events has gaps of days, not weeks


def q_thread_order_context(spark, sf_dir):
    r = adapter.records(spark, sf_dir)
    return T.context(r, r.filter("seq % 20 = 0"), 3, 3)


def q_call_context_asof(spark, sf_dir):
    r = adapter.records(spark, sf_dir)
    return T.around(r.filter("kind = 'call'"), r.filter("kind = 'message'"), 2)


def q_exchanges(spark, sf_dir):
    return T.exchange_spans(adapter.records(spark, sf_dir), 2 * 86_400)


def q_quiet_stretches(spark, sf_dir):
    return T.quiet_stretches(adapter.records(spark, sf_dir), GAP_HOURS, EXPECTED).select("source_id", "scope", "app_key", "thread_key", "start_us", "end_us", F.round("expected", 6).alias("expected"))


def q_gap_elsewhere(spark, sf_dir):
    r = adapter.records(spark, sf_dir)
    return T.elsewhere(T.quiet_stretches(r, GAP_HOURS, EXPECTED), r)


def q_daily_strip_zero_filled(spark, sf_dir):
    return T.daily_strip(adapter.records(spark, sf_dir), "America/New_York")


def q_pace(spark, sf_dir):
    return T.pace(adapter.records(spark, sf_dir)).withColumn("per_day", F.round("per_day", 6))


def _stated(spark, sf_dir):
    c = F.col("claim_id")
    return adapter.claims(spark, sf_dir).select(
        c.alias("stated_id"), "source_id", F.when(c % 17 != 0, F.col("lo")).alias("lo"), F.when(c % 13 != 0, F.col("lo") + (c % 3) * DAY + 1).alias("hi")
    )


def q_stated_overlap(spark, sf_dir):
    r = adapter.records(spark, sf_dir)
    return T.overlapping(_stated(spark, sf_dir), T.quiet_stretches(r, GAP_HOURS, EXPECTED))


def q_window_edges(spark, sf_dir):
    windows = adapter.claims(spark, sf_dir).select(F.col("claim_id").alias("window_id"), "source_id", "lo", "hi")
    return T.window_edges(windows, adapter.records(spark, sf_dir), ["source_id"])


QUERIES = {f.__name__: f for f in (
    q_thread_order_context, q_call_context_asof, q_exchanges, q_quiet_stretches, q_gap_elsewhere, q_daily_strip_zero_filled, q_pace, q_stated_overlap, q_window_edges,
)}

# every locator of the view is "row/<number>" with an optional tail, so the number orders it
_POS = "row_number() OVER (PARTITION BY thread_id ORDER BY us IS NULL, us, seq, locator, id)"
_GAPS = f"""
s AS (SELECT source_id, id, us, 'phone' AS scope, '' AS app_key, '' AS thread_key FROM records WHERE us IS NOT NULL
  UNION ALL SELECT source_id, id, us, 'app', app, '' FROM records WHERE us IS NOT NULL UNION ALL SELECT source_id, id, us, 'thread', app, thread_id FROM records WHERE us IS NOT NULL),
p AS (SELECT source_id, scope, app_key, thread_key, count(*) AS n, CASE WHEN max(us) > min(us) THEN (count(*) - 1) / (max(us) - min(us)) * {DAY} END AS per_day FROM s GROUP BY ALL),
g0 AS (SELECT source_id, scope, app_key, thread_key, us AS start_us, lead(us) OVER (PARTITION BY source_id, scope, app_key, thread_key ORDER BY us, id) AS end_us FROM s),
g AS (SELECT g0.*, per_day * ((end_us - start_us) / {DAY}) AS expected, CASE g0.scope WHEN 'phone' THEN 1 WHEN 'app' THEN 2 ELSE 3 END AS rank
  FROM g0 JOIN p USING (source_id, scope, app_key, thread_key) WHERE end_us - start_us >= {GAP_HOURS} * 3600000000 AND per_day * ((end_us - start_us) / {DAY}) >= {EXPECTED}),
q AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g w WHERE w.source_id = g.source_id AND w.rank < g.rank AND (w.rank = 1 OR w.app_key = g.app_key) AND w.start_us <= g.start_us AND g.end_us <= w.end_us))
"""
ORACLES = {
    "q_thread_order_context": with_views(f"""+
o AS (SELECT thread_id, id, seq, {_POS} AS pos FROM records)
SELECT t.id AS target, o.id, (o.pos - t.pos)::INTEGER AS "offset" FROM o t JOIN o ON o.thread_id = t.thread_id AND o.pos BETWEEN t.pos - 3 AND t.pos + 3 WHERE t.seq % 20 = 0"""),
    "q_call_context_asof": with_views("""+
m AS (SELECT source_id, id, us, row_number() OVER (PARTITION BY source_id ORDER BY us, id) AS pos FROM records WHERE kind = 'message' AND us IS NOT NULL),
c AS (SELECT id AS call_id, source_id, us, (SELECT count(*) FROM m WHERE m.source_id = r.source_id AND m.us < r.us) AS last_pos FROM records r WHERE kind = 'call' AND us IS NOT NULL)
SELECT call_id, m.id, (m.pos - last_pos)::INTEGER AS "offset" FROM c JOIN m ON m.source_id = c.source_id AND m.pos BETWEEN last_pos - 1 AND last_pos + 2"""),
    "q_exchanges": with_views("""+
o AS (SELECT *, lag(us) OVER w AS prev, row_number() OVER w AS pos FROM records WINDOW w AS (PARTITION BY thread_id ORDER BY us IS NULL, us, seq, locator, id)),
x AS (SELECT *, sum(CASE WHEN prev IS NULL OR us IS NULL OR us - prev > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY pos) AS exchange FROM o),
e AS (SELECT thread_id, exchange, count(*) AS n, min(us) AS first_us, max(us) AS last_us, count(DISTINCT sender) AS n_senders FROM x GROUP BY thread_id, exchange)
SELECT thread_id, exchange::BIGINT AS exchange, n, first_us, last_us, n_senders, floor((first_us - lag(last_us) OVER w) / 1000000)::BIGINT AS pause_before_s,
  floor((lead(first_us) OVER w - last_us) / 1000000)::BIGINT AS pause_after_s FROM e WINDOW w AS (PARTITION BY thread_id ORDER BY exchange)"""),
    "q_quiet_stretches": with_views(f"+{_GAPS} SELECT source_id, scope, app_key, thread_key, start_us, end_us, round(expected, 6) AS expected FROM q"),
    "q_gap_elsewhere": with_views(f"""+{_GAPS} SELECT q.source_id, scope, app_key, thread_key, start_us, end_us, r.source_id AS other, count(*) AS n
FROM q JOIN records r ON r.source_id <> q.source_id AND r.us > q.start_us AND r.us < q.end_us GROUP BY ALL"""),
    "q_daily_strip_zero_filled": with_views("""+
t AS (SELECT source_id, app, timezone('America/New_York', make_timestamptz(us))::DATE AS day FROM records WHERE us IS NOT NULL),
b AS (SELECT source_id, min(day) AS first_day, max(day) AS last_day, CASE WHEN max(day) - min(day) > 120 THEN 7 ELSE 1 END AS step FROM t GROUP BY source_id),
s AS (SELECT source_id, unnest(range(first_day::TIMESTAMP, last_day::TIMESTAMP + INTERVAL 1 DAY, to_days(step)))::DATE AS label FROM b),
c AS (SELECT t.source_id, app, first_day + ((day - first_day) // step * step)::INTEGER AS label, count(*) AS n FROM t JOIN b USING (source_id) GROUP BY ALL)
SELECT a.source_id, a.app, s.label, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT DISTINCT source_id, app FROM t) a JOIN s USING (source_id) LEFT JOIN c ON c.source_id = a.source_id AND c.app = a.app AND c.label = s.label"""),
    "q_pace": with_views(f"+{_GAPS} SELECT source_id, scope, app_key, thread_key, n, round(per_day, 6) AS per_day FROM p"),
    "q_stated_overlap": with_views(f"""+{_GAPS},
st AS (SELECT claim_id AS stated_id, source_id, CASE WHEN claim_id % 17 <> 0 THEN lo END AS lo, CASE WHEN claim_id % 13 <> 0 THEN lo + (claim_id % 3) * {DAY} + 1 END AS hi FROM claims)
SELECT stated_id, q.source_id, scope, app_key, thread_key, start_us, end_us FROM st JOIN q ON q.source_id = st.source_id AND (lo IS NULL OR lo < end_us) AND (hi IS NULL OR hi > start_us)"""),
    "q_window_edges": with_views("""
SELECT claim_id AS window_id, b.id AS before_id, b.us AS before_us, a.id AS after_id, a.us AS after_us FROM claims c
LEFT JOIN LATERAL (SELECT id, us FROM records r WHERE r.source_id = c.source_id AND r.us < c.lo ORDER BY us DESC, id DESC LIMIT 1) b ON true
LEFT JOIN LATERAL (SELECT id, us FROM records r WHERE r.source_id = c.source_id AND r.us > c.hi ORDER BY us, id LIMIT 1) a ON true"""),
}
