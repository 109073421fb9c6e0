"""Stated times: paragraphs that state the dates of orders in many ways, and paragraphs that quote records.

The twins do not read the paragraphs: they tell from the dates they were made of what must be found.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.operators import stated as S
from veriframe.session import stored, table
from veriframe.sources.adapter import START, claims, records, with_views


def _dated(spark, sf_dir):
    """Each order's date in one of ten wordings; three orders are a document, so that some lack a year."""
    d, k = F.col("o_orderdate").cast("timestamp_ntz"), F.col("o_orderkey")
    long, day = (lambda c: F.date_format(c, "MMMM d, yyyy")), F.date_format(d, "MMMM d")
    after = lambda n: d + F.make_dt_interval(days=F.lit(n))
    wordings = [
        ("On ", long(d), ", the subject wrote."),
        ("It came at about 9:30 p.m. EST on ", F.date_format(d, "EEEE"), ", ", long(d), "."),
        ("On ", day, " it came."),
        ("No contact between ", day, " and ", long(after(3)), "."),
        ("Before ", long(d), ", nothing was said."),
        ("Since ", F.date_format(d, "M/d/yyyy"), " it reads so."),
        ('He wrote "see you ', day, ', 1990" at 22:05 on ', F.date_format(d, "yyyy-MM-dd"), "."),
        ("On Friday, ", long(d), ", 8 to 9 p.m., they met."),
        ("Mr. A. Bell left. On or about ", long(d), " and later at 9:15 a.m. he rang."),
        ("From ", day, " through ", long(after(-2)), ", so."),
    ]
    text = F.lit(None).cast("string")
    for n, parts in enumerate(wordings):
        text = F.when(k % 10 == n, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise(text)
    return table(spark, sf_dir, "orders").select(F.floor(k / 3).alias("doc"), k.alias("para_id"), text.alias("text"))


def q_stated_readings(spark, sf_dir):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    t = S.stated(_dated(spark, sf_dir))
    return t.select("para_id", F.col("n").cast("long").alias("n"), "raw", F.col("start_i").cast("long").alias("start_i"), F.col("sentence_start").cast("long").alias("sentence_start"), "kind", at("start").alias("lo"), at("end").alias("hi"), "about", "on_or_about", "zone", "weekday_ok", "note")


_ZONES = {"item0": "Etc/GMT+5", "item1": "UTC", "item3": "Asia/Tokyo"}


def _identifier(user):
    return F.concat(F.lit("+1 (555) 0"), F.lpad((F.floor(user / 10000) % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((user % 10000).cast("string"), 4, "0"))


def _told(spark, sf_dir):
    """A paragraph a claim: a day with a quoted message, an open time with a number called, and a moment."""
    day = lambda n: F.date_format(F.timestamp_micros(F.lit(START)) + F.make_dt_interval(days=(F.col("claim_id") * n % 28).cast("int")), "MMMM d, yyyy")
    text = F.concat(
        F.lit("On "), day(1), F.lit(', the subject wrote "'), F.col("quote"), F.lit('". Until 10:05 p.m. on '), day(3), F.lit(" he called "), _identifier(F.element_at("a", 1)),
        F.lit(". Nothing is known of 9:30 a.m. on "), day(5), F.when(F.col("claim_id") % 2 == 0, ".").otherwise(F.lit(", as said.")),
    )
    return claims(spark, sf_dir).select(F.lit("report").alias("doc"), F.col("claim_id").alias("para_id"), text.alias("text"))


def _records(spark, sf_dir):
    zone = F.lit(None).cast("string")
    for source, name in _ZONES.items():
        zone = F.when(F.col("source_id") == source, name).otherwise(zone)
    return records(spark, sf_dir).select("id", "kind", "source_id", "us", "text", zone.alias("zone"), F.array(_identifier(F.col("sender"))).alias("parties"))


def _tied(spark, sf_dir):
    paragraphs = _told(spark, sf_dir)
    times = stored(S.stated(paragraphs))
    marks = stored(S.marks(paragraphs, times, spark.createDataFrame([("note 7",)], "name string")))
    held = _records(spark, sf_dir)
    return times, held, S.compared(marks, S.tied(marks, held), times, held)


def q_time_ties(spark, sf_dir):
    times, held, ties = _tied(spark, sf_dir)
    return ties.select(F.col("stated_id.para_id").alias("para_id"), "how", "words", "relation", "id", "state", "delta_us", "conflict", F.col("no").cast("long").alias("no"), "total")


def q_stated_status(spark, sf_dir):
    times, held, ties = _tied(spark, sf_dir)
    return S.statuses(times, ties).select("para_id", F.col("n").cast("long").alias("n"), "status")


def q_near_untied(spark, sf_dir):
    times, held, ties = _tied(spark, sf_dir)
    return S.near_untied(times, ties, held).select(F.col("stated_id.para_id").alias("para_id"), "id", "state", "delta_us", F.col("no").cast("long").alias("no"), "total")


QUERIES = {f.__name__: f for f in (q_stated_readings, q_time_ties, q_stated_status, q_near_untied)}

_TOLD = f"""+
times AS (SELECT claim_id AS para_id, a, quote, {START} + claim_id % 28 * 86400000000 AS d1, {START} + claim_id * 3 % 28 * 86400000000 AS d2, {START} + claim_id * 5 % 28 * 86400000000 AS d3 FROM claims),
held AS (SELECT id, kind, source_id, us, text, sender, CASE source_id WHEN 'item0' THEN -18000000000 WHEN 'item1' THEN 0 WHEN 'item3' THEN 32400000000 END AS off FROM records),
named AS (SELECT *, '+1 (555) 0' || lpad((a // 10000 % 100)::VARCHAR, 2, '0') || '-' || lpad((a % 10000)::VARCHAR, 4, '0') AS number FROM times),
marks AS (SELECT para_id, 'quote' AS how, quote AS words, a, d1 AS lo, d1 + 86400000000 AS hi FROM named WHERE quote <> 'note 7'
  UNION ALL SELECT para_id, 'number', number, a, NULL, d2 + 79560000000 FROM named),
met AS (SELECT m.*, r.id, r.source_id, r.us, r.off, m.lo - r.off AS l, m.hi - r.off AS h FROM marks m JOIN held r
  ON (m.how = 'quote' AND r.kind = 'message' AND r.text = m.words) OR (m.how = 'number' AND r.kind = 'call' AND r.sender = m.a)),
apart AS (SELECT *, CASE WHEN us IS NULL OR off IS NULL THEN NULL WHEN us < l THEN us - l WHEN us >= h THEN us - h ELSE 0 END AS delta_us FROM met),
ranked AS (SELECT *, row_number() OVER (PARTITION BY para_id, how ORDER BY delta_us IS NULL, abs(delta_us), source_id, id) AS no, count(*) OVER (PARTITION BY para_id, how) AS total,
  CASE WHEN us IS NULL THEN 'no_time' WHEN off IS NULL THEN 'no_zone' WHEN delta_us = 0 THEN 'inside' WHEN abs(delta_us) <= 300000000 THEN 'within' ELSE 'differs' END AS state FROM apart),
ties AS (SELECT m.para_id, m.how, m.words, 'at' AS relation, r.id, r.state, r.delta_us, CASE WHEN r.id IS NOT NULL THEN false END AS conflict, r.no, coalesce(r.total, 0) AS total
  FROM marks m LEFT JOIN (SELECT * FROM ranked WHERE no <= 4) r USING (para_id, how))"""

ORACLES = {
    "q_stated_readings": """WITH o AS (SELECT o_orderkey AS k, o_orderkey // 3 AS doc, o_orderkey % 10 AS t, o_orderdate::DATE AS d FROM orders),
w AS (SELECT *, strftime(d, '%B %-d') AS md, strftime(d, '%B %-d, %Y') AS full_d, strftime(d + 3, '%B %-d, %Y') AS d3, strftime(d - 2, '%B %-d, %Y') AS d2,
  CASE t WHEN 2 THEN [] WHEN 3 THEN [year(d + 3)] WHEN 6 THEN [1990, year(d)] WHEN 9 THEN [year(d - 2)] ELSE [year(d)] END AS ys FROM o),
y AS (SELECT doc, list_distinct(flatten(list(ys))) AS pool FROM w GROUP BY doc),
x AS (SELECT w.*, CASE WHEN len(pool) = 1 THEN make_date(pool[1], month(d), day(d)) END AS lone, len(pool) AS many FROM w JOIN y USING (doc)),
r AS (
SELECT k, 1 AS n, full_d AS raw, 3 AS start_i, 0 AS ss, 'day' AS kind, d::TIMESTAMP AS lo, (d + 1)::TIMESTAMP AS hi, false AS about, false AS ooa, NULL AS zone, NULL AS wd, NULL AS note FROM x WHERE t = 0
UNION ALL SELECT k, 1, 'at about 9:30 p.m. EST on ' || strftime(d, '%A') || ', ' || full_d, 8, 0, 'moment', d + INTERVAL '21 hours 22 minutes', d + INTERVAL '21 hours 39 minutes', true, false, 'Etc/GMT+5', true, NULL FROM x WHERE t = 1
UNION ALL SELECT k, 1, md, 3, 0, CASE WHEN lone IS NULL THEN 'unread' ELSE 'day' END, lone::TIMESTAMP, (lone + 1)::TIMESTAMP, false, false, NULL, NULL, CASE WHEN many = 0 THEN 'no_year' WHEN many > 1 THEN 'several_years' END FROM x WHERE t = 2
UNION ALL SELECT k, 1, 'between ' || md || ' and ' || d3, 11, 0, CASE WHEN year(d + 3) > year(d) THEN 'unread' ELSE 'range' END, CASE WHEN year(d + 3) = year(d) THEN d::TIMESTAMP END, CASE WHEN year(d + 3) = year(d) THEN (d + 4)::TIMESTAMP END, false, false, NULL, NULL, CASE WHEN year(d + 3) > year(d) THEN 'range_reversed' END FROM x WHERE t = 3
UNION ALL SELECT k, 1, 'Before ' || full_d, 0, 0, 'open', NULL, d::TIMESTAMP, false, false, NULL, NULL, NULL FROM x WHERE t = 4
UNION ALL SELECT k, 1, strftime(d, '%-m/%-d/%Y'), 6, 0, 'ambiguous', NULL, NULL, false, false, NULL, NULL, 'either_order' FROM x WHERE t = 5 AND day(d) <= 12 AND day(d) <> month(d)
UNION ALL SELECT k, 1, 'Since ' || strftime(d, '%-m/%-d/%Y'), 0, 0, 'open', d::TIMESTAMP, NULL, false, false, NULL, NULL, NULL FROM x WHERE t = 5 AND (day(d) > 12 OR day(d) = month(d))
UNION ALL SELECT k, 1, 'at 22:05 on ' || strftime(d, '%Y-%m-%d'), length('He wrote "see you ' || md || ', 1990" '), 0, 'moment', d + INTERVAL '22 hours 5 minutes', d + INTERVAL '22 hours 6 minutes', false, false, NULL, NULL, NULL FROM x WHERE t = 6
UNION ALL SELECT k, 1, 'Friday, ' || full_d || ', 8 to 9 p.m.', 3, 0, 'moment', d + INTERVAL '20 hours', d + INTERVAL '21 hours', false, false, NULL, dayofweek(d) = 5, NULL FROM x WHERE t = 7
UNION ALL SELECT k, 1, 'On or about ' || full_d, 18, 18, 'day', d::TIMESTAMP, (d + 1)::TIMESTAMP, false, true, NULL, NULL, NULL FROM x WHERE t = 8
UNION ALL SELECT k, 2, '9:15 a.m.', length('Mr. A. Bell left. On or about ' || full_d || ' and later at '), 18, 'unread', NULL, NULL, false, false, NULL, NULL, 'no_date_beside' FROM x WHERE t = 8
UNION ALL SELECT k, 1, 'From ' || md || ' through ' || d2, 0, 0, CASE WHEN year(d - 2) = year(d) THEN 'unread' ELSE 'range' END, CASE WHEN year(d - 2) < year(d) THEN make_date(year(d - 2), month(d), day(d))::TIMESTAMP END, CASE WHEN year(d - 2) < year(d) THEN (d - 1)::TIMESTAMP END, false, false, NULL, NULL, CASE WHEN year(d - 2) = year(d) THEN 'range_reversed' END FROM x WHERE t = 9)
SELECT k AS para_id, n::BIGINT AS n, raw, start_i::BIGINT AS start_i, ss::BIGINT AS sentence_start, kind, strftime(lo, '%Y-%m-%d %H:%M') AS lo, strftime(hi, '%Y-%m-%d %H:%M') AS hi, about, ooa AS on_or_about, zone, wd AS weekday_ok, note FROM r""",
    "q_time_ties": with_views(_TOLD + " SELECT * FROM ties"),
    "q_stated_status": with_views(_TOLD + """, s AS (SELECT para_id, how, bool_or(state IN ('inside', 'within')) AS ok, bool_or(delta_us IS NOT NULL) AS timed FROM ties GROUP BY ALL)
SELECT para_id, i.n::BIGINT AS n, CASE WHEN i.n = 3 THEN 'not_tied' WHEN ok THEN 'matches' WHEN timed THEN 'differs' ELSE 'not_tied' END AS status
FROM times CROSS JOIN (VALUES (1, 'quote'), (2, 'number'), (3, 'none')) i(n, how) LEFT JOIN s USING (para_id, how)"""),
    "q_near_untied": with_views(_TOLD + """, near AS (SELECT para_id, id, source_id, CASE WHEN us < d3 + 34200000000 - off THEN us - (d3 + 34200000000 - off) WHEN us >= d3 + 34260000000 - off THEN us - (d3 + 34260000000 - off) ELSE 0 END AS delta_us
  FROM times JOIN held ON us BETWEEN d3 + 34200000000 - off - 300000000 AND d3 + 34260000000 - off + 300000000)
SELECT * FROM (SELECT para_id, id, CASE WHEN delta_us = 0 THEN 'inside' ELSE 'within' END AS state, delta_us, row_number() OVER (PARTITION BY para_id ORDER BY abs(delta_us), source_id, id) AS no, count(*) OVER (PARTITION BY para_id) AS total FROM near) WHERE no <= 6"""),
}
