"""Counter-evidence and ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.operators import alternatives as H
from veriframe.operators import ingest as S
from veriframe.session import table
from veriframe.sources import adapter
from veriframe.sources.adapter import with_views


def _both(spark, sf_dir):
    return adapter.claims(spark, sf_dir), adapter.records(spark, sf_dir)


def q_other_clock(spark, sf_dir):
    return H.other_clock(*_both(spark, sf_dir), offset_min=-300)


def q_day_boundary(spark, sf_dir):
    return H.day_boundary(*_both(spark, sf_dir), zone="America/New_York")


def q_other_app(spark, sf_dir):
    return H.other_app(*_both(spark, sf_dir))


def q_app_quiet(spark, sf_dir):
    claims, records = _both(spark, sf_dir)
    short = claims.withColumn("hi", F.col("lo") + 3_600_000_000 * (1 + F.col("claim_id") % 5))
    return H.app_quiet(short, records)


def q_curated(spark, sf_dir):
    claims, records = _both(spark, sf_dir)
    return H.curated(claims, adapter.sources(records))


def q_same_words_elsewhere(spark, sf_dir):
    return H.same_words_elsewhere(*_both(spark, sf_dir))


def q_multi_owner(spark, sf_dir):
    records = adapter.records(spark, sf_dir)
    moved = F.when(F.col("seq") % 199 == 0, "item9").otherwise(F.col("source_id"))  # some accounts also send from another phone
    return H.multi_owner(records.withColumn("source_id", moved))


def q_handoffs(spark, sf_dir):
    claims, records = _both(spark, sf_dir)
    claimed = claims.select("claim_id", "source_id", F.col("lo").alias("us"))
    return H.handoffs(claimed, records, "^note 7")


def _cells(spark, sf_dir):
    """Time cells as reports print them, in several styles by region of the key."""
    d, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    style = F.col("o_custkey") % 7
    cell = (
        F.when(style == 0, F.date_format(d, "M/d/yyyy h:mm:ss a")).when(style == 1, F.concat(F.date_format(d, "d/M/yyyy HH:mm"), F.lit("(UTC-4)"))).when(style == 2, F.concat(F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC+02:30")))
        .when(style == 3, F.date_format(d, "M/d/yyyy")).when(style == 4, F.date_format(d, "M/d/yy HH:mm")).when(style == 5, F.lit("yesterday")).otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("s"), style).alias("sheet"), (style * 1).cast("int").alias("style"), cell.alias("cell"))


def q_date_order_votes(spark, sf_dir):
    return S.date_order(_cells(spark, sf_dir), "sheet", "cell")


def q_time_parse_problems(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    orders = S.date_order(cells, "sheet", "cell").select("sheet", "date_order")
    offset = F.when(F.col("style") == 0, -300).cast("int")
    return S.parse_times(cells.join(orders, "sheet").withColumn("offset_min", offset), "cell", "date_order", "offset_min").select("id", "problem", "us")


def q_furniture_lines(spark, sf_dir):
    """Margin lines of pages: a running head, a numbered foot, and the first and last line of the text."""
    lines = F.split("text", "\n")
    foot = F.concat(F.lit("Page "), F.col("doc_id"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(" of the case file"))
    margin = F.array(F.concat(F.lit("Case "), F.col("source")), F.element_at(lines, 1), F.element_at(lines, -1), foot)
    pages = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.explode(margin).alias("text"))
    return S.furniture(pages)


def q_stated_times(spark, sf_dir):
    """Paragraphs that state the dates of orders, some without a year."""
    d, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    text = F.concat(
        F.lit("It was sent on "), F.date_format(d, "MMMM d"), F.when(k % 3 != 0, F.date_format(d, ", yyyy")).otherwise(""), F.when(k % 2 == 0, ", at about 9:30 p.m.").otherwise(""), F.lit(" and read later.")
    )
    paragraphs = table(spark, sf_dir, "orders").select((F.floor(k / 3)).alias("doc"), k.alias("para"), text.alias("text"))
    return S.stated_times(paragraphs, "text", "America/New_York")


def q_coverage_summary(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    orders = S.date_order(cells, "sheet", "cell").select("sheet", "date_order")
    parsed = S.parse_times(cells.join(orders, "sheet").withColumn("offset_min", F.when(F.col("style") == 0, -300).cast("int")), "cell", "date_order", "offset_min")
    return parsed.groupBy("sheet", F.coalesce("problem", F.lit("read")).alias("reason")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    q_other_clock, q_day_boundary, q_other_app, q_app_quiet, q_curated, q_same_words_elsewhere, q_multi_owner, q_handoffs, q_date_order_votes, q_time_parse_problems,
    q_furniture_lines, q_stated_times, q_coverage_summary,
)}

_PAIR = "((r.sender = c.a AND r.recipient = c.b) OR (r.sender = c.b AND r.recipient = c.a))"
_FITS = "SELECT claim_id, id, no::INTEGER AS no, total FROM (SELECT *, count(*) OVER (PARTITION BY claim_id) AS total FROM x) WHERE no <= 6"


def _x(where, order="us, id", more=""):
    return with_views(f"""+{more} x AS (SELECT c.claim_id, r.id, row_number() OVER (PARTITION BY c.claim_id ORDER BY {order}) AS no FROM claims c JOIN records r ON r.source_id = c.source_id AND {_PAIR} WHERE {where}) {_FITS}""")


_DAYS = "{}::DATE BETWEEN make_timestamp(lo)::DATE AND make_timestamp(hi)::DATE"
_CELLS = """
cl AS (SELECT o_orderkey AS id, o_custkey % 7 AS style, CASE o_custkey % 7 WHEN 0 THEN strftime(o_orderdate, '%-m/%-d/%Y %-I:%M:%S %p') WHEN 1 THEN strftime(o_orderdate, '%-d/%-m/%Y %H:%M') || '(UTC-4)'
  WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' UTC+02:30' WHEN 3 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 4 THEN strftime(o_orderdate, '%-m/%-d/%y %H:%M') WHEN 5 THEN 'yesterday' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS cell,
  o_orderdate FROM orders),
vo AS (SELECT 's' || style AS sheet, style, count(*) FILTER (style = 1 AND day(o_orderdate) > 12) AS n_dmy, count(*) FILTER (style IN (0, 3, 4) AND day(o_orderdate) > 12) AS n_mdy FROM cl GROUP BY style),
pr AS (SELECT id, style, CASE style WHEN 5 THEN 'unreadable' WHEN 4 THEN 'two_digit_year' WHEN 3 THEN 'date_only' WHEN 6 THEN 'no_offset' END AS problem,
  CASE style WHEN 0 THEN epoch_us(o_orderdate) + 18000000000 WHEN 1 THEN epoch_us(o_orderdate) + 14400000000 WHEN 2 THEN epoch_us(o_orderdate) - 9000000000 END AS us FROM cl)
"""
ORACLES = {
    "q_other_clock": _x("us IS NOT NULL AND NOT us BETWEEN lo AND hi AND us - 18000000000 BETWEEN lo AND hi"),
    "q_day_boundary": _x(f"us IS NOT NULL AND ({_DAYS.format('make_timestamp(us)')}) <> ({_DAYS.format(chr(39).join(['timezone(', 'America/New_York', ', make_timestamptz(us))']))})"),
    "q_other_app": _x("len(channels) > 0 AND us BETWEEN lo AND hi AND NOT (list_contains(channels, app) OR (kind = 'call' AND list_contains(channels, 'call')))"),
    "q_app_quiet": with_views("""+
c2 AS (SELECT claim_id, source_id, lo, lo + 3600000000 * (1 + claim_id % 5) AS hi FROM claims),
a AS (SELECT claim_id, app, count(*) FILTER (us BETWEEN lo AND hi) AS n, arg_max(id, (us, id)) FILTER (us < lo) AS last_before, arg_min(id, (us, id)) FILTER (us > hi) AS first_after
  FROM c2 JOIN records r ON r.source_id = c2.source_id WHERE us IS NOT NULL GROUP BY claim_id, app),
o AS (SELECT *, sum(n) OVER (PARTITION BY claim_id)::BIGINT AS n_others FROM a)
SELECT claim_id, app, last_before, first_after, n_others FROM o WHERE n = 0 AND n_others > 0"""),
    "q_curated": with_views("SELECT claim_id, c.source_id, fidelity FROM claims c JOIN sources s ON s.source_id = c.source_id WHERE fidelity <> 'full_extraction'"),
    "q_same_words_elsewhere": _x("r.text IS NOT NULL AND r.text <> c.quote", "us IS NULL, us, id"),
    "q_multi_owner": with_views("SELECT sender AS account, count(DISTINCT CASE WHEN seq % 199 = 0 THEN 'item9' ELSE source_id END) AS n_sources FROM records WHERE sender IS NOT NULL GROUP BY sender HAVING count(DISTINCT CASE WHEN seq % 199 = 0 THEN 'item9' ELSE source_id END) > 1"),
    "q_handoffs": with_views(f"""+
x AS (SELECT claim_id, r.id, row_number() OVER (PARTITION BY claim_id ORDER BY abs(r.us - c.lo), r.id) AS no FROM claims c JOIN records r ON r.source_id = c.source_id AND starts_with(r.text, 'note 7') AND abs(r.us - c.lo) <= 172800000000) {_FITS}"""),
    "q_date_order_votes": f"WITH {_CELLS} SELECT sheet, n_dmy, n_mdy, CASE WHEN n_dmy > 0 AND n_mdy > 0 THEN 'conflict' WHEN n_dmy > 0 THEN 'dmy' WHEN n_mdy > 0 THEN 'mdy' ELSE 'undecided' END AS date_order FROM vo",
    "q_time_parse_problems": f"WITH {_CELLS} SELECT id, problem, us FROM pr",
    "q_furniture_lines": r"""
WITH l AS (SELECT source AS doc, doc_id AS page, unnest(['Case ' || source, string_split(text, chr(10))[1], string_split(text, chr(10))[-1], 'Page ' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ' of the case file' END]) AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY doc),
t AS (SELECT doc, trim(regexp_replace(text, '\d+', '#', 'g')) AS shape, count(DISTINCT page) AS n FROM l GROUP BY 1, 2)
SELECT t.doc, shape, n FROM t JOIN p USING (doc) WHERE n >= 2 AND n >= 0.6 * pages AND shape <> ''""",
    "q_coverage_summary": f"WITH {_CELLS} SELECT 's' || style AS sheet, coalesce(problem, 'read') AS reason, count(*) AS n FROM pr GROUP BY 1, 2",
}
