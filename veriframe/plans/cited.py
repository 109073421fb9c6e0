"""Quotes that must cite a record's own fields, and where documents write the aliases of items."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.operators import cited as C
from veriframe.session import table
from veriframe.sources.adapter import records, with_views


def _number(user):
    return F.concat(F.lit("+1 555 "), F.lpad(user.cast("string"), 7, "0"))


def q_cited_calls(spark, sf_dir):
    """Every call as it is shown, and four kinds of quotes: a length, words around a missing field, the app
    with words around it, and a number cut short."""
    calls = records(spark, sf_dir).filter("kind = 'call'")
    sender = F.when(F.col("sender").isNotNull(), _number(F.col("sender")))
    receiver = _number(F.get("recipients", F.lit(0)))
    direction = F.when(F.col("seq") % 3 == 0, "incoming").when(F.col("seq") % 3 == 1, "outgoing")
    line, own = C.call_line(F.col("app"), direction, sender, receiver, F.col("duration_s"))
    quote = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("duration "), F.coalesce(F.col("duration_s").cast("string"), F.lit("unknown")))).when(F.col("seq") % 4 == 1, "from unknown to")
    quote = quote.when(F.col("seq") % 4 == 2, F.concat("app", F.lit(" call from"))).otherwise(F.left(receiver, F.lit(13)))
    rows = calls.select("id", line.alias("line"), own.alias("own"), quote.alias("quote"))
    return rows.select("id", "line", F.size("own").cast("long").alias("n_own"), "quote", C.cites(F.col("quote"), F.col("line"), F.col("own")).alias("cites"))


def q_cited_contacts(spark, sf_dir):
    """Every customer as a contact, each fifth without a name."""
    k = F.col("c_custkey")
    name = F.when(k % 5 != 0, F.col("c_name"))
    line, own = C.contact_line(name, _number(k))
    quote = F.when(k % 6 == 0, F.left(line, F.lit(8))).when(k % 6 == 3, F.left(line, F.lit(7))).when(k % 3 == 1, F.concat(F.lit(": "), _number(k))).otherwise(": ")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), line.alias("line"), own.alias("own"), quote.alias("quote"))
    return rows.select("id", "line", "quote", C.cites(F.col("quote"), F.col("line"), F.col("own")).alias("cites"))


def q_alias_places(spark, sf_dir):
    """Every place where a document writes the first two words of a benchmark item, in any case and with any marks between."""
    first = F.regexp_extract("text", r"^\s*(\S+\s+\S+)", 1)
    aliases = table(spark, sf_dir, "benchmark").select(first.alias("alias")).filter("alias <> ''").distinct().select(F.col("alias").alias("alias_id"), "alias")
    texts = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("text_id"), "text")
    return C.alias_places(aliases, texts).select(F.col("alias_id").alias("alias"), F.col("text_id").alias("doc_id"), F.col("start").cast("long").alias("lo"), F.col("end").cast("long").alias("hi"), "lowered")


QUERIES = {f.__name__: f for f in (q_cited_calls, q_cited_contacts, q_alias_places)}

ORACLES = {
    "q_cited_calls": with_views("""+
c AS (SELECT seq, id, app, duration_s, CASE WHEN seq % 3 = 0 THEN 'incoming' WHEN seq % 3 = 1 THEN 'outgoing' END AS dir, sender,
  '+1 555 ' || lpad(recipient::VARCHAR, 7, '0') AS receiver FROM records WHERE kind = 'call')
SELECT id, coalesce(dir, 'unknown') || ' ' || app || ' call from ' || coalesce('+1 555 ' || lpad(sender::VARCHAR, 7, '0'), 'unknown') || ' to ' || receiver || ', duration ' || coalesce(duration_s || ' s', 'unknown') AS line,
  (2 + (dir IS NOT NULL)::INT + (sender IS NOT NULL)::INT + (duration_s IS NOT NULL)::INT)::BIGINT AS n_own,
  CASE seq % 4 WHEN 0 THEN 'duration ' || coalesce(duration_s::VARCHAR, 'unknown') WHEN 1 THEN 'from unknown to' WHEN 2 THEN app || ' call from' ELSE left(receiver, 13) END AS quote,
  CASE seq % 4 WHEN 0 THEN duration_s IS NOT NULL WHEN 2 THEN true ELSE false END AS cites FROM c"""),
    "q_cited_contacts": """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_name ELSE '(no name)' END || ': +1 555 ' || lpad(c_custkey::VARCHAR, 7, '0') AS line, c_custkey % 3 AS q FROM customer)
SELECT id, line, CASE WHEN id % 6 = 0 THEN left(line, 8) WHEN q = 0 THEN left(line, 7) WHEN q = 1 THEN ': +1 555 ' || lpad(id::VARCHAR, 7, '0') ELSE ': ' END AS quote,
  CASE q WHEN 0 THEN id % 5 <> 0 AND id % 6 = 0 WHEN 1 THEN true ELSE false END AS cites FROM c""",
}
