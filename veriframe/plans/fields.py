"""Field readers and small record look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions import fields as P
from veriframe.functions import text as T
from veriframe.session import table
from veriframe.sources import adapter
from veriframe.sources.adapter import with_views

_DIRECTIONS = ("Incoming call", "sent", " Dialed ", "missed", "INBOX", "unknown")
_DELETED = ("Yes", "no", "", "maybe")
_OFFSETS = ("+5", "-05:00", "+0530", "", "-3:30")


def _pick(names, c):
    return F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))


def q_field_parsers(spark, sf_dir):
    k = F.col("o_orderkey")
    cell = _pick(_DIRECTIONS, k)
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), P.message_direction(cell).alias("message"), P.call_direction(cell).alias("call"), P.deleted_flag(_pick(_DELETED, k)).alias("deleted"), P.offset_minutes(_pick(_OFFSETS, k)).alias("offset_min"),
        P.is_forwarded(F.when(k % 3 == 0, "Auto-forwarded, Starred").when(k % 3 == 1, "straightforward")).alias("forwarded"),
    )


def q_zone_names(spark, sf_dir):
    k = F.col("n_nationkey")
    raw = _pick(("America/New_York", "(UTC-05:00)  New_York  (America)", "(UTC-08:00) Pacific Time (US & Canada)", "(GMT) Coordinated Universal Time", "somewhere"), k)
    return table(spark, sf_dir, "nation").select(k.alias("id"), P.zone_name(raw).alias("zone"))


def q_chat_members(spark, sf_dir):
    r = adapter.records(spark, sf_dir).select("thread_id", F.explode(F.array_compact(F.concat(F.array("sender"), "recipients"))).alias("account"))
    return r.groupBy("thread_id").agg(F.array_join(F.array_sort(F.collect_set("account")).cast("array<string>"), ",").alias("members"))


def q_source_counts(spark, sf_dir):
    r = adapter.records(spark, sf_dir)
    return r.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "call").alias("n_calls"), F.count_if(F.col("us").isNull()).alias("n_untimed"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def q_cited_records(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'")
    return li.groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.array_join(F.array_sort(F.collect_set("l_partkey")).cast("array<string>"), ",").alias("cited"))


def q_seeded_errors(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), P.seeded_draw("s1", k.cast("string"), 0.1).alias("errs"), P.short_hash(k.cast("string"), F.col("o_orderstatus")).alias("hash12"))


def q_digits_preserved(spark, sf_dir):
    k = F.col("event_id")
    changed = F.when(k % 4 == 0, F.concat("props", F.lit(" 7"))).when(k % 4 == 1, F.replace("props", F.lit("k"), F.lit("z"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(k.alias("id"), P.digits_preserved(F.col("props"), changed).alias("same"))


def q_flag_events(spark, sf_dir):
    """Flags that were added and not withdrawn later."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 3000).alias("flag_id"), "event_id", (F.col("event_type") == "error").alias("withdraw"))
    last = e.groupBy("flag_id").agg(F.max_by("withdraw", "event_id").alias("withdrawn"), F.count("*").alias("n"))
    return last.filter("NOT withdrawn").select("flag_id", "n")


def q_near_miss_lines(spark, sf_dir):
    """Benchmark openings that a conversation's turn nearly quotes. Turns that hold half or more of
    the opening's words of five letters or more are read."""
    opening = F.array_join(F.slice(F.split("text", r"\s+"), 1, 6), " ")
    long = lambda c: F.array_distinct(F.filter(T.tokens(c), lambda w: F.length(w) >= 5))
    quotes = table(spark, sf_dir, "benchmark").select("item_id", opening.alias("quote"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    asked = quotes.select("item_id", F.size(long(F.col("quote"))).alias("n_long"), F.explode(long(F.col("quote"))).alias("word"))
    held = asked.join(turns.select("conv_id", "turn", F.explode(long(F.col("text"))).alias("word")), "word")
    pairs = held.groupBy("item_id", "conv_id", "turn", "n_long").agg(F.count("*").alias("n")).filter("2 * n >= n_long").select("item_id", "conv_id", "turn")
    read = pairs.join(quotes, "item_id").join(turns, ["conv_id", "turn"]).withColumn("near", T.near_miss("quote", "text"))
    return read.groupBy("item_id").agg(F.count("*").alias("n_read"), F.count_if(F.col("near")).alias("n_near"))


QUERIES = {f.__name__: f for f in (q_field_parsers, q_zone_names, q_chat_members, q_source_counts, q_cited_records, q_seeded_errors, q_digits_preserved, q_flag_events, q_near_miss_lines)}


def _case(values, key, other="NULL"):
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


ORACLES = {
    "q_field_parsers": f"""SELECT o_orderkey AS id, {_case({0: "'incoming'", 1: "'outgoing'", 4: "'incoming'"}, 'o_orderkey % 6')} AS message, {_case({0: "'incoming'", 2: "'outgoing'", 3: "'missed'"}, 'o_orderkey % 6')} AS "call",
{_case({0: 'true', 1: 'false'}, 'o_orderkey % 4')} AS deleted, {_case({0: 300, 1: -300, 2: 330, 3: 0, 4: -210}, 'o_orderkey % 5')}::INTEGER AS offset_min, o_orderkey % 3 = 0 AS forwarded FROM orders""",
    "q_zone_names": f"SELECT n_nationkey AS id, {_case({0: chr(39) + 'America/New_York' + chr(39), 1: chr(39) + 'America/New_York' + chr(39), 2: chr(39) + 'America/Los_Angeles' + chr(39), 3: chr(39) + 'UTC' + chr(39)}, 'n_nationkey % 5')} AS zone FROM nation",
    "q_chat_members": with_views("SELECT thread_id, string_agg(account::VARCHAR, ',' ORDER BY account) AS members FROM (SELECT thread_id, sender AS account FROM records WHERE sender IS NOT NULL UNION SELECT thread_id, recipient FROM records) GROUP BY thread_id"),
    "q_source_counts": with_views("SELECT source_id, count(*) AS n, count(*) FILTER (kind = 'call') AS n_calls, count(*) FILTER (us IS NULL) AS n_untimed, min(us) AS first_us, max(us) AS last_us FROM records GROUP BY source_id"),
    "q_cited_records": "SELECT claim_id, string_agg(p::VARCHAR, ',' ORDER BY p) AS cited FROM (SELECT DISTINCT l_orderkey AS claim_id, l_partkey AS p FROM lineitem WHERE l_returnflag <> 'R') GROUP BY claim_id",
    "q_seeded_errors": """SELECT o_orderkey AS id, ('0x' || left(sha256('s1:' || o_orderkey), 16))::UBIGINT / 18446744073709551616 < 0.1 AS errs, left(sha256('["' || o_orderkey || '","' || o_orderstatus || '"]'), 12) AS hash12 FROM orders""",
    "q_digits_preserved": r"SELECT event_id AS id, event_id % 4 <> 0 OR list_contains(regexp_extract_all(props, '\d+'), '7') AS same FROM events",
    "q_flag_events": "SELECT flag_id, n FROM (SELECT event_id % 3000 AS flag_id, count(*) AS n, arg_max(event_type, event_id) AS last FROM events GROUP BY 1) WHERE last <> 'error'",
}
