"""Counter-evidence: what else could explain a claim. Each search answers with at most ``most``
records a claim, in a fixed order, and with the total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.predicates import channel_ok, in_window
from veriframe.functions.text import tokens
from veriframe.operators.checks import between_parties
from veriframe.operators.timeline import counts_between, nearest_few, window_edges

MOST = 6


def fits(rows: DataFrame, *order: Column, most: int = MOST) -> DataFrame:
    """(claim_id, id, no, total) of the first ``most`` rows of each claim."""
    w = Window.partitionBy("claim_id")
    found = rows.withColumn("no", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))
    return found.filter(F.col("no") <= most).select("claim_id", "id", "no", "total")


def _windowed(claims: DataFrame, records: DataFrame) -> DataFrame:
    terms = claims.select("claim_id", "lo", "hi", "channels", F.col("source_id").alias("on_source"))
    return between_parties(claims, records).join(terms, "claim_id")


def other_clock(claims: DataFrame, records: DataFrame, offset_min: int) -> DataFrame:
    """Records outside the window that another clock, off by ``offset_min``, puts inside."""
    rows = _windowed(claims, records)
    shifted = F.col("us") + offset_min * 60_000_000
    return fits(rows.filter(F.col("us").isNotNull() & ~in_window(F.col("us"), F.col("lo"), F.col("hi")) & in_window(shifted, F.col("lo"), F.col("hi"))), F.col("us"), F.col("id"))


def day_boundary(claims: DataFrame, records: DataFrame, zone: str) -> DataFrame:
    """Records that the days of the window hold in UTC or in the zone, but not in both."""
    rows = _windowed(claims, records).filter("us IS NOT NULL")
    at = F.timestamp_micros("us")
    days = lambda t: F.to_date(t).between(F.to_date(F.timestamp_micros("lo")), F.to_date(F.timestamp_micros("hi")))
    return fits(rows.filter(days(at) != days(F.from_utc_timestamp(at, zone))), F.col("us"), F.col("id"))


def other_app(claims: DataFrame, records: DataFrame) -> DataFrame:
    """Contact of the parties inside the window on a channel the claim does not name."""
    rows = _windowed(claims.filter("size(channels) > 0"), records)
    rows = rows.filter(in_window(F.col("us"), F.col("lo"), F.col("hi")) & ~channel_ok(F.col("kind"), F.col("app"), F.col("channels")))
    return fits(rows, F.col("us"), F.col("id"))


def app_quiet(claims: DataFrame, records: DataFrame) -> DataFrame:
    """(claim_id, app, last_before, first_after, n_others): apps of the claim's source without any
    record in the window while others have some, with the records at its edges."""
    apps = records.filter("us IS NOT NULL").select("source_id", "app").distinct()
    asked = claims.select("claim_id", "source_id", "lo", "hi").join(apps, "source_id")
    asked = asked.withColumn("window_id", F.xxhash64("claim_id", "app"))
    n = counts_between(asked, records, ["source_id", "app"]).select("window_id", "n")
    edges = window_edges(asked, records, ["source_id", "app"]).select("window_id", F.col("before_id").alias("last_before"), F.col("after_id").alias("first_after"))
    by_app = asked.join(n, "window_id", "left").fillna(0, ["n"]).join(edges, "window_id")
    others = F.sum("n").over(Window.partitionBy("claim_id"))
    return by_app.withColumn("n_others", others).filter("n = 0 AND n_others > 0").select("claim_id", "app", "last_before", "first_after", "n_others")


def curated(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims on sources that may leave records out."""
    return claims.select("claim_id", "source_id").join(sources.filter("fidelity <> 'full_extraction'"), "source_id").select("claim_id", "source_id", "fidelity")


def same_words_elsewhere(claims: DataFrame, records: DataFrame, letters: int = 4) -> DataFrame:
    """Records of the parties that share a long word of the quote but are no copy of it, the most
    shared first; words meet by an equi-join."""
    asked = claims.select("claim_id", "quote", F.explode(F.array_distinct(tokens(F.col("quote")))).alias("word")).filter(F.length("word") >= letters)
    held = between_parties(claims, records.filter("text IS NOT NULL"), same_source=True).select("claim_id", "id", "us", "text", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    hit = asked.join(held, ["claim_id", "word"]).filter("text <> quote").groupBy("claim_id", "id", "us").agg(F.count("*").alias("shared"))
    return fits(hit, F.desc("shared"), F.col("us").isNull(), F.col("us"), F.col("id"))


def multi_owner(records: DataFrame) -> DataFrame:
    """Accounts that send from more than one source: (account, n_sources)."""
    sent = records.filter("sender IS NOT NULL").groupBy(F.col("sender").alias("account")).agg(F.count_distinct("source_id").alias("n_sources"))
    return sent.filter("n_sources > 1")


def handoffs(claimed: DataFrame, records: DataFrame, phrase: str, days: int = 2) -> DataFrame:
    """Records with a hand-off phrase within ``days`` of a claimed record of the same source."""
    said = records.filter(F.col("text").rlike(phrase)).select("id", "source_id", "us")
    near = nearest_few(claimed.select("claim_id", "source_id", "us"), said, "claim_id", ["source_id"], MOST, days * 86_400_000_000)
    return near.select("claim_id", "id", "no", "total")
