"""Deterministic checks of claims against records: pass, fail or inconclusive, never a guess.

Every check joins claims to records on an account or a quoted text (an equi-join that Spark may
run either way), aggregates once by claim, and decides by an ordered CASE. Claims without any
matching record keep their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.predicates import channel_ok, embedded_copy, in_window, opposite_sides
from veriframe.operators.quotes import messages_with
from veriframe.operators.timeline import counts_inside

PASS, FAIL, INCONCLUSIVE = "pass", "fail", "inconclusive"
#: Two rows of one call from two databases fall this close together (seconds).
TWIN_S = 60


def between_parties(claims: DataFrame, records: DataFrame, same_source: bool = True) -> DataFrame:
    """Each claim with the records sent by one of its parties to the other, once."""
    sides = claims.withColumn("account", F.explode(F.array_distinct(F.concat("a", "b"))))
    on = (F.col("account") == F.col("sender")) & ((F.col("c.source_id") == F.col("r.source_id")) if same_source else F.lit(True))
    found = sides.alias("c").join(records.alias("r"), on)
    return found.filter(opposite_sides(F.col("sender"), F.col("recipients"), F.col("a"), F.col("b"))).select(
        "c.claim_id", *[f"r.{c}" for c in records.columns]
    )


def _count_outcome(n: Column, want: Column, op: Column, full: Column, blocked: Column, copies: Column) -> Column:
    return (
        F.when(copies > 0, INCONCLUSIVE)
        .when(op.isin("eq", "le") & (n > want), FAIL)
        .when(blocked, INCONCLUSIVE)
        .when(op == "eq", F.when(n == want, PASS).otherwise(INCONCLUSIVE))
        .when(op == "ge", F.when(n >= want, PASS).otherwise(INCONCLUSIVE))
        .otherwise(F.when(full, PASS).otherwise(INCONCLUSIVE))
    )


def message_count(claims: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages between two parties in a window against the stated number.

    More than "exactly" or "at most" fails; fewer never does. Numbered copies, untimed rows, a
    silent side and unknown senders leave it open, as does "at most" on a curated source.
    """
    kept = records.filter((F.col("kind") == "message") & ~embedded_copy(F.col("locator")))
    terms = claims.select("claim_id", "a", "b", "lo", "hi", "want", "op", "sent_by_a", "each_way", "channels", F.col("source_id").alias("on_source"))
    rows = between_parties(claims, kept).join(terms, "claim_id").filter(channel_ok(F.col("kind"), F.col("app"), F.col("channels")))
    by_a = F.array_contains("a", F.col("sender"))
    rows = rows.filter(~F.col("sent_by_a") | by_a)
    inside, untimed = in_window(F.col("us"), F.col("lo"), F.col("hi")), F.col("us").isNull()
    counted = rows.groupBy("claim_id").agg(
        F.count_if(inside).alias("n"), F.count_if(untimed).alias("n_untimed"), F.count_if(inside & by_a).alias("n_by_a"),
        F.count_if((inside | untimed) & F.col("numbered_copy")).alias("n_copies"), F.count_if(inside & F.col("deleted")).alias("n_deleted"),
    )
    # messages to the other side without a recorded sender may be among those of the sending side
    silent = kept.filter(F.col("sender").isNull()).select("source_id", "kind", "app", "us", F.explode("recipients").alias("account"))
    others = terms.filter("sent_by_a").withColumn("account", F.explode("b"))
    unknown = others.alias("c").join(silent.alias("r"), (F.col("c.account") == F.col("r.account")) & (F.col("c.on_source") == F.col("r.source_id")))
    unknown = unknown.filter(channel_ok(F.col("kind"), F.col("app"), F.col("channels")) & (F.col("us").isNull() | in_window(F.col("us"), F.col("lo"), F.col("hi"))))
    unknown = unknown.groupBy("claim_id").agg(F.count("*").alias("n_unknown"))
    numbers = ["n", "n_untimed", "n_by_a", "n_copies", "n_deleted", "n_unknown"]
    found = terms.join(counted, "claim_id", "left").join(unknown, "claim_id", "left").fillna(0, numbers)
    found = found.join(sources.withColumnRenamed("source_id", "on_source"), "on_source", "left")
    n, shared = F.col("n"), F.arrays_overlap("a", "b") & (F.col("sent_by_a") | F.col("each_way"))
    one_silent = F.col("each_way") & ((F.col("n_by_a") == 0) | (F.col("n_by_a") == n))
    blocked = (F.col("n_untimed") > 0) | one_silent | ((F.col("n_unknown") > 0) & (F.col("op") != "ge"))
    full = F.coalesce(F.col("fidelity") == "full_extraction", F.lit(False))
    outcome = F.when(shared, INCONCLUSIVE).otherwise(_count_outcome(n, F.col("want"), F.col("op"), full, blocked, F.col("n_copies")))
    return found.select("claim_id", *numbers, outcome.alias("outcome"))


def call_twins(calls: DataFrame, keys: list[str], seconds: int = TWIN_S) -> DataFrame:
    """All pairs (not only neighbours) of timed calls of one key at most ``seconds`` apart.

    A range frame counts them in one sorted pass, so a burst of calls makes no rows.
    """
    w = Window.partitionBy(*keys).orderBy("us").rangeBetween(0, seconds * 1_000_000)
    same = Window.partitionBy(*keys, "us").orderBy("id")
    return calls.filter("us IS NOT NULL").withColumn("n_twins", F.count("*").over(w) - F.row_number().over(same))


def call_count(claims: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """As the message count, for calls: it never fails, since a log keeps unanswered calls and
    can hold one call twice."""
    terms = claims.select("claim_id", "lo", "hi", "want", "op", F.col("source_id").alias("on_source"))
    rows = between_parties(claims, records.filter("kind = 'call'")).join(terms, "claim_id")
    inside = in_window(F.col("us"), F.col("lo"), F.col("hi"))
    untimed = rows.groupBy("claim_id").agg(F.count_if(F.col("us").isNull()).alias("n_untimed"))
    counted = call_twins(rows.filter(inside), ["claim_id"]).groupBy("claim_id").agg(
        F.count("*").alias("n"), F.sum("n_twins").alias("n_twins"), F.count_if(F.coalesce("duration_s", F.lit(0)) == 0).alias("n_unconnected")
    )
    found = terms.join(counted, "claim_id", "left").join(untimed, "claim_id", "left").fillna(0, ["n", "n_twins", "n_unconnected", "n_untimed"])
    found = found.join(sources.withColumnRenamed("source_id", "on_source"), "on_source", "left")
    n, want, op = F.col("n"), F.col("want"), F.col("op")
    full = F.coalesce(F.col("fidelity") == "full_extraction", F.lit(False))
    holds = F.when(op == "eq", n == want).when(op == "ge", n >= want).otherwise(full & (n <= want))
    open_ = (F.col("n_twins") > 0) | (F.col("n_untimed") > 0) | (F.col("n_unconnected") > 0)
    return found.select("claim_id", "n", "n_twins", "n_unconnected", "n_untimed", F.when(~open_ & holds, PASS).otherwise(INCONCLUSIVE).alias("outcome"))


def coverage(records: DataFrame) -> DataFrame:
    """First and last dated record of each source; embedded copies date nothing."""
    return records.filter(~embedded_copy(F.col("locator"))).groupBy("source_id").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def absence(claims: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """No contact of the parties in the window: found fails; none passes only where every stated
    channel has records, the source is a full extraction and its dates span the window."""
    kept = records.filter((F.col("kind") == "call") | ~embedded_copy(F.col("locator")))
    terms = claims.select("claim_id", "lo", "hi", "channels", F.col("source_id").alias("on_source"))
    rows = between_parties(claims, kept).join(terms, "claim_id").filter(channel_ok(F.col("kind"), F.col("app"), F.col("channels")))
    inside, untimed = in_window(F.col("us"), F.col("lo"), F.col("hi")), F.col("us").isNull()
    found = rows.groupBy("claim_id").agg(F.count_if(inside).alias("n_found"), F.count_if(untimed).alias("n_untimed"))
    # a row of a party without a sender may be contact, or not
    silent = kept.filter(F.col("sender").isNull()).select("id", "source_id", "kind", "app", "us", F.explode("recipients").alias("account"))
    sides = claims.select("claim_id", "source_id", "lo", "hi", "channels", F.explode(F.array_distinct(F.concat("a", "b"))).alias("account"))
    silent = sides.join(silent, ["source_id", "account"]).filter(channel_ok(F.col("kind"), F.col("app"), F.col("channels")) & (F.col("us").isNull() | in_window(F.col("us"), F.col("lo"), F.col("hi"))))
    silent = silent.groupBy("claim_id").agg(F.count_distinct("id").alias("n_silent"))
    apps = kept.select("source_id", F.explode(F.array_distinct(F.array(F.lower("app"), F.when(F.col("kind") == "call", "call").otherwise(F.lower("app"))))).alias("app")).distinct()
    missing = terms.select("claim_id", F.col("on_source").alias("source_id"), F.explode("channels").alias("app")).join(apps, ["source_id", "app"], "left_anti")
    missing = missing.groupBy("claim_id").agg(F.count("*").alias("n_missing"))
    all_ = terms.join(found, "claim_id", "left").join(silent, "claim_id", "left").join(missing, "claim_id", "left")
    all_ = all_.fillna(0, ["n_found", "n_untimed", "n_silent", "n_missing"])
    about = sources.join(coverage(records), "source_id", "left").withColumnRenamed("source_id", "on_source")
    all_ = all_.join(about, "on_source", "left")
    spans = F.coalesce((F.col("first_us") <= F.col("lo")) & (F.col("last_us") >= F.col("hi")), F.lit(False))
    full = F.coalesce(F.col("fidelity") == "full_extraction", F.lit(False))
    unplaced = F.col("n_untimed") + F.col("n_silent")
    n_gaps = F.when(full, 0).otherwise(1) + F.when(spans, 0).otherwise(1) + F.col("n_missing")
    outcome = F.when(F.col("n_found") > 0, FAIL).when((unplaced == 0) & (n_gaps == 0), PASS).otherwise(INCONCLUSIVE)
    return all_.select("claim_id", "n_found", unplaced.alias("n_unplaced"), n_gaps.cast("long").alias("n_gaps"), outcome.alias("outcome"))


def quoted_messages(claims: DataFrame, records: DataFrame) -> DataFrame:
    """(quote, the record): the messages that hold the quoted words of any claim
    (``quotes.messages_with``), once for each wording and not for each claim of it.

    Embedded copies stay in: what rests on one is open."""
    asked = claims.filter("quote IS NOT NULL").select(F.xxhash64("quote").alias("quote_id"), "quote").dropDuplicates(["quote"])
    bodies = records.filter("kind = 'message' AND text IS NOT NULL").select("id", F.col("text").alias("body"))
    found = messages_with(asked, bodies).join(asked, "quote_id").drop("quote_id")
    return found.join(records, "id").withColumn("channel", F.struct("kind", "app"))


def _on_channel(df: DataFrame) -> DataFrame:
    return df.filter(channel_ok(F.col("channel.kind"), F.col("channel.app"), F.col("channels")))


def involves_all(sender: Column, recipients: Column, a: Column, b: Column) -> Column:
    """Of two parties one sends to the other; a single party is on the record; none admits all."""
    on = F.array_compact(F.concat(F.array(sender), recipients))
    return F.when(F.size(b) > 0, opposite_sides(sender, recipients, a, b)).when(F.size(a) > 0, F.arrays_overlap(on, a)).otherwise(True)


def _with_parties(claims: DataFrame, records: DataFrame, on: list[str]) -> DataFrame:
    """Claims that name a party with the records that involve their parties: of two parties one is the
    sender, so they meet by that; a single one may stand anywhere on the record."""
    parties = F.array_distinct(F.array_compact(F.concat(F.array("sender"), "recipients")))
    side = lambda df, who: df.withColumn("account", F.explode(F.array_distinct(who)))
    two = side(claims.filter("size(b) > 0"), F.concat("a", "b")).join(records.withColumn("account", F.col("sender")), [*on, "account"])
    one = side(claims.filter("size(b) = 0"), F.col("a")).join(records.withColumn("account", F.explode(parties)), [*on, "account"])
    return two.unionByName(one).filter(involves_all(F.col("sender"), F.col("recipients"), F.col("a"), F.col("b")))


def time_check(claims: DataFrame, records: DataFrame) -> DataFrame:
    """A record inside the window passes. Messages picked by their words fail if all are timed and
    outside; calls are picked by their parties, so one outside may be another call and never fails.

    claims: claim_id, quote (null: calls), a, b (accounts of the parties, empty: none), lo, hi,
    channels, min_s and max_s (a call's length, null: any). A call named with an app beside "call"
    is on that app; one without a recorded length meets no stated length.
    """
    claims = claims.withColumnRenamed("source_id", "on_source")
    said = quoted_messages(claims, records)
    calls = records.filter("kind = 'call'").withColumn("channel", F.struct("kind", "app"))
    held = _on_channel(_with_parties(claims.filter("quote IS NULL").drop("quote"), calls, []))
    apps = F.array_remove(F.transform("channels", lambda c: F.lower(F.trim(c))), "call")
    held = held.filter((F.size(apps) == 0) | F.array_contains(apps, F.lower(F.trim("app"))))
    long_enough = F.col("min_s").isNull() | F.coalesce(F.col("duration_s").between(F.col("min_s"), F.col("max_s")), F.lit(False))
    keys = ["claim_id", "us", "lo", "hi", "id"]
    rows = _on_channel(_with_parties(claims, said, ["quote"])).select(*keys).unionByName(held.filter(long_enough).select(*keys)).distinct()
    inside, timed = in_window(F.col("us"), F.col("lo"), F.col("hi")), F.col("us").isNotNull()
    found = rows.groupBy("claim_id").agg(F.count_if(inside).alias("n_inside"), F.count_if(timed).alias("n_timed"), F.count_if(~timed).alias("n_unknown"))
    # any message of the words will do where no party is named: these are counted, and met by no claim
    totals = said.groupBy("quote", "channel").agg(F.count("us").alias("n_timed"), F.count_if(~timed).alias("n_unknown"))
    free = _on_channel(claims.filter("size(a) = 0 AND size(b) = 0").select("claim_id", "quote", "lo", "hi", "channels").join(totals, "quote"))
    counted = counts_inside(free.withColumnRenamed("claim_id", "window_id"), said.select("quote", "channel", "us"), ["quote", "channel"]).select(F.col("window_id").alias("claim_id"), F.col("n").alias("n_inside"))
    free = free.groupBy("claim_id").agg(F.sum("n_timed").alias("n_timed"), F.sum("n_unknown").alias("n_unknown")).join(counted, "claim_id", "left").fillna(0, ["n_inside"])
    found = found.unionByName(free).withColumn("n_outside", F.col("n_timed") - F.col("n_inside"))
    all_ = claims.select("claim_id", F.col("quote").isNotNull().alias("by_text")).join(found, "claim_id", "left").fillna(0, ["n_inside", "n_outside", "n_unknown"])
    outcome = F.when(F.col("n_inside") > 0, PASS).when((F.col("n_outside") > 0) & (F.col("n_unknown") == 0) & F.col("by_text"), FAIL).otherwise(INCONCLUSIVE)
    return all_.select("claim_id", "n_inside", "n_outside", "n_unknown", outcome.alias("outcome"))


def sender_check(claims: DataFrame, records: DataFrame) -> DataFrame:
    """Who sent the quoted words: every message that holds them from the party's accounts passes,
    none of them fails; a mix, a forwarded or embedded copy or an unknown sender is open."""
    said = quoted_messages(claims, records)
    unknown = F.col("forwarded") | embedded_copy(F.col("locator")) | F.col("sender").isNull()
    # a claim meets its own party's messages, and of the others only their numbers
    by = ["quote", "source_id", "channel"]
    totals = said.groupBy(*by).agg(F.count_if(~unknown).alias("n_known"), F.count_if(unknown).alias("n_unknown"))
    terms = claims.select("claim_id", "quote", "source_id", "channels", "a")
    found = _on_channel(terms.join(totals, ["quote", "source_id"])).groupBy("claim_id").agg(F.sum("n_known").alias("n_known"), F.sum("n_unknown").alias("n_unknown"))
    good = _on_channel(terms.withColumn("sender", F.explode(F.array_distinct("a"))).join(said.filter(~unknown).groupBy(*by, "sender").agg(F.count("*").alias("n")), ["quote", "source_id", "sender"]))
    good = good.groupBy("claim_id").agg(F.sum("n").alias("n_good"))
    found = found.join(good, "claim_id", "left").fillna(0, ["n_good"]).select("claim_id", "n_good", (F.col("n_known") - F.col("n_good")).alias("n_bad"), "n_unknown")
    found = claims.select("claim_id").join(found, "claim_id", "left").fillna(0, ["n_good", "n_bad", "n_unknown"])
    g, b, u = F.col("n_good") > 0, F.col("n_bad") > 0, F.col("n_unknown") > 0
    return found.withColumn("outcome", F.when(g & ~b & ~u, PASS).when(b & ~g & ~u, FAIL).otherwise(INCONCLUSIVE))


def weekday_forward(claims: DataFrame, records: DataFrame, zone: str) -> DataFrame:
    """The next day of the stated weekday after each copy's local send date must be the stated
    day for every timed copy; it never fails. ``claims``: claim_id, quote, weekday (0 = Monday), day."""
    sent = F.to_date(F.from_utc_timestamp(F.timestamp_micros("us"), zone))
    days = records.filter("kind = 'message' AND id IS NOT NULL").groupBy(F.col("text").alias("quote"), sent.alias("sent")).agg(F.count("*").alias("n"))  # a row for each wording and day
    forward = F.date_add("sent", F.pmod(F.col("weekday") - F.weekday("sent"), F.lit(7)).cast("int"))
    found = claims.join(days, "quote", "left").groupBy("claim_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("sent").isNull(), F.col("n"))), F.lit(0)).alias("n_untimed"), F.coalesce(F.sum(F.when(forward == F.col("day"), F.col("n"))), F.lit(0)).alias("n_right")
    )
    good = (F.col("n") > 0) & (F.col("n_right") == F.col("n"))
    return found.withColumn("outcome", F.when(good, PASS).otherwise(INCONCLUSIVE))


def downgrade_forwarded(results: DataFrame, rests_on: DataFrame, forwarded: DataFrame, by: str = "claim_id") -> DataFrame:
    """Pass or fail that rests on a forwarded or embedded record becomes inconclusive.

    ``rests_on``: claim_id, id, or for claims that rest on the same records: ``by`` (a column of
    ``results``), id, each group once. ``forwarded``: id, reason, one row for each source of the mark;
    an embedded copy outranks a forward, which outranks an embedding message.
    """
    rank = F.when(F.col("reason") == "embedded_copy", 0).when(F.col("reason") == "forwarded", 1).otherwise(2)
    marks = forwarded.groupBy("id").agg(F.min_by("reason", rank).alias("reason"))
    hit = rests_on.join(marks, "id").groupBy(by).agg(F.count_distinct("id").alias("n_marked"), F.min_by("reason", F.struct(rank, "id")).alias("reason"))
    found = results.join(hit, by, "left")
    n = F.coalesce("n_marked", F.lit(0))
    return found.select("claim_id", n.alias("n_marked"), "reason", F.when(n > 0, INCONCLUSIVE).otherwise(F.col("outcome")).alias("outcome"))
