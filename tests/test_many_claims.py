"""Many claims of the same words: messages are counted for the words, and met by no claim."""

import random

from pyspark.sql import functions as F

from veriframe.operators import checks as C
from veriframe.operators import timeline as T

RECORD = "id string, source_id string, kind string, app string, sender long, recipients array<long>, us long, text string, duration_s long, forwarded boolean, locator string"
CLAIM = "claim_id long, source_id string, quote string, a array<long>, b array<long>, lo long, hi long, channels array<string>, min_s int, max_s int, weekday int, day date"


def test_counts_inside_equal_a_plain_count(spark):
    rng = random.Random(3)
    at = [(k, rng.choice([None, *range(-40, 60)])) for k in "xyz" for _ in range(80)]
    wins = [(i, rng.choice("xyw"), rng.choice([None, *range(-60, 80)]), rng.choice([None, *range(-60, 80)])) for i in range(120)]
    got = T.counts_inside(spark.createDataFrame(wins, "window_id long, k string, lo long, hi long"), spark.createDataFrame(at, "k string, us long"), ["k"], 7)
    n = {i: sum(1 for j, u in at if j == k and u is not None and None not in (lo, hi) and lo <= u <= hi) for i, k, lo, hi in wins}
    assert {r.window_id: r.n for r in got.collect()} == {i: v for i, v in n.items() if v}


def test_rows_do_not_grow_with_claims_times_messages(spark):
    """A counter in the plan sees each message once for each use, however many claims quote it."""
    n, seen = 400, spark.sparkContext.accumulator(0)
    rows = [(f"m{i}", "s", "message", "sms", i % 5, [7], i if i % 9 else None, "the words", None, i % 50 == 1, "row/1") for i in range(n)]
    claims = [(k, "s", "the words", [k % 7], [], -1, 100, [] if k % 2 else ["sms"], None, None, 0, None) for k in range(n)]
    records, asked = spark.createDataFrame(rows, RECORD), spark.createDataFrame(claims, CLAIM)
    free = asked.withColumn("a", F.array().cast("array<bigint>"))

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    inside = sum(1 for r in rows if r[6] is not None and r[6] <= 100)
    unknown = sum(1 for r in rows if r[6] is None)
    got = C.time_check(free, records).collect()
    assert {(r.n_inside, r.n_outside, r.n_unknown) for r in got} == {(inside, n - inside - unknown, unknown)} and len(got) == n
    sent = {r.claim_id: (r.n_good, r.n_bad, r.n_unknown) for r in C.sender_check(asked, records).collect()}
    good = {s: sum(1 for r in rows if r[4] == s and not r[9]) for s in range(7)}
    marked = sum(1 for r in rows if r[9])
    assert sent == {k: (good[k % 7], n - marked - good[k % 7], marked) for k in range(n)}
    copies = records.withColumn("text", counted("text"))
    assert {(r.n, r.n_untimed) for r in C.weekday_forward(asked.select("claim_id", "quote", "weekday", "day"), copies, "UTC").collect()} == {(n, unknown)}
    assert seen.value <= 4 * n
