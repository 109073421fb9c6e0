"""Counts, absence and the rules that leave a check open, on small hand-made cases."""

from veriframe.operators import checks

REC = "id string, kind string, source_id string, app string, sender long, recipients array<long>, us long, text string, duration_s long, deleted boolean, forwarded boolean, locator string, numbered_copy boolean"
CLAIM = "claim_id long, source_id string, a array<long>, b array<long>, lo long, hi long, want long, op string, sent_by_a boolean, each_way boolean, channels array<string>, quote string"


def rec(id, sender=1, to=2, us=10, kind="message", source="s", app="x", text="t", duration=None, copy=False, locator="row", forwarded=False):
    return (id, kind, source, app, sender, [to], us, text, duration, False, forwarded, locator, copy)


def claim(op="eq", want=1, lo=0, hi=100, sent=False, each=False, channels=(), a=1, b=2, source="s", quote="t"):
    return (1, source, [a], [b], lo, hi, want, op, sent, each, list(channels), quote)


def outcome(spark, fn, rows, *claim_rows, fidelity="full_extraction"):
    sources = spark.createDataFrame([("s", fidelity)], "source_id string, fidelity string")
    found = fn(spark.createDataFrame(list(claim_rows), CLAIM), spark.createDataFrame(rows, REC), sources).collect()
    assert len(found) == len(claim_rows)
    return found[0].outcome


def test_message_count(spark):
    one, two = [rec("m1")], [rec("m1"), rec("m2", sender=2, to=1)]
    run = lambda rows, *c, **k: outcome(spark, checks.message_count, rows, *c, **k)
    assert run(one, claim()) == "pass" and run(two, claim()) == "fail" and run(one, claim(want=2)) == "inconclusive"
    assert run(two, claim("ge", 1)) == "pass" and run(one, claim("le", 1)) == "pass" and run(one, claim("le", 1), fidelity="curated_report") == "inconclusive"
    assert run(one + [rec("m3", copy=True)], claim(want=2)) == "inconclusive"
    assert run(one + [rec("m4", us=None)], claim()) == "inconclusive"
    assert run(one + [rec("m5", locator="row/Embedded[1]")], claim()) == "pass"
    assert run(one, claim("ge", each=True)) == "inconclusive" and run(two, claim("ge", each=True)) == "pass"
    assert run(two, claim(sent=True)) == "pass" and run(two + [rec("m6", sender=None)], claim(sent=True)) == "inconclusive"
    assert run(one, claim(channels=["y"])) == "inconclusive" and run(one, claim(channels=[" X "])) == "pass"
    assert run([rec("m1", us=0), rec("m2", us=100), rec("m3", us=101)], claim(want=2)) == "pass"  # both ends are inside


def test_calls_never_fail(spark):
    run = lambda rows, *c: outcome(spark, checks.call_count, rows, *c)
    call = lambda id, us, d=9: rec(id, us=us, kind="call", duration=d)
    hour = 3_600_000_000
    wide = lambda **k: claim(hi=10 * hour, **k)
    assert run([call("c1", 0)], wide()) == "pass" and run([call("c1", 0), call("c2", hour)], wide()) == "inconclusive"
    assert run([call("c1", 0), call("c2", 60_000_000)], wide(want=2)) == "inconclusive"
    assert run([call("c1", 0), call("c2", 61_000_000)], wide(want=2)) == "pass"
    assert run([call("c1", 0, 0)], wide()) == "inconclusive" and run([call("c1", 0, None)], wide()) == "inconclusive"


def test_absence(spark):
    run = lambda rows, *c, **k: outcome(spark, checks.absence, rows, *c, **k)
    around = [rec("o1", 7, 8, 0), rec("o2", 7, 8, 100)]
    assert run(around, claim()) == "pass" and run(around + [rec("m")], claim()) == "fail"
    assert run(around, claim(), fidelity="curated_report") == "inconclusive" and run(around[:1], claim()) == "inconclusive"
    assert run(around + [rec("m", sender=None)], claim()) == "inconclusive" and run(around + [rec("m", us=None)], claim()) == "inconclusive"
    assert run(around, claim(channels=["y"])) == "inconclusive" and run(around, claim(channels=["x"])) == "pass"


TIMED = CLAIM + ", min_s long, max_s long"


def test_sender_of_words(spark):
    claims = spark.createDataFrame([claim()], CLAIM)
    sender = lambda *rows, of=claims: checks.sender_check(of, spark.createDataFrame(list(rows), REC)).first().outcome
    assert sender(rec("m")) == "pass" and sender(rec("m", sender=3)) == "fail" and sender(rec("m"), rec("n", sender=3)) == "inconclusive"
    assert sender(rec("m", forwarded=True)) == "inconclusive" and sender(rec("m", text="z")) == "inconclusive"
    assert sender(rec("m", sender=None)) == "inconclusive" and sender(rec("m", locator="x/Embedded[1]")) == "inconclusive"
    # the message holds the words; it need not be them, and quote marks and spaces may differ
    said = spark.createDataFrame([claim(quote="I'm on  my way")], CLAIM)
    assert sender(rec("m", text="ok, I’m on my way!"), of=said) == "pass" and sender(rec("m", text="I'm on my ways"), of=said) == "inconclusive"
    assert sender(rec("m", text="i'm on my way"), of=said) == "inconclusive"  # case is kept
    # only the stated channel counts
    assert sender(rec("m", sender=3), rec("n", app="y"), of=spark.createDataFrame([claim(channels=["y"])], CLAIM)) == "pass"


def test_time_of_words_and_calls(spark):
    def time(*rows, quote="t", a=(), b=(), channels=(), seconds=(None, None)):
        of = (1, "s", list(a), list(b), 0, 100, 1, "eq", False, False, list(channels), quote, *seconds)
        return checks.time_check(spark.createDataFrame([of], TIMED), spark.createDataFrame(list(rows), REC)).first().outcome

    assert time(rec("m", us=100)) == "pass" and time(rec("m", us=101)) == "fail" and time(rec("m", us=101), rec("n", us=None)) == "inconclusive"
    assert time(rec("m", us=101, text="not t at all")) == "fail" and time(rec("m", us=101, text="tt")) == "inconclusive"
    assert time(rec("m", us=5, sender=7), rec("n", us=500), a=[1], b=[2]) == "fail"  # of other parties
    call = lambda i, **k: rec(i, kind="call", text=None, **k)
    parties = {"quote": None, "a": [1], "b": [2]}
    assert time(call("c", us=100), **parties) == "pass" and time(call("c", us=101), **parties) == "inconclusive"  # a call never fails
    assert time(call("c", us=50, sender=2, to=1), **parties) == "pass" and time(call("c", us=50, to=9), **parties) == "inconclusive"
    assert time(call("c", us=50, duration=30), seconds=(20, 40), **parties) == "pass" and time(call("c", us=50), seconds=(20, 40), **parties) == "inconclusive"
    assert time(call("c", us=50, app="y"), channels=["call", "Y"], **parties) == "pass" and time(call("c", us=50), channels=["call", "y"], **parties) == "inconclusive"
    assert time(call("c", us=50), channels=["call"], **parties) == "pass"


def test_twins_count_all_pairs(spark):
    rows = [("k", f"c{i}", i * 20_000_000) for i in range(5)] + [("k", "d", 0), ("j", "e", 0)]
    calls = spark.createDataFrame(rows, "key string, id string, us long")
    want = sum(1 for x in rows for y in rows if x[0] == y[0] and (x[2], x[1]) < (y[2], y[1]) and y[2] - x[2] <= 60_000_000)
    assert checks.call_twins(calls, ["key"]).agg({"n_twins": "sum"}).first()[0] == want
