"""Quotes against a record's own fields, and places of aliases: planted cases and a plain search."""

import re

from pyspark.sql import functions as F

from veriframe.operators import cited as C


def test_calls_and_contacts(spark):
    rows = [("incoming", "Signal", "+1 555", "hal", 62), (None, "Signal", None, None, None), ("unknown", None, "a", "b", 0)]
    df = spark.createDataFrame(rows, "direction string, app string, s string, r string, d int")
    line, own = C.call_line(*(F.col(k) for k in ("app", "direction", "s", "r", "d")))
    got = df.select(line.alias("t"), own.alias("o")).collect()
    assert got[0].t == "incoming Signal call from +1 555 to hal, duration 62 s"
    assert [got[0].t[x.a : x.b] for x in got[0].o] == ["incoming", "Signal", "+1 555", "hal", "62"]
    assert got[1].t == "unknown Signal call from unknown to unknown, duration unknown" and [got[1].t[x.a : x.b] for x in got[1].o] == ["Signal"]
    assert [got[2].t[x.a : x.b] for x in got[2].o] == ["a", "b", "0"]
    name, own = C.contact_line(F.col("app"), F.col("s"))
    assert [r.t for r in df.select(name.alias("t")).collect()] == ["Signal: +1 555", "Signal: ", "(no name): a"]


def test_cites(spark):
    quotes = {"call from": False, "call from +1": True, "duration 62": True, "duration 6": False, "62 s": True, "unknown": False, ", ": False, "": False, "ignal": False, "Signal": True, None: False, "to hal, duration": True, " to ": False}
    line, own = C.call_line(F.lit("Signal"), F.lit("incoming"), F.lit("+1 555"), F.lit("hal"), F.lit(62))
    got = spark.createDataFrame([(q,) for q in quotes], "q string").select("q", C.cites(F.col("q"), line, own).alias("c"), C.cites_message(F.col("q"), F.lit("a call from hal")).alias("m")).collect()
    assert {r.q: r.c for r in got} == quotes and {r.q for r in got if r.m} == {"call from"}


def _plain(alias, text):
    words = re.findall(r"[^\W_]+", alias.casefold())
    pattern = r"(?<![\w@+])" + r"[\W_]+".join(map(re.escape, words)) + r"(?!\w)"
    return [(m.start(), m.end()) for m in re.finditer(pattern, text.casefold())] if words else []


def test_alias_places(spark):
    aliases = ["SUBJECT-1", "the COURIER", "Hal", "ha ha", "Big Owen", "--", None, "Über Max"]
    texts = ["Subject 1 met SUBJECT-12 and subject-1a; SUBJECT_1.", "the courier came, The COURIER left, the Courier too", "@hal wrote to HAL, +hal, hal_x, x_hal and Hal's", "ha ha ha ha ha", "big\nOWEN and big, owen", "", None, "über... MAX 😀 Über max"]
    a = spark.createDataFrame(list(enumerate(aliases)), "alias_id int, alias string").withColumn("text", F.lit("clash"))
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string").withColumn("alias", F.lit("clash"))
    got = C.alias_places(a, t).collect()
    want = {(i, j, *span) for i, alias in enumerate(aliases) for j, text in enumerate(texts) for span in _plain(alias or "", text or "")}
    assert {(r.alias_id, r.text_id, r.start, r.end) for r in got} == want and len(got) == len(want) > 10
    assert {texts[r.text_id][r.start : r.end] for r in got if r.lowered} == {"the courier", "the Courier"}


def test_alias_places_of_a_long_text(spark):
    """A text of many words that two aliases share, apart: they meet by the pair of words, not by each word."""
    text = "ha and ho, " * 200 + "Ha-ho! ha ho ha ho_x"
    aliases = spark.createDataFrame([(1, "ha ho"), (2, "ho ha"), (3, "ho")], "alias_id int, alias string")
    runs = spark.createDataFrame([(["ha", "ho"],)], "words array<string>").select(C._runs(F.col("words")).alias("i", "run")).collect()
    assert [(r.i, r.run) for r in runs] == [(0, ["ha", "ha ho"]), (1, ["ho", None])]
    got = C.alias_places(aliases, spark.createDataFrame([(1, text)], "text_id int, text string")).collect()
    for i, alias in ((1, "ha ho"), (2, "ho ha"), (3, "ho")):
        assert sorted((r.start, r.end) for r in got if r.alias_id == i) == _plain(alias, text)
