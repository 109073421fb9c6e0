"""Stated times, names, quotes and look-ups on planted cases."""

from pyspark.sql import functions as F

from veriframe.functions.text import alias_forms, quoted
from veriframe.operators import evidence as E
from veriframe.operators import lookups as L
from veriframe.operators import rules as R
from veriframe.operators import statements as S
from veriframe.operators.identity import name_words


def test_times_against_stated_ranges(spark):
    rows = [  # us, zone, lo, hi, relation, state, delta, conflict (seconds)
        (50, "UTC", 0, 100, "at", "inside", 0, False), (100, "UTC", 0, 100, "at", "inside", 0, False), (101, "UTC", 0, 100, "at", "within", 1, False), (500, "UTC", 0, 100, "at", "differs", 400, False),
        (-10, "UTC", 0, 100, "after", "within", -10, False), (-400, "UTC", 0, 100, "after", "differs", -400, True), (400, "UTC", 0, 100, "before", "within", 300, True), (399, "UTC", 0, 100, "before", "within", 299, False),
        (None, "UTC", 0, 100, "at", "no_time", None, False), (50, None, 0, 100, "before", "no_zone", None, False), (10**6, "UTC", 0, None, "at", "inside", 0, False), (-5, "UTC", None, 100, "after", "inside", 0, False),
    ]
    us = lambda c: (F.col(c) * 1_000_000).alias(c)
    df = spark.createDataFrame(rows, "us long, zone string, lo long, hi long, relation string, want string, delta long, clash boolean")
    for r in S.compare_times(df.select(us("us"), "zone", us("lo"), us("hi"), "relation", "want", "delta", "clash")).collect():
        assert r.state == r.want and r.conflict == r.clash and (None if r.delta_us is None else r.delta_us // 1_000_000) == r.delta, r


def test_relations_and_sentences(spark):
    df = spark.createDataFrame([(" and after that ", True, "after"), (" and after that ", False, "before"), ("before", True, "before"), ("before", False, "before"), ("then, before", True, "sequence"), ("x", True, "at")], "b string, q boolean, want string")
    got = [(r.got, r.want, r.b, r.q) for r in df.withColumn("got", S.relation(F.col("b"), F.col("q"))).collect()]
    assert all(g == w or (b == "before" and not q) for g, w, b, q in got)
    text = 'He came at 9 p.m. on Monday. Dr. Fox saw R. Calder! "Yes." She left.'
    assert spark.createDataFrame([(text,)], "t string").select(E.sentences(F.col("t"))).first()[0] == ["He came at 9 p.m. on Monday.", "Dr. Fox saw R. Calder!", '"Yes."', "She left."]


def test_names(spark):
    persons = spark.createDataFrame([(1, "Alexander Sokolov"), (2, "Maria Braun"), (3, "Eva Braun"), (4, "SUBJECT-2")], "person_id long, name string")
    aliases = spark.createDataFrame([(1, "Big-Owen"), (2, "Boss"), (3, "boss!")], "person_id long, alias string")
    names = spark.createDataFrame([(n,) for n in ("alexander SOKOLOV", "Sokolov", "braun", "big owen", "BOSS", "subject-2", "subject-1", "Alexander")], "name string")
    got = {r.name: (r.n, r.person_id) for r in S.resolve_names(names, persons, aliases).collect()}
    assert got == {"alexander SOKOLOV": (1, 1), "Sokolov": (1, 1), "braun": (2, None), "big owen": (1, 1), "BOSS": (2, None), "subject-2": (1, 4), "subject-1": (0, None), "Alexander": (0, None)}
    sides = [("Alex Turner", "alex", "turner", "for"), ("Alex Turner", "alexander", "turner", "for"), ("Alex Turner", "alex", "smith", "against"), ("Alex Turner", "turner", None, "for"), ("Alex Turner", "alex", None, None), ("Alex Turner", "bob", None, "against"), ("Alex", "alex", None, "for"), ("Alex", "bob", None, "against")]
    df = spark.createDataFrame(sides, "p string, a string, b string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", S.intro_side(name_words(F.col("p")), F.col("a"), F.col("b"))).collect())
    one = spark.createDataFrame([("The Ice-Man", 'He didn\'t say "come here" or \'go home\' to SUBJECT-12 of the FBI, ANNA SMITH')], "n string, t string")
    r = one.select(alias_forms(F.col("n")).alias("f"), quoted(F.col("t")).alias("q"), S.capital_runs(F.col("t"), ("FBI",)).alias("c")).first()
    assert r.f == ["the ice man", "ice man"] and r.q == ["come here", "go home"] and r.c == ["SUBJECT-12", "ANNA SMITH"]


def test_search_terms(spark):
    text = '@joe.b and a@b wrote "On the Way" to +1 (212) 555-0100 about item 40412, Anna\'s 12 cats and Anna'
    r = spark.createDataFrame([(text,)], "t string").select(E.search_terms(F.col("t"), ("and", "the", "about", "item")).alias("s")).first().s
    assert r.handles == ["@joe.b"] and r.numbers == ["12125550100", "40412"] and r.keywords == ["on the way", "wrote", "way", "anna", "cats"]


def test_excerpts_keep_their_places(spark):
    text = " one line \n\n--\n two\nthree \n \n\n four"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    for blocks, want in ((False, ["one line", "two", "three", "four"]), (True, ["one line", "--\n two\nthree", "four"])):
        got = E.excerpts(df, blocks).orderBy("no").collect()
        assert [r.excerpt for r in got] == want and [r.no for r in got] == list(range(1, len(want) + 1))
        assert all(text[r.start : r.end] == r.excerpt for r in got)


def test_priority_of_a_claim(spark):
    base = dict(incomplete=False, audited=True, edited=False, untested=False, n_withheld=0, contradiction=False, n_ai_accepted=0, n_open_support=0, n_open_against=0, decided_after=False, n_ai_dismissed=0, reviewed=True, verdict="unproven")
    cases = [({}, 9), ({"reviewed": False}, 6), ({"n_open_support": 1}, 2), ({"n_open_support": 1, "verdict": "supported"}, 5), ({"n_ai_accepted": 2}, 1), ({"n_open_against": 1, "decided_after": True}, 3), ({"decided_after": True}, 4), ({"edited": True, "untested": True}, 0), ({"incomplete": True, "edited": True}, 8), ({"audited": False}, 8), ({"contradiction": True}, 1), ({"n_ai_dismissed": 1}, 5)]
    df = spark.createDataFrame([{**base, **c, "want": w} for c, w in cases])
    assert all(r.got == r.want for r in df.withColumn("got", R.priority()).collect())


def test_places_in_a_total_order(spark):
    rows = [(k % 7, f"c{k}") for k in range(500)]
    got = {(r.a, r.b): r.no for r in R.numbered(spark.createDataFrame(rows, "a long, b string").repartition(5), ["a", "b"], "no").collect()}
    assert got == {row: k for k, row in enumerate(sorted(rows), 1)}


def test_look_ups(spark):
    runs = spark.createDataFrame([(1, 10, 5, "completed"), (1, 11, 7, "failed"), (1, 12, 3, "running"), (2, 20, 5, "failed"), (3, 30, 9, "completed"), (3, 31, 8, "failed")], "case_id long, run_id long, started_us long, status string")
    assert sorted(tuple(r) for r in L.latest_runs(runs).collect()) == [(1, 10, 11), (2, None, 20), (3, 30, None)]
    df = spark.createDataFrame([("a b", "x  a\nb y", True), ("a b", "xa b", True), ("b a", "a b", False), (" ", "a", False)], "s string, p string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", L.span_in(F.col("s"), F.col("p"))).collect())
    reviews = spark.createDataFrame([(1, 1, "ai"), (1, 2, "expert"), (1, 3, "ai"), (2, 1, "ai"), (2, 2, "counsel"), (2, 3, "ai")], "item long, seq long, kind string")
    assert [tuple(r) for r in L.expert_before_ai(reviews).collect()] == [(1, 3)]
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, id string, rank int")
    more = spark.createDataFrame([("a", "c", 1), ("a", "d", 2), ("b", "a", 1)], "id string, with_id string, no int")
    assert [r.id for r in E.with_companions(ranked, more, 3).orderBy("place").collect()] == ["a", "c", "d"]
