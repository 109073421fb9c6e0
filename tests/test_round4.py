"""Whole results where the number of rows grows with the square of a group, against plain searches."""

import random

import numpy as np
import pyarrow as pa

from veriframe.functions import offsets as O
from veriframe.llm import chunks
from veriframe.operators import audit as A
from veriframe.operators import excerpts as X
from veriframe.operators import lookups, matching, statements, timeline
from veriframe.operators.pairs import all_pairs
from veriframe.plans import lookups as lookups_plans
from veriframe.plans import matching as matching_plans
from veriframe.plans import statements as statements_plans
from veriframe.plans import timeline as timeline_plans


def test_pairs_are_dealt_by_blocks(spark):
    left = spark.createDataFrame([(k % 3 if k % 7 else None, k) for k in range(60)], "key int, a int")
    right = spark.createDataFrame([(k % 4, f"r{k}") for k in range(40)], "key int, b string")
    want = sorted((x["key"], x["a"], y["b"]) for x in left.collect() for y in right.collect() if x["key"] == y["key"])
    for block in (1, 5, 1000):
        assert sorted(tuple(r) for r in all_pairs(left, right, ["key"], block).select("key", "a", "b").collect()) == want


def test_every_pair_of_accounts(spark):
    found = matching_plans.q_identifier_join_last10(spark, "/root/testdata/sf0.01")
    assert found.columns == ["id", "id_r"]
    forms = ["+1 (212) 555-0101", "2125550101", "5550101", "555 0101", "x123", " X123", "", None]
    accounts = spark.createDataFrame([(i * 3 + k, app, f) for i, f in enumerate(forms) for k, app in enumerate(("SMS", "sms", None))], "id int, app string, identifier string")
    got = [tuple(r) for r in matching.identifier_pairs(accounts).collect()]
    assert set(got) == {tuple(r) for r in matching.same_identifier(accounts, accounts).collect()} and len(got) == len(set(got)) == 38


def test_every_pair_of_claims_and_persons(spark):
    claims = spark.createDataFrame([(1, "Saw OLD Plate"), (2, "saw the old plate!"), (3, "Saw old plate."), (4, None), (5, "nobody"), (6, "the old plates")], "claim_id int, text string")
    names = spark.createDataFrame([(7, "The Old Plate"), (8, "old plate"), (9, "Plate"), (9, "old plate"), (10, "saw")], "person_id int, name string")
    got = [tuple(r) for r in statements.naming_pairs(claims, names).collect()]
    assert set(got) == {tuple(r) for r in statements.claims_naming(claims, names).collect()} and len(got) == len(set(got)) > 6
    assert statements_plans.q_claims_naming(spark, "/root/testdata/sf0.001").columns == ["claim_id", "person_id"]


def test_every_pair_of_sources(spark):
    accounts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "b"), (4, "c"), (5, "a"), (5, "a"), (6, None), (7, "b")], "source_id int, key string")
    models = spark.createDataFrame([(i, "x" if i != 5 else "y") for i in range(1, 8)], "source_id int, model string")
    got = [tuple(r) for r in lookups.device_pairs(accounts, models).collect()]
    assert sorted(got) == sorted(tuple(r) for r in lookups.source_pairs(accounts, models).collect()) and len(got) == 6
    assert lookups_plans.q_source_pairs(spark, "/root/testdata/sf0.001").columns == ["left", "right", "n_shared"]


def test_every_overlap_once(spark):
    gaps = [(s, scope, f"a{i}", "", i * 7, i * 7 + 5 + i % 3 * 20) for s in ("p", "q") for scope in ("phone", "app") for i in range(12)]
    stated = [(i, "pqr"[i % 3], None if i % 5 == 0 else i * 3, None if i % 7 == 0 else i * 3 + i % 30) for i in range(40)]
    found = timeline.overlapping(spark.createDataFrame(stated, "stated_id int, source_id string, lo long, hi long"), spark.createDataFrame(gaps, "source_id string, scope string, app_key string, thread_key string, start_us long, end_us long"), width=4)
    want = [(i, *g) for i, s, lo, hi in stated for g in gaps if g[0] == s and (lo is None or lo < g[5]) and (hi is None or hi > g[4])]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > 200
    assert "start_us" in timeline_plans.q_stated_overlap(spark, "/root/testdata/sf0.001").columns


def test_every_pair_of_related_threads(spark):
    rng = random.Random(3)
    members = set()
    for t in range(40):
        for s in rng.sample(["p", "q", None], rng.choice([1, 1, 2])):
            members |= {(f"t{t:02}", s, a) for a in rng.sample([*range(9), None], rng.choice([1, 2, 2, 3, 5]))}
    frame = spark.createDataFrame(sorted(members, key=str) * 2, "thread_id string, source_id string, account int")
    units = {}
    for t, s, a in members:
        units.setdefault((t, s), set()).update({a} - {None})
    for needs, piece in ((2, 256), (3, 1)):
        want = [(t, o, len(x & y)) for (t, s), x in units.items() for (o, r), y in units.items() if t != o and len(x & y) >= (1 if s == r and s is not None else needs)]
        assert sorted(tuple(r) for r in matching.related_pairs(frame, needs, piece).collect()) == sorted(want)
    assert matching_plans.q_related_threads(spark, "/root/testdata/sf0.001").columns == ["thread", "other", "n_shared"]


def test_what_a_task_remembers_is_not_copied_for_each_slice():
    held = chunks.Ragged(np.int64)
    held.extend(np.full(1000, 3), np.arange(3000))
    held.extend(np.array([2]), np.array([7, 8]))
    before = held.flat
    held.extend(np.array([0, 1]), np.array([9]))
    assert np.shares_memory(before, held.flat) and held.rows(np.array([1000, 999, 1002])).tolist() == [7, 8, 2997, 2998, 2999, 9]
    held.clear()
    assert held.flat.size == held.start.size == held.size.size == 0
    texts = pa.RecordBatch.from_pydict({"text": ["ab", None, "abc", "d" * 9, ""]})
    assert [(k, len(t)) for k, t in chunks.slices(texts, 5)] == [(0, 3), (3, 1), (4, 1)]


def test_whole_messages_are_counted_and_not_met(spark):
    quotes = spark.createDataFrame([(k, ("?!", "Come ON", "come on.", "?", "", None, "a b c d e f g")[k % 7]) for k in range(40)], "quote_id int, quote string")
    bodies = spark.createDataFrame([(k, ("? !", "Come  on!", "no", "?!", " ", None, "a b c d e f g")[k % 7]) for k in range(3, 45)], "id int, body string")
    plain = {}
    for r in statements.whole_messages(quotes, bodies).collect():
        plain.setdefault(r.quote_id, []).append(r.id)
    found = statements.whole_messages_counted(quotes, bodies)
    assert sorted(tuple(r) for r in found.collect()) == sorted((q, len(i), min(i)) for q, i in plain.items()) and len(plain) == 18
    # the messages of a key are one row before the quotes come to them
    joined = statements_plans.q_whole_messages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert joined.index("Join") < joined.index("Aggregate")


def test_quiet_stretches_in_pauses_are_counted(spark):
    rng, day = random.Random(2), 86_400_000_000
    at = lambda: rng.randrange(40) * day // 2 + rng.choice([0, 0, 1])
    gaps = [(rng.choice(["p", "q", None]), *sorted((at(), at()))) for _ in range(400)]
    passages = [(f"t{k}", k, "pqr"[k % 3], *sorted((at(), at())), *sorted((at(), at()))) for k in range(60)] + [("u", 1, "p", 5 * day, 6 * day, None, None)]
    frame = spark.createDataFrame([(t, e, s, hi, lo, None if k % 4 == 0 and t != "u" else b, a) for k, (t, e, s, b, hi, lo, a) in enumerate(passages)], "thread_id string, exchange int, source_id string, first_us long, last_us long, before_us long, after_us long")
    held = spark.createDataFrame(gaps, "source_id string, start_us long, end_us long")
    want = sorted(tuple(r) for r in statements.quiet_in_pauses(frame, held).groupBy("thread_id", "exchange", "side").count().collect())
    for apart in (0, 2):
        assert sorted(tuple(r) for r in statements.quiet_counted(frame, held, apart).collect()) == want
    assert len(want) > 40 and not statements.quiet_counted(frame, held.limit(0)).collect()
    pairs = statements_plans.q_quiet_in_pauses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "start_us" not in pairs


def test_excerpts_of_their_own_bodies(spark):
    rng = random.Random(6)
    bodies = [(k, " ".join(rng.choice("at nine the dock Bo? come, and".split()) for _ in range(rng.randrange(1, 9)))) for k in range(60)] + [(60, "PETROV: at nine"), (61, "at nine"), (62, "?!"), (63, None)]
    said = [(k, rng.choice(["", "PETROV: "]) + " ".join((b or "?").split()[: rng.randrange(1, 5)])) for k, b in bodies if k < 60] + [(61, "PETROV: at nine"), (62, "X: ?!"), (63, "at nine"), (99, "at nine")]
    e, b = spark.createDataFrame(said, "excerpt_id long, excerpt string"), spark.createDataFrame(bodies, "id long, body string")
    want = X.find_every(X.placed(e, b)).filter("excerpt_id = id").select("excerpt_id", "part", "method", "ranges", "spans").collect()
    got = X.find_own(e, b).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and 30 < len(got) and 61 not in {r.excerpt_id for r in got}


def test_excerpts_of_common_words_meet_by_three(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    bodies = [(k, f"of the and, the to of w{k}") for k in range(30)] + [(99, "so of the to end")]
    assert [r.id for r in X.candidates(frame([(1, "of the to")], "excerpt_id long, excerpt string"), frame(bodies, "id long, body string")).collect()] == [99]


def test_folds_of_plain_texts_are_those_of_any(monkeypatch):
    texts = ["", "  a\tB \n`c’ ", "Été “x” ½ﬁ", "объект Хь ь", "e\u0301 a\u00adb", "x_iy kh-9 don't", " a"]
    quick = [(O.fold(t), O.anchors(t)) for t in texts]
    monkeypatch.setattr(O, "_one_for_one", lambda c: False)
    monkeypatch.setattr(O, "_plain", lambda c: False)
    assert quick == [(O.fold(t), O.anchors(t)) for t in texts]
    assert "a b c" in O.anchors("a b c d")[0]


def test_equal_quotes_are_looked_up_once(spark):
    said = ["of the", "of the", "OF the", "the dock at nine", "the dock at nine", "sam poe", "sam poe", "", "nine"]
    quotes = spark.createDataFrame([(f"q{k}", f"u{k % 4}", f"d{k % 2}", w, k != 4, True) for k, w in enumerate(said * 2)], "quote_id string, unit_id string, group_id string, words string, whole boolean, document boolean")
    messages = spark.createDataFrame([(f"m{k}", "ab"[k % 2], f"t{k % 3}", "x", k * 10_000_000, "r", w) for k, w in enumerate(["one of the many", "of, the few", "the dock at nine", "nine", "come to the dock at nine", None, "see: of the"] * 2)], "id string, source_id string, thread_id string, sender string, us long, locator string, text string")
    names = spark.createDataFrame([("Sam Poe",)], "name string")
    plain = A.hits(quotes, messages, names)
    want = A.lookups(quotes, plain, A.placed(plain, messages), names).collect()
    dealt = A.by_text(quotes)
    texts = dealt.filter("quote_id = text_id").drop("text_id")
    found = A.hits(texts, messages, names)
    got = A.lookups_by_text(dealt, found, A.placed(found, messages), names)
    assert sorted(map(str, got.select(*want[0].asDict()).collect())) == sorted(map(str, want)) and len(want) == 18 and texts.count() == 7


def test_common_quotes_mark_the_threads_of_picks_alone(spark):
    rng = random.Random(4)
    some = ["of the", "the dock", "bring the red bag", "which of them", "at nine then"]
    messages = spark.createDataFrame([(f"m{k:02}", "ab"[k % 2], f"t{k % 7}", rng.choice("uv"), k * 100_000_000, f"row/{k}", " ".join(rng.sample(some, rng.choice([1, 1, 2]))) + (f" w{k} z" if k % 3 else "")) for k in range(50)], "id string, source_id string, thread_id string, sender string, us long, locator string, text string")
    quotes = [(f"q{k:02}", f"p{k % 9}", f"d{k % 4}", rng.choice([*some, f"w{k} z", f"w{k + 1} z"]), True, True) for k in range(50)]
    quotes = A.by_text(spark.createDataFrame(quotes, "quote_id string, unit_id string, group_id string, words string, whole boolean, document boolean"))
    names = spark.createDataFrame([("nobody",)], "name string")
    tagged = messages.filter("id IN ('m01', 'm17', 'm30')").select("id")
    plain = A.hits(quotes.drop("text_id"), messages, names).persist()
    want = sorted(map(str, A.audit(quotes, plain, A.placed(plain, messages), tagged, messages).collect()))
    found = A.hits(quotes.filter("quote_id = text_id").drop("text_id"), messages, names).persist()
    for many in (1, 64):
        assert sorted(map(str, A.audit_by_text(quotes, found, A.placed(found, messages), tagged, messages, many=many).collect())) == want
    assert len(want) > 10 and any("maybe=0" not in r for r in want)
