"""Searches that count and find neighbours without meeting every pair, against plain searches of all pairs."""

import random

import pandas as pd

from veriframe.operators import alternatives as H
from veriframe.operators import excerpts as X
from veriframe.operators import identity as G
from veriframe.operators import lookups as L
from veriframe.operators import matching as M
from veriframe.operators import stated as S
from veriframe.operators import statements
from veriframe.operators import timeline as T


def rows(seed, n=120, span=60):
    rng = random.Random(seed)
    return [(f"m{k}", rng.choice("ab"), rng.choice("tuv"), rng.choice([*range(span)] + [None]), f"note {rng.randrange(6, 9)}") for k in range(n)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_closest_of_other_threads(spark):
    for seed in range(3):
        data = rows(seed)
        frame = spark.createDataFrame(data, "id string, source_id string, thread_id string, us long, text string")
        picks = [r for r in data if int(r[0][1:]) % 9 == 0 and r[3] is not None]
        got = statements.near_others(frame.filter("int(substring(id, 2)) % 9 = 0"), frame, 4, 3)
        want = set()
        for t in {p[2] for p in picks}:
            gaps = {}
            for p in picks:
                for r in data:
                    if p[2] == t != r[2] and r[1] == p[1] and r[3] is not None and abs(r[3] - p[3]) <= 4:
                        gaps[r[0]] = min(gaps.get(r[0], 99), abs(r[3] - p[3]))
            want |= {(t, i, g, n, len(gaps)) for n, (g, i) in enumerate(sorted((g, i) for i, g in gaps.items())[:3], 1)}
        assert {tuple(r) for r in got.select("pick_thread", "id", "gap_us", "no", "total").collect()} == want


def test_handoffs_are_counted_and_not_met(spark):
    data = [(i, s, t, None if us is None else us * 86_400_000_000, x) for i, s, t, us, x in rows(5)]
    frame = spark.createDataFrame(data, "id string, source_id string, thread_id string, us long, text string")
    claims = [(k, "ab"[k % 2], k * 7 * 86_400_000_000 + k % 2) for k in range(8)]
    got = {tuple(r) for r in H.handoffs(spark.createDataFrame(claims, "claim_id int, source_id string, us long"), frame, "^note 7").collect()}
    want = set()
    for c, s, us in claims:
        near = sorted((abs(r[3] - us), r[0]) for r in data if r[1] == s and r[3] is not None and r[4] == "note 7" and abs(r[3] - us) <= 2 * 86_400_000_000)
        want |= {(c, i, n, len(near)) for n, (_, i) in enumerate(near[:6], 1)}
    assert got == want


def test_closest_anchor_in_one_pass(spark):
    for seed in range(3):
        data = [(i, s, None if us is None else us * 600_000_000) for i, s, _, us, _ in rows(seed)]
        frame = spark.createDataFrame(data, "id string, source_id string, us long")
        found = M.near_anchors(frame.filter("int(substring(id, 2)) % 7 = 0"), frame, ["source_id"])
        want = set()
        for i, s, us in data:
            near = [(abs(u - us), j) for j, q, u in data if int(j[1:]) % 7 == 0 and q == s and j != i and None not in (u, us) and abs(u - us) <= 3_600_000_000]
            want |= {(i, min(near)[1], min(near)[0])} if near else set()
        assert {tuple(r) for r in found.collect()} == want and "Join" not in plan(found)


def test_records_elsewhere_are_counted(spark):
    data = rows(7)
    frame = spark.createDataFrame(data, "id string, source_id string, thread_id string, us long, text string")
    gaps = [("a", "app", "x", "", 3, 20), ("b", "phone", "", "", 10, 11), ("a", "app", "y", "", 59, 60), ("c", "phone", "", "", 0, 59)]
    found = T.elsewhere(spark.createDataFrame(gaps, "source_id string, scope string, app_key string, thread_key string, start_us long, end_us long"), frame, 8)
    want = {(*g, o, n) for g in gaps for o in "ab" if o != g[0] and (n := sum(r[1] == o and r[3] is not None and g[4] < r[3] < g[5] for r in data))}
    assert {tuple(r) for r in found.collect()} == want and "array_distinct" not in plan(found)


def test_sources_are_counted_as_they_are_found(spark):
    rng = random.Random(4)
    claims = spark.createDataFrame([(k % 3, k, [rng.randrange(6) for _ in range(rng.randrange(4))] if k % 9 else None) for k in range(60)], "case_id int, claim_id int, devices array<int>")
    sources = spark.createDataFrame([(k % 4, k, rng.choice(["ufdr", "govdoc"])) for k in range(20)], "case_id int, source_id int, kind string")
    devices = spark.createDataFrame([(k % 5, k) for k in range(20)] + [(1, 3), (1, 3), (2, 99)], "device int, source_id int")
    plain = {}
    for r in L.sources_for(claims, sources, devices).collect():
        plain.setdefault(r.claim_id, []).append(r.source_id)
    assert {(r.claim_id, r.n, r.first_source) for r in L.sources_counted(claims, sources, devices).collect()} == {(c, len(s), min(s)) for c, s in plain.items()}


def test_same_words_are_looked_up_once(spark):
    marks = spark.createDataFrame([(k, "quote", "at nine") for k in range(30)] + [(99, "number", "212 555 0199")], "mark_id int, how string, words string")
    records = spark.createDataFrame([("m1", "message", "come at nine", []), ("c1", "call", None, ["+1 (212) 555-0199"])], "id string, kind string, text string, parties array<string>")
    assert {tuple(r) for r in S.tied(marks, records).collect()} == {("quote", "at nine", "m1"), ("number", "212 555 0199", "c1")} and S.tied(marks, records).count() == 2


def test_maps_are_handed_on_a_few_at_a_time():
    parts = list(X._folds(iter([pd.Series(["A  b"] * 600), pd.Series([], dtype=object)]), "tolerant"))
    assert [len(p) for p in parts] == [256, 256, 88, 0] and parts[0].text[0] == "a b" and parts[0].starts[0].nbytes == 12


def test_accounts_are_counted_as_they_are_found(spark):
    accounts = spark.createDataFrame([(k, "chat", f"user{k % 7}", k % 3 if k % 4 else None) for k in range(40)], "id int, app string, identifier string, device_id int")
    links = spark.createDataFrame([(k, k % 5, "confirmed" if k % 2 else "proposed") for k in range(0, 40, 3)], "account_id int, person_id int, status string")
    owners = spark.createDataFrame([(1, 8, "confirmed"), (2, 3, "proposed")], "device_id int, person_id int, status string")
    plain = {}
    for r in G.person_accounts(accounts, links, owners).collect():
        plain.setdefault(r.person_id, []).append(r.id)
    assert {tuple(r) for r in G.accounts_counted(accounts, links, owners).collect()} == {(p, len(i), min(i)) for p, i in plain.items()}
