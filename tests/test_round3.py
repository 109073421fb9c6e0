"""Retrieval, naming, overlaps, devices and edges without pairs of all that meet: against plain rules."""

from pyspark.sql import functions as F

from veriframe.operators import evidence as E
from veriframe.operators import lookups as L
from veriframe.operators import paragraphs as P
from veriframe.operators import quotes as Q
from veriframe.operators import statements as S
from veriframe.operators import timeline as T


def test_retrieval_asks_once_what_queries_share(spark):
    """Queries of one account, terms and window have one ask; two sides rank before one; an account of both sides is no second."""
    records = [(f"r{i}", i % 4 if i % 7 else None, [(i * 3) % 5, i % 3], i * 10 if i % 11 else None, f"note {i % 3}") for i in range(60)]
    queries = [(q, [[q % 3], [3, q % 2]], ["note 1"], lo, lo + 150 if q % 4 else None) for q, lo in enumerate([100, 100, 100, 300, None, 300, 100, 250])]
    r = spark.createDataFrame(records, "id string, sender int, recipients array<int>, us long, text string")
    got = Q.retrieve(spark.createDataFrame(queries, "query_id int, sides array<array<int>>, terms array<string>, lo long, hi long"), r, 4).collect()
    want = set()
    for q, sides, terms, lo, hi in queries:
        rows = []
        for id_, sender, to, us, text in records:
            held = {a for a in [sender, *to] if a is not None}
            if held & {a for s in sides for a in s}:
                two = sum(bool(held & set(s)) for s in sides) >= 2 and len(held & {a for s in sides for a in s}) >= 2
                rows.append((2 if two else 1, 1.0 if terms[0] in text else 0.0, us, id_))
        timed = [x for x in rows if x[2] is not None]
        inside = [x for x in timed if lo is not None and hi is not None and lo <= x[2] <= hi]
        edges = [max((x for x in timed if lo is not None and x[2] < lo), key=lambda x: x[2:], default=None), min((x for x in timed if hi is not None and x[2] > hi), key=lambda x: x[2:], default=None)]
        edges = sorted([x for x in edges if x], key=lambda x: x[3])
        best = sorted(inside, key=lambda x: (-x[0], -x[1], x[2], x[3]))[: 4 - len(edges)]
        want |= {(q, x[3], x[0], x[1], i, False) for i, x in enumerate(best, 1)} | {(q, x[3], x[0], x[1], i, True) for i, x in enumerate(edges, 1)}
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 20


def test_naming_classes_hold_every_pair(spark):
    claims = spark.createDataFrame([(1, "Saw OLD Plate"), (2, "saw the old plate!"), (3, "Saw old plate."), (4, None), (5, "nobody"), (6, "the old plates")], "claim_id int, text string")
    names = spark.createDataFrame([(7, "The Old Plate"), (8, "old plate"), (9, "Plate"), (9, "old plate"), (10, "saw")], "person_id int, name string")
    rows = S.naming_classes(claims, names).collect()
    claim, person = ({r.id: r.class_id for r in rows if r.kind == k} for k in ("claim", "person"))
    named = {(r.id, r.class_id) for r in rows if r.kind == "named"}
    assert {(c, p) for c in claim for p in person if (claim[c], person[p]) in named} == {tuple(x) for x in S.claims_naming(claims, names).collect()}
    assert claim[3] == 1 and person == {7: 7, 8: 7, 9: 9, 10: 10} and len(named) == 6


def test_device_classes_hold_every_pair(spark):
    accounts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "b"), (4, "c"), (5, "a"), (5, "a"), (6, None)], "source_id int, key string")
    models = spark.createDataFrame([(i, "x" if i != 5 else "y") for i in range(1, 7)], "source_id int, model string")
    rows = L.device_classes(accounts, models).collect()
    held = {r.left: r.right for r in rows if r.kind == "member"}
    pairs = {(r.left, r.right): r.n_shared for r in rows if r.kind == "pair"}
    got = {(a, b, pairs[key]) for a in held for b in held if a < b and (key := tuple(sorted((held[a], held[b])))) in pairs}
    assert got == {tuple(x) for x in L.source_pairs(accounts, models).collect()} == {(1, 2, 2), (1, 3, 1), (2, 3, 1)}


def test_overlaps_are_counted(spark):
    gaps = spark.createDataFrame([(s, scope, f"a{i}", "", i * 7, i * 7 + 5 + i % 3 * 20) for s in ("p", "q") for scope in ("phone", "app") for i in range(12)], "source_id string, scope string, app_key string, thread_key string, start_us long, end_us long")
    stated = spark.createDataFrame([(i, "pqr"[i % 3], None if i % 5 == 0 else i * 3, None if i % 7 == 0 else i * 3 + i % 4) for i in range(40)], "stated_id int, source_id string, lo long, hi long")
    want = {tuple(r) for r in T.overlapping(stated, gaps).groupBy("stated_id", "scope").count().collect()}
    assert {tuple(r) for r in T.overlaps_counted(stated, gaps, width=16).collect()} == want and len(want) > 30


def test_nearest_edges(spark):
    windows = spark.createDataFrame([(i, "ab"[i % 2], 50 + i % 3 * 20, 90 + i % 4 * 20) for i in range(9)], "query_id int, quote string, lo long, hi long")
    records = spark.createDataFrame([(f"r{i}", "abc"[i % 3], i * 5 % 230 if i % 9 else None) for i in range(120)], "id string, quote string, us long")
    outside = windows.join(records, "quote").filter("NOT us BETWEEN lo AND hi").selectExpr("*", "true AS quote_hit")
    want = {tuple(r) for r in E.quote_edges(outside, 4, 30).collect()}
    got = [tuple(r) for r in E.nearest_edges(windows, records, "quote", 4, 30).collect()]
    assert set(got) == want and len(got) == len(want) > 20


def test_documents_of_one_partition_follow_one_another(spark):
    """Paragraphs do not depend on which documents share a task, nor on the size of its batches."""
    rows = [(d, i // 5, i % 5, 72.0, i % 5 * 14.0 + (i % 5 > 2) * 14.0, f"{i // 4 + 1}. said {d}." if i % 4 == 0 else "and more.") for d in range(6) for i in range(17)]
    lines = lambda some: spark.createDataFrame(some, "doc long, page int, no long, x0 double, y0 double, text string")
    assert isinstance(P._numbered([P._Line(1, 0, 0, 72.0, 0.0, 1, True, False, 5)]), list)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        together = {tuple(r) for r in P.paragraphs(lines(rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    alone = {tuple(r) for r in P.paragraphs(lines([r for r in rows if r[0] == 3])).collect()}
    assert {r for r in together if r[0] == 3} == alone and len(together) == len(rows) and len({r[3] for r in alone}) > 4
