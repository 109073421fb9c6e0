"""The Jaccard join against brute force, and connected components against union-find."""

import random

import pytest

from veriframe.llm import jaccard
from veriframe.llm.components import components


def shingles(t):
    w = (t or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def find_classes(ids, edges):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return find_classes(ids, edges)


def make_rows():
    rng = random.Random(4)
    rows = []
    for _ in range(30):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(20, 120))]
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 12])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 99)}"
            rows.append("\n".join(copy) if rng.random() < 0.2 else " ".join(copy))
    rows += ["", "  ", "a b", "a b", "a b c", "la " * 40, "la " * 90]
    hot = [f"h{i}" for i in range(200)]
    for k in range(80):  # a large group of near copies, all different
        copy = list(hot)
        copy[rng.randrange(200)] = f"y{k}"
        rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = make_rows()
    docs = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, nodes int, class_id string").repartition(3)
    found = jaccard.join(docs)
    want = brute(rows)
    got = {r.doc_id: r.class_id for r in found.membership.collect()}
    assert len(got) == len(rows)
    assert got == want
    for r in found.links.collect():
        a, b = shingles(dict(rows)[r.a]), shingles(dict(rows)[r.b])
        assert abs(r.similarity - len(a & b) / len(a | b)) < 1e-12 and r.similarity >= 0.8


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (None, "a b c"), (3, "a b c"), (None, "q"), (4, "x " * 30000), (5, "x " * 30000), (5, "x " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in jaccard.join(docs).membership.collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (None, 3), (3, 3), (None, None), (4, 4), (5, 4), (5, 4)], key=str)
    assert jaccard.join(docs.limit(0)).membership.count() == 0


def test_texts_of_one_id_and_null_ids(spark):
    base = [f"w{k}" for k in range(60)]
    near = [" ".join(base[:k] + ["z"] + base[k + 1 :]) for k in (10, 30)]
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(1, " ".join(base)), (1, other), (7, near[0]), (None, near[1]), (None, near[1]), (None, other + " end"), (9, None)]
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).membership.collect()
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies, r.first) for r in found), key=str)
    first = {(r.doc_id, r.text_id) for r in found if r.first}
    want = [(1, 1, 2, 0), (1, 1, 1, 0), (7, 1, 1, 0), (None, 1, 1, 1), (None, 1, 1, 1), (None, 1, 1, 0), (9, 9, 0, 0)]
    assert sorted((g[:4] for g in got), key=str) == sorted(want, key=str)
    assert first == {(1, 1), (9, 9)} and sum(r.first for r in found) == 3  # two classes, and the empty text


def test_prefixes_are_shortened_until_the_recall(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 9999)}" for _ in range(100)] for _ in range(40)]

    def spoiled(x, n):
        x = list(x)
        for k in range(n):
            x[5 + 10 * k] = f"q{rng.randint(0, 99999)}"
        return " ".join(x)

    def levels(n):
        rows = [(k, " ".join(x)) for k, x in enumerate(base)] + [(100 + k, spoiled(x, n)) for k, x in enumerate(base)]
        return jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).levels

    assert levels(1) == [6]  # links of 0.90: the longest prefixes find nearly all
    assert levels(9) == [6, 5, 4]  # no link: down to the shortest


def test_recall_of_links_on_documents(spark):
    """All links of a real table, by an inverted index of shingles."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    first, holders, want = {}, {}, set()
    for d, t in sorted(docs):
        first.setdefault(" ".join((t or "").split()), d)
    sets = {d: {hash(g) for g in shingles(t)} for t, d in first.items() if t}
    for d, x in sets.items():
        for g in x:
            holders.setdefault(g, []).append(d)
    for d, x in sets.items():
        shared = {}
        for g in x:
            for e in holders[g]:
                shared[e] = shared.get(e, 0) + 1
        want |= {(max(d, e), min(d, e)) for e, n in shared.items() if e != d and n >= 0.8 * len(x | sets[e])}
    got = {(r.a, r.b) for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).links.collect()}
    recall = len(want & got) / max(1, len(want))
    print(f"recall of links: {recall:.4f} of {len(want)}")
    assert len(want) >= 4 and recall >= 0.9 and got <= want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(2001, 2100)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    want = find_classes({x for e in edges for x in e}, edges)
    assert got == want


@pytest.mark.parametrize("block,small", [(16, 3), (32, 10_000)])
def test_every_link_is_counted(spark, monkeypatch, block, small):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SMALL", small)
    rows = make_rows()
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    sets, first = {}, {}
    for d, t in rows:
        first.setdefault(" ".join((t or "").split()), d)
    for d in first.values():
        sets[d] = shingles(dict(rows)[d])
    ids = sorted(d for d in sets if sets[d])
    want = {(a, b) for a in ids for b in ids if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = [(r.a, r.b) for r in found.links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    for r in found.membership.collect():
        assert r.n_links == sum(r.text_id in pair for pair in want), r
