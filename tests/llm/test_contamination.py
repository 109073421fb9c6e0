"""Decontamination against a plain Python version of the same rule, and planted leaks."""

import re
import random

import regex

from veriframe.llm import contamination as C


def template(text):
    text = text or ""
    slots, words = [], []
    t = regex.sub(r"(?<![\p{L}\p{N}])[0-9]+(?:[.,][0-9]+)*", lambda m: slots.append(("n", m[0])) or "\ue000 ", text)
    numbers = [v for _, v in slots]
    names = []
    t = regex.sub(r"\p{Lu}(?<=[\p{Ll}\p{N},;" + "\ue000" + r"] .)[\p{L}'’-]*", lambda m: names.append(m[0].lower()) or "\ue001", t).lower()
    units = []
    t = regex.sub("\ue000" + r"\s*-?\s*(" + C.UNITS + r")(?![\p{L}\p{N}])", lambda m: units.append(m[1]) or "\ue000 \ue002 ", t)
    words = regex.findall("[\\p{L}\\p{N}\ue000-\ue002]+", t)
    left = {"\ue000": numbers[:], "\ue001": names[:], "\ue002": units[:]}
    values = [(w, left[w].pop(0)) if w in left and left[w] else None for w in words]
    return words, values


def brute(docs, items, size=8, share=0.3, clashes=0.25):
    out = set()
    for d, text in docs:
        dw, dv = template(text)
        for i, item in items:
            iw, iv = template(item)
            n = min(size, len(iw))
            if not n:
                continue
            where = {}
            for p in range(len(dw) - n + 1):
                where.setdefault(tuple(dw[p : p + n]), []).append(p)
            if n < 4 and len(dw) != n:
                continue
            hits = [(p, q) for q in range(len(iw) - n + 1) for p in where.get(tuple(iw[q : q + n]), [])]
            if len({q for _, q in hits}) < share * (len(iw) - n + 1):
                continue
            faced = {}
            for p, q in {(p + k, q + k) for p, q in hits for k in range(n)}:
                if iv[q] and dv[p]:
                    faced.setdefault(iv[q], set()).add(dv[p][1])
            if sum(len(v) > 1 for v in faced.values()) <= clashes * len(faced):
                out.add((d, i))
    return out


ITEMS = [
    (1, "If Alice walks 12 km in 3 hours and then Alice rests for 20 minutes, how far does Alice walk in 9 hours at the same speed?"),
    (2, "The quick brown fox jumps over the lazy dog while seven small birds look on from the old tree near the river bank."),
    (3, "short item here"),
    (4, ""), (5, None),
]


def planted():
    rng = random.Random(2)
    noise = lambda n: " ".join(f"word{rng.randint(0, 999)}" for _ in range(n))
    q = ITEMS[0][1]
    docs = [
        (0, noise(50)), (1, noise(20) + " " + q + " " + noise(20)), (2, noise(9) + ". " + q.replace("Alice", "Robert").replace("12", "15").replace("3 ", "4 ")),
        (3, ITEMS[1][1].upper()), (4, ITEMS[1][1][:60]), (5, "Short item, here."), (10, "a short item here."), (6, None), (7, ""), (8, q.replace("then Alice", "then Bob").replace("does Alice", "does Carol")),
        (9, noise(5) + ITEMS[1][1] + noise(4000)), (None, q),
    ]
    return docs


def test_against_brute_force(spark):
    docs = planted()
    df = spark.createDataFrame([(d, t, 1, "w") for d, t in docs] + [(1, docs[1][1], 1, "w")], "doc_id long, text string, item int, words string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc, r.item) for r in C.find(df, items).collect()}
    want = brute(docs, ITEMS)
    assert got == want
    assert {(1, 1), (2, 1), (3, 2), (5, 3), (9, 2)} <= got and not any(d in (0, 6, 7) for d, _ in got)
    strict = {(r.doc, r.item) for r in C.find(df, items, max_clashes=0.0).collect()}
    assert (8, 1) in got and (8, 1) not in strict and (2, 1) in strict
    rows = C.flag(df, items).collect()
    assert len(rows) == len(docs) + 1 and not any(r.contaminated for r in rows if r.doc_id == 10)
    by = {r.doc_id: r for r in rows}
    assert by[2].reparameterised and not by[1].reparameterised and by[3].contaminated and not by[0].contaminated and by[None].contaminated


def test_template_is_java_and_python_alike(spark):
    from pyspark.sql import functions as F

    texts = ["In 2019 the Eiffel Tower, built by Gustave Eiffel, had 3.5 kg of 12,000 rivets; 5kg more.", "été Über 7 hours", "a 1b 2"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in df.select("i", C.template(F.col("t")).alias("w"), C.slots(F.col("t")).alias("s")).collect():
        words, values = template(texts[r.i])
        assert r.w == words
        assert sorted((s["at"], s["value"]) for s in r.s) == sorted((k, v[1]) for k, v in enumerate(values) if v)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert C.flag(none, items).count() == 0
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert [r.contaminated for r in C.flag(one, items.limit(0)).collect()] == [False]


def test_occurrences_are_judged_one_by_one(spark):
    q = ITEMS[0][1]
    variant = q.replace("Alice", "Robert").replace("12", "15").replace("3 ", "4 ")
    third = q.replace("Alice", "Carol").replace("12", "18").replace("3 ", "5 ").replace("20", "40")
    longer = variant.replace("and then", "and then, quite slowly,")
    mixed = q.replace("then Alice", "then Bob").replace("does Alice", "does Carol").replace("12", "15")
    far = " and some other words of no item stand here between the two of them "
    docs = [
        (1, q + far + variant), (2, variant + far + third), (3, variant + " " + third + " " + q), (4, "So " + longer + far + "so " + third + far + q),
        (5, mixed), (6, mixed + far + q), (7, q + far + q),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    pooled = brute(docs, ITEMS, clashes=0.1)
    assert not {(1, 1), (2, 1), (3, 1), (6, 1)} & pooled  # what one verdict over all values would clear
    got = {r.doc_id: r for r in C.flag(df, items, max_clashes=0.1).collect()}
    assert {d for d in got if got[d].contaminated} == {1, 2, 3, 4, 6, 7}
    assert got[1].reparameterised and got[2].reparameterised and not got[6].reparameterised and not got[7].reparameterised
    assert {1, 2, 3, 4, 6, 7} <= {r.doc_id for r in C.flag(df, items).collect() if r.contaminated}


def test_texts_of_one_id_and_tables_of_figures(spark):
    q, variant = ITEMS[0][1], ITEMS[0][1].replace("Alice", "Robert").replace("12", "15")
    figures = "how many are 1 2 3 4 5 6 7 8 9 10 11 12 in all"
    docs = [(1, "nothing to see in this text of several words"), (1, q), (None, variant), (None, "other words"), (2, "9 8 7 6 5 4 3 2 1 " * 400), (3, figures)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS + [(6, figures), (7, "1 2 3 4 5 6 7 8")], "item_id long, text string")
    got = sorted(((r.doc_id, r.contaminated, r.items, r.reparameterised) for r in C.flag(df, items).collect()), key=str)
    want = [(1, False, "", False), (1, True, "1", False), (None, True, "1", True), (None, False, "", False), (2, False, "", False), (3, True, "6", False)]
    assert got == sorted(want, key=str)
