"""Base spans against Python's re, the wider spans, and EM on planted votes."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from veriframe.llm import pii


def luhn(d):
    return sum((x if i % 2 == 0 else 2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    kinds = ["email", "ip", "card", "phone"]
    return [sum(k == j for _, k, _ in out) for j in range(4)], ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in out)


def texts():
    rng = random.Random(9)
    parts = ["a.b@c.de", "@", ".", "x@y", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "12", " ",
             "-", "é", "🙂", "a@b.c_d@e.f", "\n", "(5)", "%", "9999999999999999999999999", "+44 20 7946 0958", "word", "token = \"04dbebab91ab85687d33eeaaf9ac699e\"", "call 555-123-4567 "]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    return made + [None, "", "1" * 20000, "a" * 30000, "1.2.3.4 " * 3000, "+1" + "-2" * 9000, "a@b.c " * 700]


def test_base_spans(spark):
    rows = [(k, t, 0, "s") for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows + rows[:3] + [(None, "a@b.cd", 0, "s")], "doc_id long, text string, kind int, spans string")
    base = F.col("pii").base
    found = pii.spans(docs, pii.Model()).select("doc_id", "text", *[pii.count(base, k) for k in pii.KINDS[:4]], pii.listed(base), F.sha2(pii.listed(base), 256), pii.listed(F.col("pii").spans), "spans").collect()
    assert len(found) == len(rows) + 4
    for r in found:
        counts, line = brute(r.text)
        assert list(r[2:6]) == counts and r[6] == line, r.text[:100]
        assert r[7] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r[8].split(","))


def test_method_adds_spans(spark):
    rows = [
        (1, "please call 555-123-4567 today"), (2, "write to jane (at) mail (dot) com now"), (3, "yours, Mr. Peter Miller of Rome"),
        (4, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" end"), (5, "nothing at all here"), (6, "a.b@c.com and 8.8.8.8"),
    ] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    assert model.reliability and all(0.5 <= a < 1 for a in model.reliability.values())
    got = {r[0]: r[1] for r in pii.spans(docs, model).select("doc_id", pii.listed(F.col("pii").spans)).collect()}
    want = {1: "phone:12:24", 2: "email:9:30", 3: "name:11:23", 4: "secret:9:49", 5: "", 6: "email:0:9,ip:14:21"}
    for k, v in want.items():
        text = dict(rows)[k]
        kinds = [(s.split(":")[0], text[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in got[k].split(",") if s]
        assert [x for x, _ in kinds] == [s.split(":")[0] for s in v.split(",") if s], (k, kinds)


def test_recall_and_precision_of_the_method(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("the of market river walks under seven bright stones chapter version page".split())
    noise = lambda: " ".join(word() for _ in range(rng.randint(5, 40)))
    data = [
        lambda: f"user{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.org", lambda: f"please call {rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)} today",
        lambda: f"reach me at joe{rng.randint(1, 99)} (at) mail (dot) com", lambda: f"dear Mr. {rng.choice(['Peter', 'Hans', 'Paul'])} {rng.choice(['Miller', 'Braun'])}",
        lambda: "password = \"" + "".join(rng.choice("abcdef0123456789") for _ in range(32)) + "\"", lambda: f"server 10.{rng.randint(0, 255)}.3.{rng.randint(1, 254)}",
    ]
    rows = [(k, f"{noise()} {data[k % 6]() if k % 2 == 0 else ''} {noise()}" if k % 4 < 2 else f"{noise()} {data[k % 6]() if k % 2 else ''} {noise()}") for k in range(400)]
    holds = {k: (k % 2 == 0) == (k % 4 < 2) for k, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[1] > 0 for r in pii.spans(docs, pii.fit(docs)).select("doc_id", F.size("pii.spans")).collect()}
    recall = sum(got[k] for k in got if holds[k]) / sum(holds.values())
    clean = sum(not got[k] for k in got if not holds[k]) / sum(not h for h in holds.values())
    assert recall >= 0.95 and clean >= 0.95, (recall, clean)


def test_many_spans_in_one_text(spark):
    text = "".join(f"mail a{k}@b.co or jo{k} (at) x (dot) com. " for k in range(4000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = pii.Model(bias={0: 5.0})
    r = pii.spans(docs, model).select(F.size("pii.base"), F.size("pii.spans")).first()
    assert tuple(r) == (4000, 8000)


def test_em_finds_the_reliable_labelers():
    rng = random.Random(1)
    truth_rate, right = 0.6, dict(zip(pii.LABELERS, (0.95, 0.9, 0.85, 0.8, 0.55, 0.5)))
    counts = {}
    for _ in range(20000):
        y = rng.random() < truth_rate
        v = tuple((1 if (rng.random() < right[n]) == y else -1) if rng.random() < 0.8 else 0 for n in pii.LABELERS)
        counts[v] = counts.get(v, 0) + 1
    table = [{"kind": 0, **dict(zip(pii.LABELERS, v)), "length": 0, "digits": 0, "n": n} for v, n in sorted(counts.items())]
    post, found = pii.expectation_maximisation(table)
    for n, a in right.items():
        assert abs(found[0, n] - a) < 0.06
    model = pii.train(table, post)
    assert model.weights["shape", 1] > model.weights["boundary", 1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.spans(docs, pii.fit(docs)).count() == 0
