"""Line dedup and bounded edit distance against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from veriframe.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, min_chars):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    first, out = {}, {}
    for k in order:
        for i, x in enumerate((rows[k][1] or "").split("\n")):
            x = x.strip(" \t\x0b\x0c\r")
            if x:
                first.setdefault(x, (k, i))
    seen = list(first)
    for k in order:
        kept = []
        for i, raw in enumerate((rows[k][1] or "").split("\n")):
            x = raw.strip(" \t\x0b\x0c\r")
            gone = x in first and (first[x] != (k, i) or any(
                min(len(x), len(y)) >= min_chars and y != x and abs(len(x) - len(y)) < 2 and distance(x, y) <= 1 for y in seen[: seen.index(x)]))
            if not gone:
                kept.append(raw)
        out[k] = "\n".join(kept)
    return out


def make_rows(n, kinds):
    rng = random.Random(7)
    alphabet = "abcdé "
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 40))).strip() for _ in range(kinds)]

    def edit(x):
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randint(0, len(x))
            x = rng.choice([x[:i] + rng.choice(alphabet) + x[i:], x[:i] + x[i + 1 :], x[:i] + rng.choice(alphabet) + x[i + 1 :]])
        return x

    return [(d, "\n".join(rng.choice(["", " ", "\t"]) + edit(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for d in range(n)]


@pytest.mark.parametrize("crowd,kinds", [(24, 60), (2, 12), (1, 3)])
def test_against_brute_force(spark, monkeypatch, crowd, kinds):
    monkeypatch.setattr(lines, "CROWD", crowd)
    rows = make_rows(80, kinds) + [(900, ""), (901, None), (902, "x" * 5000), (903, "x" * 4999 + "y"), (904, "\n\n")]
    rows += [(905 + k, f"page number {k} of the book") for k in range(40)]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, line int").repartition(3)
    got = {r.doc_id: r for r in lines.dedup(docs, min_chars=5).collect()}
    want = brute(rows, 5)
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        assert (got[d].text or "") == want[k], (d, t)
        assert got[d].n_lines == len((t or "").split("\n")) and got[d].key == "k"


def test_odd_rows(spark):
    rows = [(1, "the same long line, twice"), (None, "the same long line, twice"), (2, "another long line of text"), (2, "another long line of text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in lines.dedup(docs).collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (None, ""), (2, rows[2][1]), (2, rows[2][1])], key=str)
    assert lines.dedup(docs.limit(0)).count() == 0


def test_texts_of_one_id(spark):
    again, alone = "a line that stands in several texts", "a line that stands in this text alone"
    rows = [(1, again), (5, alone + "\nfirst of two\n" + again), (5, again + "\nsecond of two"), (None, again + "\n" + alone[:-1] + "ly"), (None, "no repeat here at all\n" + again)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.text for r in lines.dedup(docs).collect()))
    assert got == sorted([again, alone + "\nfirst of two", "second of two", alone[:-1] + "ly", "no repeat here at all"])


def test_texts_without_id_lose_no_lines(spark, monkeypatch):
    """Texts of one id, or of none, stay apart where the first of their hashes meet; a null id is not
    the largest id, and the largest id comes before it."""
    monkeypatch.setattr(lines, "_text_hashes", lambda text: (F.lit(7).cast("long"), F.xxhash64(text)))
    rows = [(None, "a line of the first text only\nshared by all of them"), (None, "another text\nits second line, nowhere else"), ((1 << 63) - 1, "shared by all of them\nthe largest id")]
    rows += [(4, "four, first of two\nkept in place"), (4, "four, second of two\nand its own second line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.text) for r in lines.dedup(docs).collect())
    want = [(False, t) for d, t in rows if d] + [(True, "a line of the first text only"), (True, rows[1][1])]
    assert got == sorted(want)


def test_equal_texts_of_a_null_and_the_largest_id(spark):
    rows = [(None, "one text of two rows"), ((1 << 63) - 1, "one text of two rows")]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: "", (1 << 63) - 1: "one text of two rows"}


def test_far_edit(spark):
    """The common beginning is found whole, however long."""
    n = (1 << 21) + 50_000
    x = "".join(random.Random(3).choice("abcdef") for _ in range(n))
    pair = spark.createDataFrame([(x + "tail", x + "Zail")], "a string, b string")
    assert pair.coalesce(1).select(lines.within(F.col("a"), F.col("b"))).first()[0]


def test_bounded_distance(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abé") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abé") for _ in range(rng.randint(0, 9)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", lines.within(F.col("a"), F.col("b")).alias("w"), lines._bit_parallel(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == distance(r.a, r.b) and r.w == (r.d <= 1), r
