"""Held-out accuracy on planted labels, and the odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from veriframe.llm import toxicity


def planted(n=1500):
    rng = random.Random(6)
    vocabulary = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for d in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(max(1, len(words) // 12)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "m0ron", "zugzwangig", "zugzwangen", "you scum", "zugzwanglich"]))
        docs.append((d, " ".join(words), "x", 0.5))
        if d % 3:
            labels.append((d, 1, int(bad)))
    return docs, labels, {d: int(" idiot" in f" {t}" or any(x in t for x in ("m0ron", "zugzwang", "scum"))) for d, t, _, _ in docs}


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels, truth = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string, label string, score double")
    return df, toxicity.fit(df.drop("score"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), truth


def test_held_out_accuracy(spark, fitted):
    docs, model, truth = fitted
    rows = toxicity.score(docs.drop("score"), model).select("doc_id", toxicity.held_out().alias("h"), "score", "label").collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.h]
    right = sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in out)
    assert len(out) > 200 and right / len(out) > 0.97
    assert any(p.startswith("zugzw") for p in model.prefixes)


def test_odd_rows_and_order(spark, fitted):
    _, model, _ = fitted
    rows = [(1, None), (2, ""), (None, "you idiot, you scum"), (3, "idiot " * 20000), (3, "word1 word2"), (3, "word1 word2")]
    found = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).select("doc_id", "score", toxicity.held_out().alias("h")).collect()
    assert len(found) == 6 and all(r.score is not None and r.h is not None for r in found)
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0, 0.0]
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {1.0}


def test_remainder_is_crc32(spark):
    import zlib

    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
