"""Substring dedup against brute force, in many slices and groups."""

import hashlib
import random
import re

import numpy as np
import pytest

from veriframe.llm import repeats, wordhash


def brute(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = [float("inf") if d is None else d for d, _ in rows]
    least = {}
    for d, w in zip(key, words):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(d, least.get(g, float("inf")))
    out = []
    for (doc, _), d, w in zip(rows, key, words):
        gone = {i + k for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for k in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def make_rows(n=120):
    rng = random.Random(3)
    passages = [" ".join(f"p{k}w{i}" for i in range(rng.randint(11, 40))) for k in range(8)]
    rows = []
    for d in range(n):
        parts = [" ".join(f"u{rng.randint(0, 99999)}" for _ in range(rng.randint(0, 30))) for _ in range(3)]
        parts += rng.sample(passages, rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(d + n, rows[0][1]) for d in range(20)]
    rows += [(900, ""), (901, None), (None, rows[1][1]), (902, "la " * 60), (903, "la " * 40), (902, "la " * 60), (904, "x" * 20000), (905, "é 日本\x0b" * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_against_brute_force(spark, size):
    rows = make_rows()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, lost string, n_words int").repartition(3)
    found = repeats.remove(docs, slice_bytes=size).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str) == brute(rows)


def test_heavy_prefixes_and_many_groups(spark):
    rows = make_rows(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeats.remove(docs, groups=500).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str) == brute(rows)


def test_groups_follow_the_counted_suffixes(spark, monkeypatch):
    rows = make_rows(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    keep = repeats._subtrees
    monkeypatch.setattr(repeats, "GROUP", 200)
    monkeypatch.setattr(repeats, "_subtrees", lambda groups: made.append(groups) or keep(groups))
    found = repeats.remove(docs).collect()
    windows = sum(max(0, len((t or "").split()) - 12) for _, t in rows)
    assert made == [-(-windows // 200)]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str) == brute(rows)


def test_null_and_largest_ids(spark):
    text = " ".join(f"w{k}" for k in range(20))
    last = 2**63 - 1
    rows = [(None, text), (None, text + " more"), (last, text), (None, "alone " * 3), (5, "other " + text)]
    found = repeats.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in found), key=str) == sorted(
        [(None, 20, 20), (None, 21, 20), (last, 20, 20), (None, 3, 0), (5, 21, 0)], key=str
    )


def test_empty_table(spark):
    assert repeats.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_as_bytes_split():
    rng = np.random.default_rng(1)
    for _ in range(50):
        texts = [bytes(rng.choice(np.frombuffer(b"ab \n\t\x0b", np.uint8), rng.integers(0, 12))) for _ in range(6)]
        words = wordhash.Words(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])
        assert words.counts().tolist() == [len(t.split()) for t in texts]
        every = [w for t in texts for w in t.split()]
        assert len({(w, int(h)) for w, h in zip(every, words.hash)}) == len(set(every))
