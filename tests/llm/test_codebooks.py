"""Codebooks against a plain search of all entries, and the SQL twin on a whole table."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from veriframe.llm import codebooks
from veriframe.llm.queries import op11_vector_codes, oracle_sql


def brute(rows, entries=256, rounds=4):
    """[(id, code, error, label error)] and the codebooks, by loops over Python numbers."""
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dimension = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dimension]
    width = -(-dimension // 4)
    bound = (1 << 30) // width
    whole = [[min(bound, max(-bound, math.floor(1024 * x))) for x in v] + [0] * (4 * width - dimension) for _, v, _ in kept]
    parts = [[v[k * width : (k + 1) * width] for v in whole] for k in range(4)]
    codes, books, errors = [[None] * 4 for _ in kept], [], [0] * len(kept)
    for k in range(4):
        book = [p[:] for p in parts[k][:entries]]
        for r in range(rounds + 1):
            near = [min((sum((x - y) ** 2 for x, y in zip(p, e)), j) for j, e in enumerate(book)) for p in parts[k]]
            if r < rounds:
                for j in range(len(book)):
                    own = [p for p, (_, at) in zip(parts[k], near) if at == j]
                    if own:
                        book[j] = [sum(c) // len(own) for c in zip(*own)]
        for n, (d, j) in enumerate(near):
            codes[n][k] = j
            errors[n] += d
        books.append(book)
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, "".join(f"{c:02x}" for c in code), e, by_label[label]) for (i, _, label), code, e in zip(kept, codes, errors)], books


def run(spark, rows, entries=256):
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    codes = codebooks.fit(df, entries=entries)
    found = codebooks.encode(df, codes).collect()
    return [(r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in found], codes


def key(r):
    return r[0] is None, r[0] or 0, r[1:]


def test_codes_against_all_entries(spark):
    rng = random.Random(4)
    near = [[rng.gauss(0, 0.1) for _ in range(8)] for _ in range(6)]
    rows = [(k, [x + rng.choice((0, 0, 1 / 1024, -1 / 1024, 0.01)) for x in rng.choice(near)], rng.choice((1, 1, 2, None))) for k in range(200)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.1] * 7 + [None], 1), (903, [0.1] * 7 + [math.nan], 1), (904, [math.inf] + [0.1] * 7, 1)]
    rows += [(905, [0.1] * 4, 1), (906, [1e300, -1e300] + [0.0] * 6, 2), (None, near[0], 3), (7, near[1], 1), (7, near[1], 1)]
    for entries in (16, 256):
        found, codes = run(spark, rows, entries)
        want, books = brute(rows, entries)
        assert sorted(found, key=key) == sorted(want, key=key)
        assert [b.tolist() for b in codes.books] == books
        assert codes.digest() == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_a_dimension_that_does_not_divide(spark):
    rng = random.Random(6)
    rows = [(k, [rng.random() for _ in range(6)], 0) for k in range(20)]
    assert sorted(run(spark, rows, 5)[0]) == sorted(brute(rows, 5)[0])


def test_empty_table(spark):
    assert run(spark, [])[0] == [] and run(spark, [(1, None, 1)])[0] == []


@pytest.mark.parametrize("seed", range(8))
def test_equal_average_search(seed):
    """Ties go to the lower index, also between entries of one sum."""
    rng = np.random.default_rng(seed)
    book = rng.integers(-4, 5, (40, 3))
    book[7] = book[30]
    parts = rng.integers(-6, 7, (500, 3))
    index, best = codebooks.Book(book).nearest(parts)
    distance = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (best == distance.min(axis=1)).all() and (index == distance.argmin(axis=1)).all()


def test_search_closes_early():
    """A side is closed once the gap of sums alone is too large."""
    book = codebooks.Book(np.arange(256)[:, None] * np.full((1, 4), 100))
    looked = 0
    step = book._step

    def counted(parts, own, best, index, at, rows, dimension, way):
        nonlocal looked
        looked += len(rows)
        return step(parts, own, best, index, at, rows, dimension, way)

    book._step = counted
    book.nearest(np.arange(256)[:, None] * np.full((1, 4), 100) + 3)
    assert looked < 256 * 6


def test_query_against_sql(spark):
    for sf in ("sf0.001",):
        found = op11_vector_codes(spark, f"/root/testdata/{sf}")
        db = duckdb.connect()
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
        want = db.sql(oracle_sql()["op11_vector_codes"])
        assert found.columns == want.columns
        assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
