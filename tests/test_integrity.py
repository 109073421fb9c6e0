"""Hash chains against a plain loop, with one long log among short ones."""

import hashlib
import json

from pyspark.sql import functions as F

from veriframe.operators import integrity as G


def test_chain_of_a_long_log(spark):
    long_log = 60_000  # quadratic in the log if its entries are folded in one row
    rows = [(1, k, f"p{k}") for k in range(long_log)] + [(2, 5, "b"), (2, 1, "a"), (2, 9, None), (3, 1, 'ü|"\\\n'), (None, 1, "x")]
    entries = spark.createDataFrame([(u, o, "at", "me", "do", p) for u, o, p in rows], "user long, o long, at string, actor string, action string, payload string").repartition(5)
    chain = G.build_chain(entries, "user", "o")
    assert chain.columns == ["user", "seq", "at", "actor", "action", "payload", "prev_hash", "hash"]
    got = {(r.user, r.seq): (r.payload, r.prev_hash, r.hash) for r in chain.collect()}
    assert len(got) == len(rows)
    for user in (1, 2, 3, None):
        prev = ""
        for seq, (_, _, p) in enumerate(sorted((r for r in rows if r[0] == user), key=lambda r: r[1]), 1):
            h = hashlib.sha256(json.dumps([prev, "at", "me", "do", p or ""], ensure_ascii=False).encode()).hexdigest()
            assert got[user, seq] == (p or "", prev, h)
            prev = h
    breaks = {r.user: (r.n, r.first_break) for r in G.first_break(chain, "user").filter("user IS NOT NULL").collect()}
    assert breaks == {1: (long_log, None), 2: (3, None), 3: (1, None)}


def test_digest_of_a_large_group(spark):
    rows = [(1, k) for k in range(30_000)] + [(k, k) for k in range(2, 60)] + [(None, 3), (None, None)]
    found = G.rows_digest(spark.createDataFrame(rows, "k long, v long").repartition(4), "k", ["v"])
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()  # a group is held in no one list
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(hashlib.sha256(json.dumps([v if v is None else str(v)]).encode()).hexdigest())
    assert {r.k: (r.n, r.digest) for r in found.collect()} == {k: (len(h), hashlib.sha256("".join(sorted(h)).encode()).hexdigest()) for k, h in want.items()}


def test_every_control_character_keeps_a_sound_log_sound(spark):
    odd = [chr(c) for c in (*range(32), 34, 92, 127, 0x2028)] + ["\\u000B", "a\x0bb\x1fc\"\\", "é\n"]
    rows = [(1, k, "t", "a", f"do {c}", c) for k, c in enumerate(odd)]
    chain = G.build_chain(spark.createDataFrame(rows, "log int, o int, at string, actor string, action string, payload string"), "log", "o")
    r = G.first_break(chain, "log").first()
    assert (r.n, r.first_break) == (len(odd), None)


def test_digests_keep_the_bounds_of_fields(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), ("a", ""), ("a", "null"), ('a", "b', "c"), ("a", 'b", "c')]
    df = spark.createDataFrame(rows, "x string, y string").select(G.json_digest(F.col("x"), F.col("y")).alias("d"))
    assert df.distinct().count() == len(rows)
