"""Quote search against brute force, with apostrophes of both forms."""

import re

from veriframe.operators import quotes as Q

_WORD = re.compile(r"\w")


def fold(t):
    return re.sub(r"\s+", " ", t.strip(" ").translate(str.maketrans("‘’“”", "''\"\""))).lower()


def aligned(body, quote):
    lead = r"(?<!\w)" if _WORD.match(quote) else ""
    tail = r"(?!\w)" if _WORD.match(quote[-1]) else ""
    return bool(re.search(lead + re.escape(quote) + tail, body))


def test_apostrophes_lose_no_match(spark):
    quotes = [(1, "it's over"), (2, "the dog"), (3, "IT’S OVER"), (4, "rock 'n' roll"), (5, "over"), (6, "nowhere at all"), (7, "'s tail"), (8, "ΟΔΟΣ"), (9, "o'clock")]
    bodies = [
        (1, "They say it’s over now"), (2, "that was the dog's tail"), (3, "It's over"), (4, "rock ‘n’ roll, the dog’s bowl"), (5, "overcome the dogs"),
        (6, "the tail of a dog"), (7, "η ΟΔΟΣ'Α"), (8, "at five o’clock"), (9, ""), (10, None), (11, "the_dog over_it"),
    ]
    found = Q.find_quotes(spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(bodies, "id long, body string"))
    want = set()
    for q, quote in quotes:
        for b, body in bodies:
            if body and aligned(body, quote):
                want.add((q, b, "exact"))
            elif body and aligned(fold(body), fold(quote)):
                want.add((q, b, "folded"))
    assert {tuple(r) for r in found.select("quote_id", "id", "method").collect()} == want
    assert {(1, 1, "folded"), (1, 3, "folded"), (2, 2, "exact"), (2, 4, "exact"), (3, 1, "folded"), (4, 4, "folded"), (9, 8, "folded")} <= want


def test_near_miss_is_the_sequence_ratio(spark):
    from veriframe.functions.text import near_miss

    rows = [("Dominion", "it was Dominant.", True), ("It's been deleted", "it’s been trashed", True), ("Done. It's been deleted.", "see http://x.example/abc", False), ("meet me at noon", "we could MEET me  at moon then", True), ("", "x", False), (None, "x", False), ("x", None, False)]
    df = spark.createDataFrame(rows, "q string, t string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", near_miss("q", "t")).collect())


def test_keyword_score_against_brute_force(spark):
    import random

    rng = random.Random(3)
    words = ["a", "an", "the", "there", "therefore", "cat", "cats", "house", "household", "o'clock"]
    bodies = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for k in range(60)] + [(99, None)]
    queries = [(k, [rng.choice(words) if rng.random() < 0.7 else f"{rng.choice(words)} {rng.choice(words)[:3]}" for _ in range(rng.randint(1, 5))]) for k in range(25)]

    def hit(t, body):
        toks = body.split()
        return t in body if " " in t else any(w.startswith(t) for w in toks) if len(t) >= 4 else t in toks

    want = {}
    for q, terms in queries:
        scored = sorted((-round(sum(hit(t, b) for t in terms) / len(terms), 6), i) for i, b in bodies if b)
        want[q] = [(i, -s) for s, i in scored if s < 0][:3]
    found = Q.keyword_score(spark.createDataFrame(queries, "query_id long, terms array<string>"), spark.createDataFrame(bodies, "id long, body string"), 3).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got == {q: x for q, x in want.items() if x}
