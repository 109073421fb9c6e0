"""Folds with offsets, parts of excerpts, placing and checking; against a plain search of all pairs."""

import random

import pytest

from veriframe.functions import offsets as O
from veriframe.operators import excerpts as X

EXACT, TOLERANT, LATIN = O.METHODS


@pytest.mark.parametrize("a,b", [
    ("Bring The Bag", "bring the bag"), ("we   meet\nat nine", "we meet at nine"), ("that’s “fine”", "that's \"fine\""), ("now — or never", "now - or never"),
    ("so…", "so..."), ("in​visible", "invisible"), ("мёд", "мед"), ("ﬂat", "flat"), ("мёд", "мёд"),
])
def test_equal_when_folded(a, b):
    assert O.fold(a)[0] == O.fold(b)[0]


@pytest.mark.parametrize("a,b", [("its", "it's"), ("3 more", "three more"), ("й", "и"), ("a_b", "a b")])
def test_still_different_when_folded(a, b):
    assert O.fold(a)[0] != O.fold(b)[0]


@pytest.mark.parametrize("a,b", [("Юлия, да", "yuliya, da"), ("Юлия", "Yulia"), ("Пётр", "Petr"), ("Сергий", "Sergiy"), ("Захар", "Zakhar"), ("Захар", "Zahar"), ("соль", "sol'")])
def test_equal_in_latin_letters(a, b):
    assert O.fold(a, LATIN)[0] == O.fold(b, LATIN)[0]


def test_offsets_lead_back():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "É", "é", " ", "\n", "…", "“", "​", "щ", "ь", "'", "ﬁ", "х"]) for _ in range(rng.randrange(0, 25)))
        for level in O.METHODS:
            folded, starts, ends = O.fold(text, level)
            assert len(folded) == len(starts) == len(ends) and starts == sorted(starts) and ends == sorted(ends)
            assert all(0 <= a < b <= len(text) for a, b in zip(starts, ends))
            if folded and level != LATIN:  # the whole span folds to the whole fold
                assert O.fold(text[starts[0]:ends[-1]], level)[0] == folded
    text = " \n «Ну,  Захар»  идёт"
    folded, starts, ends = O.fold(text, LATIN)
    at = folded.index("zahar")
    assert text[starts[at]:ends[at + 4]] == "Захар" and text[starts[0]] == "«"


def parts(text):
    return [[text[a:b] for a, b in group] for group in O.cores(text)]


def test_parts_of_excerpts():
    text = '[5/1/25 09:10] IVANOV: "bring it at nine."'
    assert parts(text)[0][0] == text and parts(text)[-1] == ["bring it at nine.", "bring it at nine"]
    assert "fine" not in [p for g in parts("IVANOV: fine") for p in g]
    assert parts("«“ … ”»") == [] and parts("") == parts(None) == []
    assert [text[a:b] for text in ["one [...] two ... … three"] for a, b in O.pieces(text, 0, len(text))] == ["one", "two", "three"]


def run(spark, excerpts, bodies, most=25):
    found = X.placed(spark.createDataFrame(excerpts, "excerpt_id long, excerpt string"), spark.createDataFrame(bodies, "id long, body string"))
    text = dict(bodies)
    shown = lambda r: (r.excerpt_id, r.id, r.method, tuple(text[r.id][s.start:s.end] for s in r.spans))
    return sorted((*shown(r), r.total) for r in X.find(found, most).collect()), sorted((*shown(r), r.total) for r in X.find_every(found).collect())


def brute(excerpts, bodies):
    """Parts, methods and bodies in their order, for every pair."""
    first, every = [], []
    for e, excerpt in excerpts:
        decided = None
        for group in O.cores(excerpt):
            best = {}
            for core in group:
                ranges = O.pieces(excerpt, *core)
                for method in O.METHODS:
                    good = []
                    for i, body in bodies:
                        spans = O.place(excerpt, body or "", ranges, method)
                        if spans and O.verified(excerpt, body, ranges, spans, method):
                            row = (e, i, method, tuple(body[a:b] for a, b in spans))
                            good.append(row)
                            best.setdefault(i, row)
                    if good and decided is None:
                        decided = good
            if best:
                every += [(*row, len(best)) for row in best.values()]
                break
        first += [(*row, len(decided)) for row in decided or []]
    return sorted(first), sorted(every)


def test_planted_cases(spark):
    bodies = [
        (1, "bring 3 bags by noon"), (2, "the bags came late"), (3, "They’re  at\nPaul’s"), (4, "мама идёт домой"), (5, "I took the keys from her, then went out"),
        (6, "then went out, I took the keys"), (7, "It is done"), (8, "it is done"), (9, None), (10, ""), (11, "Marya rang"), (12, "the_bag is here"), (13, "zero​width cafés"), (14, "солька тут"),
    ]
    excerpts = [
        (1, "bring 3 bags by noon"), (2, "bag"), (3, "they're at paul's"), (4, "mama idet domoy"), (5, "I took the keys … then went out"), (6, "it is done"),
        (7, 'KIM 5/1/25 9:10 PM: "They’re at Paul’s."'), (8, "Maria rang"), (9, "never said this"), (10, "zero"), (11, "café"), (12, None), (13, "..."), (14, "sol'ka tut"), (15, "IT"), (16, "They"),
    ]
    found, every = run(spark, excerpts, bodies)
    assert (found, every) == brute(excerpts, bodies)
    by = {}
    for e, i, method, spans, _ in found:
        by.setdefault(e, []).append((i, method, spans))
    assert by[1] == [(1, EXACT, ("bring 3 bags by noon",))] and 2 not in by and by[3] == [(3, TOLERANT, ("They’re  at\nPaul’s",))]
    assert by[4] == [(4, LATIN, ("мама идёт домой",))] and by[5] == [(5, EXACT, ("I took the keys", "then went out"))]
    assert by[6] == [(8, EXACT, ("it is done",))] and by[7][0][0] == 3 and by[14] == [(14, LATIN, ("солька тут",))]
    assert not by.keys() & {8, 9, 12, 13} and by[10][0][:2] == (13, EXACT) and by[16] == [(3, EXACT, ("They",))]
    assert [(r[1], r[2]) for r in every if r[0] == 6] == [(7, TOLERANT), (8, EXACT)]


def test_random_excerpts_against_all_pairs(spark):
    rng = random.Random(9)
    words = ["come", "it's", "“now”", "дом", "dom", "Ёлка", "yolka", "kh", "х", "x_y", "don’t", "end."]
    bodies = [(k, rng.choice(["", " "]) + rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(0, 8)))) for k in range(60)]
    excerpts = []
    for k in range(80):
        text = rng.choice(bodies)[1].split()
        a = rng.randrange(len(text) + 1)
        piece = " ".join(text[a:rng.randrange(a, len(text) + 1)])
        excerpts.append((k, rng.choice(["", "A: ", "[1] "]) + rng.choice([piece, piece.upper(), piece.lower() + " ... " + piece, f"'{piece}'!"])))
    assert run(spark, excerpts, bodies) == brute(excerpts, bodies)


def test_matches_are_counted_beyond_the_limit(spark):
    found, every = run(spark, [(1, "ok")], [(k, "ok") for k in range(40)])
    assert len(found) == 25 and {r[-1] for r in found} == {40} and len(every) == 40


def test_the_check_knows_only_the_texts():
    body, excerpt = "we leave the house at ten", "leave the house"
    ok = lambda ranges, spans, method=EXACT, e=excerpt: O.verified(e, body, ranges, spans, method)
    assert ok([(0, 15)], [(3, 18)])
    assert not ok([(0, 15)], [(4, 19)]) and not ok([(1, 15)], [(4, 18)]) and not ok([(0, 15)], [(3, 90)]) and not ok([], [])
    assert not ok([(0, 5), (6, 15)], [(9, 18), (3, 8)]) and not ok([(0, 15)], [(3, 18)], e="LEAVE THE HOUSE") and ok([(0, 15)], [(3, 18)], TOLERANT, "LEAVE THE HOUSE")
    assert not O.verified("Maria", "Marya", [(0, 5)], [(0, 5)], LATIN) and not ok([(0, 15)], [(3, 18)], "other")


def test_text_of_a_fold_without_its_map():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "K", "É", "é", " ", "\n", "\x1f", "\xa0", "`", "…", "“", "\u200b", "Щ", "ь", "'", "ﬁ", "х", "kh", "\u0301", "x", "İ", "ß"]) for _ in range(rng.randrange(0, 12)))
        assert all(O.folded(text, level) == O.fold(text, level)[0] for level in O.METHODS)


def test_common_words_meet_few_bodies(spark):
    # every word is in half of the bodies, the run in one: words alone would meet 150 of them
    bodies = [(k, "the of and" if k % 2 else "of the, and the") for k in range(300)] + [(999, "in and of the")]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    met = X.candidates(frame([(1, "and of")], "excerpt_id long, excerpt string"), frame(bodies, "id long, body string")).collect()
    assert [(r.excerpt_id, r.id) for r in met] == [(1, 999)]
    assert run(spark, [(1, "and of"), (2, "of … the")], bodies, 1000) == brute([(1, "and of"), (2, "of … the")], bodies)
