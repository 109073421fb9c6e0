"""Chunked ids against the libraries; packed pieces against the documents they come from."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veriframe.llm import chunks, packing
from veriframe.llm.queries import op13_packing

RAW = open(P.path("byte_bpe_50k.json"), "rb").read()
SPACES = [" ", "  ", "\n", "\n\n ", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "​", "\x00"]
WORDS = ["der", "Hund", "l'eau", "it's", "<|endoftext|>", "<s>", "▁", "人工智能", "𝔘𝔫", "é", "12,5", "!!", "­", "<0x41>", "don't'll"]


def texts() -> list[str]:
    rng = random.Random(5)
    odd = ["", " ", "  ", "\n", " \n ", "a ", " a", "a  ", "\n a", "a\x1c b", "!\x1c b", "a 　 b", "x<|endoftext|> y", "word" * 300]
    return odd + ["".join(rng.choice(WORDS) + rng.choice(SPACES[: rng.choice((1, 13))]) for _ in range(rng.randrange(1, 40))) for _ in range(400)]


def test_ids_by_chunks_are_the_library_s():
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for special_as_text in (False, True):
        found, tokens, cuts = chunks.byte_level(RAW, special_as_text)
        library.encode_special_tokens = special_as_text
        assert cuts
        for t in texts():
            parts = [chunks.string(key) for key in chunks.keys(t)]
            assert "".join(parts) == t
            length = np.array([len(x) for x in tokens])
            sizes, ids = chunks.ids_of(parts, lambda x: chunks.byte_level_ids(found, x), length)
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
            assert sizes.tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in parts]


def test_pieces_by_chunks_are_the_library_s():
    model = open(P.path("piece_bpe_32k.model"), "rb").read()
    found, _, cuts = chunks.pieces(model)
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert cuts
    for t in texts():
        if "▁" in t:
            continue  # the model takes the mark for a space; the aligner refuses such texts
        keys = chunks.keys(" " + t)
        if t:
            assert all(isinstance(key, str) for key in keys)
        got = [i for key in keys for i in (found.encode(key) if key else [found.piece_to_id("▁")])]
        assert got == library.encode(t) or not t, repr(t)


def rows_of(spark, docs, **more):
    return packing.pack(spark.createDataFrame(docs, "doc_id long, text string, start int"), RAW, **more).collect()


def check(docs, rows, sequence=2048):
    """Every id lies in one piece; sequences are gapless and full."""
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((d is None, d or 0, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for d, t, _ in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length > 0
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == sequence or at < sequence and at & at - 1 == 0
    got = []
    for doc_id, pieces in by_doc.items():
        assert sum(r.length for r in pieces) == sum(len(w) for n, d, w in want if (n, d) == (doc_id is None, doc_id or 0))
        if sum((n, d) == (doc_id is None, doc_id or 0) for n, d, _ in want) == 1:
            whole = [i for r in sorted(pieces, key=lambda r: r.start) for i in r.ids]
            assert {r.doc_tokens for r in pieces} == {len(whole)}
            got.append((doc_id is None, doc_id or 0, tuple(whole)))
    assert set(got) <= set(want)
    return by_sequence


def test_pieces_cover_the_documents(spark):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.choice((1, 5, 60, 900)))), 7) for k in range(150)]
    docs += [(500, None, None), (501, "", 0), (None, "no id", 1), (502, "twice", 1), (502, "twice", 1), (503, "long " * 9000, 1)]
    check(docs, rows_of(spark, docs))


def test_small_sequences_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 4)
    docs = [(k, "word " * (k % 23), 0) for k in range(300)]
    check(docs, rows_of(spark, docs, sequence=16), sequence=16)


def test_empty_table(spark):
    assert rows_of(spark, []) == []


def brute(lengths, rooms, linear, quadratic):
    """The rule, looked up anew for every piece."""
    todo = [(n, -k, 0) for k, n in enumerate(lengths) if n]
    room, cost, placed = list(rooms), [0.0] * len(rooms), []
    while todo:
        todo.sort(key=lambda p: (-p[0], -p[1], p[2]))
        n, k, at = todo[0]
        fit = [s for s in range(len(room)) if room[s] >= n] or [s for s in range(len(room)) if room[s]]
        if not fit:
            break
        todo.pop(0)
        s = min(fit, key=lambda s: (cost[s], s))
        take = min(n, room[s])
        placed.append((-k, at, take, s))
        room[s] -= take
        cost[s] += take * linear + take * take * quadratic
        if take < n:
            todo.append((n - take, k, at + take))
    return placed, sorted((-k, at, n) for n, k, at in todo)


@pytest.mark.parametrize("seed", range(20))
def test_balance_follows_its_rule(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(0, 64) for _ in range(rng.randrange(1, 60))]
    rooms = [rng.choice((8, 64)) for _ in range(rng.randrange(1, 20))]
    assert packing.balance(lengths, rooms, 1.0, 0.125) == brute(lengths, rooms, 1.0, 0.125)


def test_costs_are_balanced():
    rng = random.Random(3)
    lengths = [int(min(700, rng.lognormvariate(5, 1.2))) for _ in range(3000)]
    rooms = [2048] * (sum(lengths) // 2048)
    placed, _ = packing.balance(lengths, rooms)
    cost, plain = np.zeros(len(rooms)), np.zeros(len(rooms) + 1)
    for _, _, n, s in placed:
        cost[s] += n + n * n * packing.QUADRATIC
    at = 0
    for n in lengths:  # in the order of arrival
        plain[at // 2048] += n + n * n * packing.QUADRATIC
        at += n
    assert cost.max() / cost.mean() < 1.12, cost.max() / cost.mean()
    assert cost.std() < 0.5 * plain[:-1].std(), (cost.std(), plain[:-1].std())


def test_query(spark):
    found = op13_packing(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = found.collect()
    by = defaultdict(int)
    for r in rows:
        by[r.sequence_id] += r.length
    assert all(n == 2048 or n & n - 1 == 0 for n in by.values())
