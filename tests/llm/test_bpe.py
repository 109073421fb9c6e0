"""Encoding and counting against the libraries, and the exact round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from veriframe.llm import bpe

RANKS = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
MERGES = open(P.path("byte_bpe_50k.json"), "rb").read()

TEXTS = [
    "", " ", "Hello world", "it's  the\n\n end \t", "aaaaaaaaaaaa", "ab" * 4000, "naïve 日本語 🙂 12345", "x<|endoftext|>y",
    "don't won't 'S", "\x00\x1c\x85", "the the the", " " * 300, "é" * 50,
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _random_texts(n):
    rng = random.Random(5)
    parts = ["a", "ab", "the", " ", "  ", "\n", "é", "日", "1", "!", "'s", "<|endoftext|>", "Zz", "ing", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_encode_and_decode(spark, library):
    texts = TEXTS + _random_texts(200) + [None]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    found = {r.doc_id: r for r in bpe.encode(docs, RANKS, P.PATTERN).collect()}
    assert len(found) == len(texts)
    for k, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert found[k].ids == want and found[k].n_tokens == len(want)
        assert found[k].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert found[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in enumerate(texts)}


def test_counts(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = TEXTS + _random_texts(200)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, None), (7, "again"), (7, "again")], "doc_id long, text string")
    rows = bpe.count(docs, MERGES, P.PATTERN).collect()
    assert len(rows) == len(texts) + 3
    want = [(k, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for k, t in enumerate(texts)]
    want += [(None, 0, 0, False)] + [(7, 5, 1, False)] * 2
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, RANKS, P.PATTERN).count() == bpe.count(docs, MERGES, P.PATTERN).count() == 0


def test_memory_of_pieces_is_bounded(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    enc = bpe.RankEncoder(RANKS, P.PATTERN)
    memory = bpe._Pieces()
    for words in (["a", "b", "c", "d"], ["e", "f"], ["a"]):
        new = memory.miss(words)
        memory.place.update(zip(new, range(len(memory.place), len(memory.place) + len(new))))
        assert all(w in memory.place for w in words)
    assert [int(x) for a in enc.encode_pieces([b" tokenization"]) for x in a] == library.encode_ordinary(" tokenization")


def test_wide_rows_are_linked(library):
    enc = bpe.RankEncoder(RANKS, P.PATTERN)
    rng = random.Random(6)
    pieces = ["a" * 3000, "ab" * 5000, "the" * 100 + "x" * 40, "é" * 300, "=" * 129]
    pieces += ["".join(rng.choice("abcdeing st") for _ in range(rng.randint(120, 9000))).replace(" ", "t") for _ in range(12)]
    rank = library._mergeable_ranks
    for piece, ids in zip(pieces, enc.encode_pieces([p.encode() for p in pieces])):
        want = library._core_bpe.encode_single_piece(piece.encode()) if piece.encode() not in rank else [rank[piece.encode()]]
        assert ids.tolist() == want, piece[:40]


def test_memory_of_characters_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 10)
    memory = bpe._Pieces()
    memory.place.update({p: 0 for p in memory.miss(["x" * 50])})
    assert memory.miss(["y"]) == ["y"] and not memory.place
