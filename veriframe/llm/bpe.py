"""Byte-level BPE in batches of numpy arrays: encoding and decoding (2), token counts (5).

Both operators run inside Arrow batches that Spark hands out; nothing is shuffled, no state
is kept between rows but a bounded cache of pieces, and a lost task is simply run again. A
batch is worked through in slices of ``SLICE_CHARS`` characters, so memory follows one slice
or one text, whichever is longer, and not the batch.

Encoding (2) gathers the distinct pieces of a slice into matrices, one per length bucket,
padded with -1. In each round every row merges its leftmost pair of minimum rank, finished
rows leave the matrix (compaction), and the rank of a pair comes from an open-addressing hash
table held in arrays. In matrices wider than ``WIDE`` a row is not closed up after a merge: its
symbols are linked, and the least rank of each block of a row is kept, so that a round costs a
block of the row and not the whole of it.

Counting (5) keeps the pieces of a slice as one ragged array and merges in every sequence all
places of its lowest-rank pair at once. That is the library's result because a pair which a
merge creates always ranks above that merge.

Nulls count as empty texts and give zero tokens. Rows are answered one by one, so repeated
ids and repeated rows each get their own answer; of the input only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters worked on at once, pieces and their characters remembered, and bytes from which rows are linked.
SLICE_CHARS, CACHE_PIECES, CACHE_CHARS, WIDE = 1 << 20, 200_000, 1 << 22, 128

_NONE = np.iinfo(np.int64).max


# ---------------------------------------------------------------- pair tables
class PairTable:
    """pair of ids -> (rank, id of the merged token), by open addressing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int64)
        self.merged = np.full(1 << bits, -1, np.int64)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        todo = np.arange(len(key))
        at = self._slot(key)
        while len(todo):
            free = self.keys[at[todo]] == -1
            first = np.unique(at[todo[free]], return_index=True)[1]
            won = todo[free][first]
            self.keys[at[won]], self.ranks[at[won]], self.merged[at[won]] = key[won], rank[won], merged[won]
            todo = todo[self.keys[at[todo]] != key[todo]]
            at[todo] = at[todo] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged ids; a pair that is no token, or has a padded side, ranks last."""
        shape = left.shape
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        pad = ((left < 0) | (right < 0)).ravel()
        at = self._slot(key)
        seen = self.keys[at]
        moved = np.flatnonzero((seen != key) & (seen != -1) & ~pad)
        while len(moved):
            at[moved] = at[moved] + 1 & self.mask
            seen = self.keys[at[moved]]
            moved = moved[(seen != key[moved]) & (seen != -1)]
        hit = (self.keys[at] == key) & ~pad
        return np.where(hit, self.ranks[at], _NONE).reshape(shape), np.where(hit, self.merged[at], -1).reshape(shape)


# ------------------------------------------------------------------- encoding
class RankEncoder:
    """Ranks of byte strings (a .tiktoken file); a pair ranks as the bytes it makes."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        order = sorted(self.ranks.items(), key=lambda x: x[1])
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (self.ranks[tok[:k]], self.ranks[tok[k:]], rank)
            for tok, rank in order
            for k in range(1, len(tok))
            if tok[:k] in self.ranks and tok[k:] in self.ranks
        ]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank, rank)
        # tokens' bytes, ragged
        top = max(self.ranks.values()) + 1
        size = np.zeros(top + 1, np.int64)
        for tok, r in order:
            size[r + 1] = len(tok)
        self.token_at = np.cumsum(size)
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in order), np.uint8)
        if len(order) != top:
            raise ValueError("the ranks are not 0, 1, 2, ...")

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[k] = np.array([rank], np.int64)
            else:
                n = len(piece)
                buckets.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append(k)
        for width, members in buckets.items():
            step = max(1, (1 << 20) // width)
            for lo in range(0, len(members), step):
                merge = self._by_linked_rows if width > WIDE else self._by_matrix
                merge(pieces, members[lo : lo + step], width, out)
        return out  # type: ignore[return-value]

    def _by_matrix(self, pieces: list[bytes], members: list[int], width: int, out: list) -> None:
        ids = np.full((len(members), width + 1), -1, np.int64)
        for row, k in enumerate(members):
            ids[row, : len(pieces[k])] = self.of_byte[np.frombuffer(pieces[k], np.uint8)]
        who = np.array(members)
        ranks, merged = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(who):
            best = ranks.argmin(axis=1)  # the first of equal ranks: leftmost
            rows = np.arange(len(who))
            live = ranks[rows, best] != _NONE
            if not live.all():  # compaction: finished rows leave
                for r in np.flatnonzero(~live):
                    out[who[r]] = ids[r][ids[r] >= 0]
                ids, ranks, merged, who, best = ids[live], ranks[live], merged[live], who[live], best[live]
                rows = np.arange(len(who))
                if not len(who):
                    break
                used = int((ids >= 0).sum(axis=1).max()) + 1
                if used < ids.shape[1]:
                    ids, ranks, merged = ids[:, :used], ranks[:, : used - 1], merged[:, : used - 1]
            new = merged[rows, best]
            shift = np.arange(ids.shape[1]) > best[:, None]
            ids = np.where(shift, np.concatenate([ids[:, 1:], np.full((len(who), 1), -1)], axis=1), ids)
            ids[rows, best] = new
            gone = np.arange(ranks.shape[1]) >= best[:, None]
            pad = lambda a, x: np.concatenate([a[:, 1:], np.full((len(who), 1), x)], axis=1)
            ranks, merged = np.where(gone, pad(ranks, _NONE), ranks), np.where(gone, pad(merged, -1), merged)
            ranks[rows, best], merged[rows, best] = self.pairs.find(ids[rows, best], ids[rows, best + 1])
            has = np.flatnonzero(best > 0)
            b = best[has]
            ranks[has, b - 1], merged[has, b - 1] = self.pairs.find(ids[has, b - 1], ids[has, b])

    def _by_linked_rows(self, pieces: list[bytes], members: list[int], width: int, out: list) -> None:
        """As ``_by_matrix``, for wide rows; a merged symbol's place holds -1."""
        block = 1 << (width.bit_length() // 2)
        ids = np.full((len(members), width + 1), -1, np.int64)
        for row, k in enumerate(members):
            ids[row, : len(pieces[k])] = self.of_byte[np.frombuffer(pieces[k], np.uint8)]
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (len(members), 1))
        before = np.tile(np.arange(-1, width, dtype=np.int32), (len(members), 1))
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])[0].reshape(len(members), width // block, block)
        least = ranks.min(axis=2)
        rows = np.arange(len(members))
        while len(rows):
            held = least[rows]
            where = held.argmin(axis=1)  # the first of equal ranks: leftmost
            low = held[np.arange(len(rows)), where]
            live = low != _NONE
            if not live.all():  # compaction: finished rows leave
                for r in rows[~live]:
                    out[members[r]] = ids[r][ids[r] >= 0]
                rows, where, low = rows[live], where[live], low[live]
                if not len(rows):
                    break
            at = where * block + (ranks[rows, where] == low[:, None]).argmax(axis=1)
            right = after[rows, at]
            ids[rows, at] = self.pairs.find(ids[rows, at], ids[rows, right])[1]
            ids[rows, right] = -1
            ranks[rows, right // block, right % block] = _NONE
            beyond = after[rows, right]
            after[rows, at] = beyond
            before[rows, beyond] = at
            ranks[rows, where, at % block] = self.pairs.find(ids[rows, at], ids[rows, beyond])[0]
            left = before[rows, at]
            has = left >= 0
            r, left = rows[has], left[has]
            ranks[r, left // block, left % block] = self.pairs.find(ids[r, left], ids[r, at[has]])[0]
            for k, b in ((rows, where), (rows, right // block), (r, left // block)):
                least[k, b] = ranks[k, b].min(axis=1)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.token_at[ids + 1] - self.token_at[ids]
        return self.token_bytes[_ragged(self.token_at[ids], size)].tobytes()


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ranges start[k] .. start[k] + size[k]."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


# ------------------------------------------------------------------- counting
class MergeCounter:
    """Merges in listed order (a tokenizers .json file with a byte-level BPE model)."""

    def __init__(self, raw: bytes, pattern: str):
        spec = json.loads(raw)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model["ignore_merges"]:
            raise ValueError("not a plain byte-level BPE file")
        self.pattern = regex.compile(pattern)
        vocab = model["vocab"]
        shown = _shown_bytes()
        self.of_byte = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, merged = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).T
        self.pairs = PairTable(left, right, np.arange(len(merges)), merged)
        # a special string in a text is one token, taken before all else; the longest first
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pieces of a text and the number of special strings in it."""
        if self.special is None or not (n := len(self.special.findall(text))):
            return self.pattern.findall(text), 0
        return [p for part in self.special.split(text) for p in self.pattern.findall(part)], n

    def count_pieces(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each piece."""
        size = np.array([len(p) for p in pieces], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), size)
        left = size.copy()
        rank, merged = self._ranks(ids, seq)
        while len(ids):
            lowest = np.full(len(pieces), _NONE, np.int64)
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest[seq[first]] = np.minimum.reduceat(rank, first)
            going = lowest[seq] != _NONE
            if not going.all():  # finished sequences leave the array
                ids, seq, rank, merged = ids[going], seq[going], rank[going], merged[going]
                if not len(ids):
                    break
            hit = rank == lowest[seq]
            # places that overlap (aaa) are taken from the left, every other one
            start = hit & ~np.r_[False, hit[:-1]]
            at = np.arange(len(ids))
            run = np.maximum.accumulate(np.where(start, at, 0))
            hit &= (at - run) % 2 == 0
            left -= np.bincount(seq[hit], minlength=len(pieces))
            ids = np.where(hit, merged, ids)
            keep = ~np.r_[False, hit[:-1]]
            changed = hit | np.r_[hit[1:], False] | np.r_[hit[2:], False, False][: len(ids)]
            ids, seq, rank, merged, changed = ids[keep], seq[keep], rank[keep], merged[keep], changed[keep]
            redo = np.flatnonzero(changed)
            rank[redo], merged[redo] = self._ranks(ids, seq, redo)
        return left

    def _ranks(self, ids: np.ndarray, seq: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the pair that begins at each place, last where the sequence ends."""
        at = np.arange(len(ids)) if at is None else at
        nxt = np.minimum(at + 1, len(ids) - 1)
        ends = (at + 1 >= len(ids)) | (seq[nxt] != seq[at])
        return self.pairs.find(ids[at], np.where(ends, -1, ids[nxt]))


def _shown_bytes() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


# --------------------------------------------------------------------- Spark
@lru_cache(maxsize=4)
def _rank_encoder(raw: bytes, pattern: str) -> RankEncoder:
    return RankEncoder(raw, pattern)


@lru_cache(maxsize=4)
def _merge_counter(raw: bytes, pattern: str) -> MergeCounter:
    return MergeCounter(raw, pattern)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of at most SLICE_CHARS characters, or of one longer text."""
    texts, size, first = [], 0, 0
    for k, text in enumerate(batch.column("text").to_pylist()):
        text = text or ""
        if texts and size + len(text) > SLICE_CHARS:
            yield first, texts
            texts, size, first = [], 0, k
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


class _Pieces:
    """Bounded memory of pieces: text -> place in ragged arrays of what was computed for it."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0

    def miss(self, wanted: list[str]) -> list[str]:
        """The pieces to be computed, which the caller then puts into ``place``; this may forget all others."""
        if len(self.place) > CACHE_PIECES or self.chars > CACHE_CHARS:
            self.place.clear()
            self.chars = 0
        new = [p for p in dict.fromkeys(wanted) if p not in self.place]
        self.chars += sum(map(len, new))
        return new

    def look_up(self, wanted: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, wanted), np.int64, len(wanted))


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per document: ``id_col``, ``ids`` (array of int, if asked for), ``n_tokens``,
    ``ids_sha256`` (over little-endian unsigned 32-bit ids) and ``decoded_sha256`` (over the
    bytes that decoding the ids gives back)."""
    raw = docs.sparkSession.sparkContext.broadcast(vocabulary)  # about 1 MB, whatever the corpus
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, memory = _rank_encoder(raw.value, pattern), _Pieces()
        start, size, flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        for batch in batches:
            for first, texts in _slices(batch):
                by_doc = [enc.pattern.findall(t) for t in texts]
                wanted = [p for doc in by_doc for p in doc]
                new = memory.miss(wanted)
                if not memory.place:
                    start, size, flat = start[:0], size[:0], flat[:0]
                if new:
                    found = enc.encode_pieces([p.encode("utf-8") for p in new])
                    more = np.array([len(x) for x in found], np.int64)
                    memory.place.update(zip(new, range(len(size), len(size) + len(new))))
                    start = np.concatenate([start, len(flat) + np.cumsum(more) - more])
                    size = np.concatenate([size, more])
                    flat = np.concatenate([flat, np.concatenate(found).astype(np.uint32)])
                at = memory.look_up(wanted)
                tokens = flat[_ragged(start[at], size[at])]
                ends = np.r_[0, np.cumsum(size[at])][np.cumsum([len(d) for d in by_doc])]
                begins = np.r_[0, ends[:-1]]
                rows = [tokens[a:b] for a, b in zip(begins, ends)]
                columns = [batch.column("id").slice(first, len(texts))]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(tokens.astype(np.int32))))
                columns += [
                    pa.array(ends - begins, pa.int64()),
                    pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string()),
                    pa.array([hashlib.sha256(enc.decode(r.astype(np.int64))).hexdigest() for r in rows], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", *["ids"] * ids, "n_tokens", "ids_sha256", "decoded_sha256"]
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + "ids array<int>, " * ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", out: str = "text") -> DataFrame:
    """The texts that arrays of ids stand for; a null array gives an empty text."""
    raw = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source = docs.select(F.col(id_col), F.col(ids_col)).toDF("id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _rank_encoder(raw.value, pattern)
        for batch in batches:
            texts = [enc.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, text string").toDF(id_col, out)


def count(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per document: ``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    raw = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, memory, known = _merge_counter(raw.value, pattern), _Pieces(), np.zeros(0, np.int64)
        for batch in batches:
            for first, texts in _slices(batch):
                split = [counter.pieces(t) for t in texts]
                wanted = [p for pieces, _ in split for p in pieces]
                new = memory.miss(wanted)
                if not memory.place:
                    known = known[:0]
                if new:
                    memory.place.update(zip(new, range(len(known), len(known) + len(new))))
                    known = np.concatenate([known, counter.count_pieces([p.encode("utf-8") for p in new])])
                sums = np.r_[0, np.cumsum(known[memory.look_up(wanted)])]
                ends = sums[np.cumsum([len(p) for p, _ in split])]
                n = np.diff(np.r_[0, ends]) + np.array([s for _, s in split])
                size = [len(t.encode("utf-8")) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, len(texts)), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
