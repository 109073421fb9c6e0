"""Substring dedup (10): repeated word sequences, by prefix-partitioned suffix trees.

A suffix is a word position and the words that follow it. ``prefix_table`` counts, over the
whole corpus, how many suffixes begin with each prefix of 1, 2 and 4 words (in hashed bins, so
the table has a fixed size). A suffix belongs to the group of its shortest prefix that is not
too frequent, at the last by all of its ``window`` words: frequent prefixes are thereby split
further and further until every group fits in memory. A group's subtree is held as its sorted
path hashes at depth ``window``; a path that two documents share is a deep internal node, and
the runs of such nodes along a document are its maximal repeats.

What keeps it bounded: a slice of texts (a few MB) first resolves its own repeats and sends on
only one entry for each path, that of its smallest document, so a passage that a third of all
documents hold reaches its group once per slice and not once per document. Entries travel
packed, 8 bytes each and the ids of their documents once. The number of groups follows from the
counted suffixes: ``GROUP`` of them each. Groups answer with the paths that a document loses, and
the documents meet these in one join.

``doc_id`` orders the documents: a word goes if a window over it also starts in a document
with a smaller id. Documents with equal ids never remove each other's words; null ids count as
equal to each other and as the largest id there can be, and such documents are told apart by a
hash of their text. Null and empty texts have no words and the digest of the empty string.
Only the id and the text are read, so other columns cannot clash. Hashes have 64 bits: two
different windows are taken for equal with a chance of 1 in 2**64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.wordhash import SLICE_BYTES, Words, mix, slices

WINDOW = 13
#: Lengths of the counted prefixes, bins for each, and how many times the mean group a group may be.
DEPTHS, BINS, HEAVY = (1, 2, 4), 1 << 14, 4
#: Suffixes of a group: about 60 bytes each while it is worked on.
GROUP = 1 << 21

_LAST = np.iinfo(np.int64).max


def _bin(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 14)).astype(np.int64)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and key: the id, or a hash of the text where it is null."""
    text = F.col(text_col).cast("string")
    doc_id = F.col(id_col).cast("long")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.xxhash64(text)).alias("key"))


def prefix_table(docs: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> np.ndarray:
    """Suffixes of the whole corpus by (prefix length, bin); the array has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(DEPTHS), BINS), np.int64)
        for batch in batches:
            for _, _, data, at in slices(batch, size=slice_bytes):
                words = Words(data, at)
                begins = words.windows(window)[0]
                for k, depth in enumerate(DEPTHS):
                    total[k] += np.bincount(_bin(words.prefix(begins, depth)), minlength=BINS)
        level, bins = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(bins), pa.array(total[level, bins])], names=["level", "bin", "n"])

    counted = docs.select("text").mapInArrow(run, "level long, bin long, n long").groupBy("level", "bin").agg(F.sum("n").alias("n"))
    table = np.zeros((len(DEPTHS), BINS), np.int64)
    for r in counted.collect():  # at most DEPTHS x BINS rows, whatever the corpus
        table[r.level, r.bin] = r.n
    return table


class Docs:
    """The documents of some rows: ``key``, whether the id is ``null``, and ``order`` among ids."""

    def __init__(self, key: np.ndarray, null: np.ndarray):
        self.key, self.null = key, null
        self.order = np.where(null, _LAST, key)

    @classmethod
    def of(cls, batch: pa.RecordBatch, first: int, n: int) -> Docs:
        return cls(np.array(batch.column("key").slice(first, n), np.int64), np.array(batch.column("doc_id").slice(first, n).is_null(), bool))

    def take(self, at: np.ndarray) -> Docs:
        return Docs(self.key[at], self.null[at])


def _pack(path: np.ndarray, docs: Docs) -> bytes:
    """Entries in the order of their documents: number of documents, keys, which ids are null, how
    many paths each, the paths."""
    first = np.flatnonzero(np.r_[True, (docs.key[1:] != docs.key[:-1]) | (docs.null[1:] != docs.null[:-1])])
    size = np.diff(np.r_[first, len(path)])
    mine = docs.take(first)
    return b"".join([
        np.array([len(first)], "<i8").tobytes(), mine.key.astype("<i8").tobytes(), mine.null.astype("u1").tobytes(), size.astype("<u4").tobytes(), path.astype("<u8").tobytes()
    ])


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, Docs]:
    paths, keys, nulls = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for blob in blobs:
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        size = np.frombuffer(blob, "<u4", n, 8 + 9 * n)
        keys.append(np.repeat(np.frombuffer(blob, "<i8", n, 8), size))
        nulls.append(np.repeat(np.frombuffer(blob, "u1", n, 8 + 8 * n).astype(bool), size))
        paths.append(np.frombuffer(blob, "<u8", -1, 8 + 13 * n))
    return np.concatenate(paths), Docs(np.concatenate(keys), np.concatenate(nulls))


_ROWS = pa.schema([("part", pa.int32()), ("lost", pa.bool_()), ("data", pa.binary())])
_DDL = "part int, lost boolean, data binary"


def _rows(part: np.ndarray, lost: bool, path: np.ndarray, who: np.ndarray, docs: Docs) -> pa.RecordBatch:
    """Entries (path, document ``who`` of ``docs``) packed by part, one row each; ``lost`` ones are
    answers, whose part is their document's."""
    order = np.argsort(part.astype(np.int64) << 32 | who)
    part, path, docs = part[order], path[order], docs.take(who[order])
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    blobs = [_pack(path[a:b], docs.take(slice(a, b))) for a, b in zip(cuts, np.r_[cuts[1:], len(part)])]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array(np.full(len(cuts), lost)), pa.array(blobs, pa.binary())], schema=_ROWS)


def _lost(path: np.ndarray, who: np.ndarray, docs: Docs, groups: int) -> pa.RecordBatch:
    part = (mix(docs.key.astype(np.uint64)) % np.uint64(groups)).astype(np.int32)
    return _rows(part[who], True, path, who, docs)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document that loses words: its key and its lost paths."""
    path, docs = _unpack([blob for batch in batches for blob in batch.column("data").to_pylist()])
    if not len(path):
        return
    order = np.lexsort((docs.key, docs.null))
    path, docs = path[order], docs.take(order)
    first = np.flatnonzero(np.r_[True, (docs.key[1:] != docs.key[:-1]) | (docs.null[1:] != docs.null[:-1])])
    lost = [path[a:b].tobytes() for a, b in zip(first, np.r_[first[1:], len(path)])]
    for lo in range(0, len(first), 5000):
        at = first[lo : lo + 5000]
        yield pa.RecordBatch.from_arrays([pa.array(docs.key[at]), pa.array(docs.null[at]), pa.array(lost[lo : lo + 5000], pa.binary())], names=["loser", "nameless", "lost"])


def _nodes(path: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted paths: the node of each entry, and the place of each node's smallest document."""
    first = np.r_[True, path[1:] != path[:-1]]
    return np.cumsum(first) - 1, np.minimum.reduceat(order, np.flatnonzero(first))


def _suffixes(docs: DataFrame, table: np.ndarray, window: int, groups: int, slice_bytes: int) -> DataFrame:
    """Packed entries by group, and paths lost inside a slice."""
    heavy = table > max(1, table[0].sum() // groups) * HEAVY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, data, at in slices(batch, size=slice_bytes):
                words, docs = Words(data, at), Docs.of(batch, row, n)
                begins, path = words.windows(window)
                if not len(begins):
                    continue
                doc = words.doc[begins]
                order = np.argsort(path)
                begins, path, doc = begins[order], path[order], doc[order]
                node, least = _nodes(path, docs.order[doc])
                late = docs.order[doc] > least[node]
                if late.any():
                    yield _lost(path[late], doc[late], docs, groups)
                only = np.flatnonzero(~late)
                only = only[np.r_[True, node[only][1:] != node[only][:-1]]]
                begins, path, doc = begins[only], path[only], doc[only]
                group = path.copy()
                deeper = np.ones(len(path), bool)
                for k, depth in enumerate(DEPTHS):  # the shortest prefix that is not too frequent
                    h = words.prefix(begins[deeper], depth)
                    light = ~heavy[k][_bin(h)]
                    where = np.flatnonzero(deeper)[light]
                    group[where] = mix(_bin(h[light]).astype(np.uint64) + np.uint64((k + 1) << 32))
                    deeper[where] = False
                yield _rows((mix(group) % np.uint64(groups)).astype(np.int32), False, path, doc, docs)

    return docs.mapInArrow(run, _DDL)


def _subtrees(groups: int):
    """The deep internal nodes of the groups of one partition, as the paths that documents lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            answers = batch.filter(batch.column("lost"))
            if answers.num_rows:
                yield answers
            blobs += batch.filter(pyarrow.compute.invert(batch.column("lost"))).column("data").to_pylist()
        path, docs = _unpack(blobs)
        blobs.clear()
        order = np.argsort(path)
        path = path[order]
        same = path[1:] == path[:-1]
        inner = np.flatnonzero(np.r_[False, same] | np.r_[same, False])[: len(path)]  # nodes with two leaves or more
        if not len(path) or not len(inner):
            return
        path, docs = path[inner], docs.take(order[inner])
        node, least = _nodes(path, docs.order)
        late = docs.order > least[node]
        if late.any():
            path, docs = path[late], docs.take(late)
            order = np.lexsort((docs.key, docs.null))
            yield _lost(path[order], np.arange(len(path)), docs.take(order), groups)

    return run


def _removed(words: Words, lost: list[bytes | None], window: int) -> np.ndarray:
    """Which words stand under a lost path of their document."""
    begins, path = words.windows(window)
    bounds = np.searchsorted(words.doc[begins], np.arange(len(lost) + 1))
    gone = np.zeros(len(words.hash) + 1, np.int64)
    for a, b, mine in zip(bounds[:-1], bounds[1:], lost):
        if mine is not None:
            at = begins[a:b][np.isin(path[a:b], np.frombuffer(mine, "<u8"))]
            gone[at] += 1
            gone[at + window] -= 1
    return np.cumsum(gone)[:-1] > 0


def _cleaner(window: int, slice_bytes: int):
    """Counts, digest and, where words go, text of every document without the words it loses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, data, at in slices(batch, size=slice_bytes):
                lost = batch.column("lost").slice(row, n).to_pylist()
                raw = data.tobytes()
                parts = [raw[a:b].split() for a, b in zip(at[:-1], at[1:])]
                size = [len(p) for p in parts]
                losers = np.flatnonzero([x is not None for x in lost])
                if len(losers):  # only their words are hashed again
                    span = at[losers + 1] - at[losers]
                    data = np.concatenate([data[at[k] : at[k + 1]] for k in losers])
                    removed = _removed(Words(data, np.r_[0, np.cumsum(span)]), [lost[k] for k in losers], window)
                    ends = np.r_[0, np.cumsum([size[k] for k in losers])]
                    for k, a, b in zip(losers, ends[:-1], ends[1:]):
                        parts[k] = list(compress(parts[k], ~removed[a:b]))
                kept = [b" ".join(p) for p in parts]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(row, n), pa.array(size, pa.int64()), pa.array([s - len(p) for s, p in zip(size, parts)], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                    pa.array([None if mine is None else x.decode("utf-8") for x, mine in zip(kept, lost)], pa.string()),
                ], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
           groups: int | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_sha256`` (over the kept
    words joined by one space) and ``kept_text``, null where nothing was removed."""
    source = _source(docs, id_col, text_col)
    table = prefix_table(source, window, slice_bytes)
    groups = groups or max(1, -(-int(table[0].sum()) // GROUP))
    answers = (
        _suffixes(source, table, window, groups, slice_bytes)
        .repartitionById(groups, F.col("part"))
        .mapInArrow(_subtrees(groups), _DDL)
    )
    lost = answers.select("part", "data").repartitionById(groups, F.col("part")).mapInArrow(_gather, "loser long, nameless boolean, lost binary")
    met = source.join(lost, (F.col("key") == F.col("loser")) & (F.col("doc_id").isNull() == F.col("nameless")), "left")
    cleaned = met.select("doc_id", "text", "lost").mapInArrow(
        _cleaner(window, slice_bytes), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
    return cleaned.withColumnRenamed("doc_id", id_col)


ORACLE = rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW}),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS least FROM g),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM m, range(0, {WINDOW}) AS o(k) WHERE least < doc_id),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept, count(*) AS n
      FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i WHERE gone.i IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
