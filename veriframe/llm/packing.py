"""Packing (13): cost-balanced sequences of a fixed number of tokens.

A document is its ids and an end id. Whole runs of ``sequence`` ids are sequences of their own;
what is left of each document goes to a pool. When the pool holds ``BLOCK`` sequences' worth, its
pieces are dealt in descending order, each to the sequence of lowest cost that still has room for
it, where a piece of n ids costs ``linear * n + quadratic * n * n`` (the projections of a layer,
and attention inside the piece). A piece that fits nowhere is cut: it fills the cheapest sequence
with any room, and its rest is dealt in its turn. The block has exactly as many sequences as it
can fill; ids left over (less than one sequence) wait in the pool, and at the end of a partition
they fill sequences of powers of two. So every sequence is full, at ``sequence`` or at a power of
two, and nothing is padded.

Texts are read once and nothing is shuffled: a block is packed in the task that encoded it, whose
memory holds one block and one slice of texts. A sequence's number is that of its partition and a
count, so a task that runs again on the same split gives the same rows.

A null text counts as empty: such a document is its end id alone. Rows are packed one by one, so a
repeated id or row gives pieces for each of its rows; an id may be null. Of the input only the two
named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm import chunks
from veriframe.llm.chunks import slices

#: Sequences dealt at once, and the cost of an id and of a pair of ids in a piece: a layer of width
#: h spends 24 h h on an id and 4 h on a pair, which is 1 to 1 / 6h; h is 1024 here.
BLOCK, LINEAR, QUADRATIC = 256, 1.0, 1 / 6144


def balance(lengths: list[int], rooms: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Deals pieces to sequences; gives placed (piece, from, length, sequence) and rests (piece, from, length)."""
    pieces = [(-n, k, 0) for k, n in enumerate(lengths) if n]
    heapq.heapify(pieces)
    room = list(rooms)
    open_ = [(0.0, s) for s, r in enumerate(room) if r]  # sequences by cost
    heapq.heapify(open_)
    tight: list[tuple[int, float, int]] = []  # sequences that had too little room, by room
    placed = []
    while pieces:
        minus, k, at = heapq.heappop(pieces)
        n = -minus
        while tight and -tight[0][0] >= n:
            _, cost, s = heapq.heappop(tight)
            heapq.heappush(open_, (cost, s))
        while open_ and room[open_[0][1]] < n:
            cost, s = heapq.heappop(open_)
            heapq.heappush(tight, (-room[s], cost, s))
        if open_:
            cost, s = heapq.heappop(open_)
            take = n
        elif tight:  # nowhere whole: fill the cheapest
            where = min(range(len(tight)), key=lambda i: tight[i][1:])
            _, cost, s = tight[where]
            tight[where] = tight[-1]
            tight.pop()
            heapq.heapify(tight)
            take = room[s]
            heapq.heappush(pieces, (take - n, k, at + take))
        else:
            pieces.append((minus, k, at))
            break
        placed.append((k, at, take, s))
        room[s] -= take
        if room[s]:
            heapq.heappush(open_, (cost + take * linear + take * take * quadratic, s))
    return placed, sorted((k, at, -minus) for minus, k, at in pieces)


def powers(n: int) -> list[int]:
    """The powers of two that sum to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Packer:
    """The pool of one task: [document's id, its ids, first of them, their number]."""

    def __init__(self, sequence: int, linear: float, quadratic: float, first: int) -> None:
        self.sequence, self.costs, self.next = sequence, (linear, quadratic), first
        self.pool: list[tuple[object, np.ndarray, int, int]] = []
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) // self.sequence * self.sequence
        for at in range(0, whole, self.sequence):
            self._emit(doc_id, ids, at, self.sequence, self.next, 0)
            self.next += 1
        if whole < len(ids):
            self.pool.append((doc_id, ids, whole, len(ids) - whole))
            self.held += len(ids) - whole
        if self.held >= BLOCK * self.sequence:
            self._deal([self.sequence] * (self.held // self.sequence))

    def close(self) -> None:
        n, rest = divmod(self.held, self.sequence)
        self._deal([self.sequence] * n + powers(rest))

    def _deal(self, rooms: list[int]) -> None:
        placed, rests = balance([p[3] for p in self.pool], rooms, *self.costs)
        used = [0] * len(rooms)
        for k, at, n, s in placed:
            doc_id, ids, first, _ = self.pool[k]
            self._emit(doc_id, ids, first + at, n, self.next + s, used[s])
            used[s] += n
        self.next += len(rooms)
        self.pool = [(self.pool[k][0], self.pool[k][1], self.pool[k][2] + at, n) for k, at, n in rests]
        self.held = sum(p[3] for p in self.pool)

    def _emit(self, doc_id, ids: np.ndarray, at: int, n: int, sequence: int, offset: int) -> None:
        part = ids[at : at + n]
        self.rows.append((doc_id, at, n, zlib.crc32(part), len(ids), sequence, offset, part))


def pack(docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", sequence: int = 2048, end_id: int = 1,
         linear: float = LINEAR, quadratic: float = QUADRATIC, ids: bool = True) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32`` (over little-endian
    unsigned 32-bit ids), ``doc_tokens``, ``sequence_id``, ``offset`` and, if asked for, ``ids``."""
    raw = docs.sparkSession.sparkContext.broadcast(vocabulary)  # about 1 MB, whatever the corpus
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).toDF("id", "text")
    kind = source.schema["id"].dataType.simpleString()
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 8
        arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
        if ids:
            ends = np.cumsum([0, *columns[2]]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint32), *columns[7]]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        return pa.RecordBatch.from_arrays(arrays, names=["id", *longs, *["ids"] * ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, tokens, cuts = chunks.byte_level(raw.value, special_as_text=False)
        length = np.array([len(t) for t in tokens])
        memory, known = chunks.Memory(), chunks.Ragged(np.dtype("<u4"))
        packer = _Packer(sequence, linear, quadratic, TaskContext.get().partitionId() << 36)
        id_type = None

        def learn(new: list, forgotten: bool) -> None:
            if forgotten:
                known.clear()
            strings = [chunks.string(key) for key in new]
            known.extend(*chunks.ids_of(strings, lambda parts: chunks.byte_level_ids(tokenizer, parts), length))

        for batch in batches:
            id_type = batch.column("id").type
            for first, texts in slices(batch):
                by_doc = [(chunks.keys(t) if cuts else [(t,)]) for t in texts]
                at = memory.look_up([key for doc in by_doc for key in doc], learn)
                flat = known.rows(at)
                ends = np.r_[0, np.cumsum(known.size[at])][np.cumsum([0, *map(len, by_doc)])]
                for k, doc_id in enumerate(batch.column("id").slice(first, len(texts)).to_pylist()):
                    packer.add(doc_id, np.append(flat[ends[k] : ends[k + 1]], np.array([end_id], flat.dtype)))
                if packer.rows:
                    yield batch_of(packer.rows, id_type)
                    packer.rows = []
        packer.close()
        if packer.rows:
            yield batch_of(packer.rows, id_type)

    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in longs) + ", ids array<int>" * ids
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
