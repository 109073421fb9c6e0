"""Vector code compression (11): product codes with an equal-average search for the nearest entry.

A vector's components become integers floor(1024 x) and are cut into ``PARTS`` equal parts. Each
part position has a codebook that starts as that part of the vectors of the smallest ids and is
improved ``ROUNDS`` times: every part goes to its nearest entry, every entry becomes the floor of
the mean of its parts. The nearest entry is found among entries sorted by the sum of their
components: from where a part's own sum falls, the search moves outward on both sides, and a side
is closed when (gap of sums) squared, over the dimension, strictly exceeds the best distance, since
no entry beyond can then be as near. Equal distances go to the lower index.

The vectors are read once a round and never shuffled; tasks send sums and counts for each entry
(a bounded table), which are added up per entry and component, and the driver holds the codebooks
only: PARTS x ENTRIES x part components, whatever the number of vectors. Errors summed by label
are joined back over ``SALTS`` copies of the sums, so that a label that most vectors bear is
spread over as many tasks.

Rows whose vector is null, empty, or holds a null or a non-finite component are dropped. The
dimension is that of the first kept vector by id; vectors of another dimension are dropped too,
and one that does not divide by PARTS is filled with zeros at its end. Components are held within
+-2^30 / (part dimension), in 1/1024ths, so that every sum of squares fits in 64 bits. Null ids
come last in the order of ids, equal ids go by their vectors; every row gets its own code. With
fewer rows than entries the codebooks are shorter; an empty table gives no rows. Null labels count
as one label. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a vector, entries of a codebook, rounds of improvement, and copies of the labels' sums.
PARTS, ENTRIES, ROUNDS, SALTS = 4, 256, 4, 32

#: Parts searched at once by a task.
ROWS = 1 << 14


class Book:
    """One codebook, its entries sorted by the sum of their components."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums, self.entries = sums[self.order], entries[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance to it, for each row of ``parts``."""
        n, dimension = parts.shape
        own = parts.sum(axis=1)
        best = np.full(n, np.iinfo(np.int64).max // dimension)
        index = np.full(n, len(self.order))
        above = np.searchsorted(self.sums, own)  # the next place to look at, on either side
        below = above - 1
        for_above = for_below = np.arange(n)
        while len(for_above) or len(for_below):
            for_above = self._step(parts, own, best, index, above, for_above, dimension, 1)
            for_below = self._step(parts, own, best, index, below, for_below, dimension, -1)
        return index, best

    def _step(self, parts, own, best, index, at, rows, dimension: int, way: int) -> np.ndarray:
        """Looks at one more entry for ``rows``; gives the rows whose side is still open."""
        place = at[rows]
        inside = (place >= 0) & (place < len(self.order))
        rows, place = rows[inside], place[inside]
        gap = own[rows] - self.sums[place]
        near = gap * gap <= best[rows] * dimension
        rows, place = rows[near], place[near]
        difference = parts[rows] - self.entries[place]
        distance = np.einsum("ij,ij->i", difference, difference)
        entry = self.order[place]
        better = (distance < best[rows]) | (distance == best[rows]) & (entry < index[rows])
        won = rows[better]
        best[won], index[won] = distance[better], entry[better]
        at[rows] += way
        return rows


def _integers(column: pa.ListArray, dimension: int, parts: int) -> np.ndarray:
    """Rows of parts: the floors of 1024 x, held within their bound, filled up to whole parts."""
    values = np.asarray(column.flatten()).astype(np.float64).reshape(-1, dimension)
    width = -(-dimension // parts)
    bound = float((1 << 30) // width)
    whole = np.zeros((len(values), parts * width), np.int64)
    whole[:, :dimension] = np.clip(np.floor(values * 1024.0), -bound, bound)
    return whole.reshape(len(values), parts, width)


def _assign(books: list[Book], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, both by row and part."""
    codes = np.zeros(vectors.shape[:2], np.int64)
    errors = np.zeros(vectors.shape[:2], np.int64)
    for k, book in enumerate(books):
        for lo in range(0, len(vectors), ROWS):
            codes[lo : lo + ROWS, k], errors[lo : lo + ROWS, k] = book.nearest(np.ascontiguousarray(vectors[lo : lo + ROWS, k]))
    return codes, errors


def _kept(vectors: DataFrame, vector_col: str) -> DataFrame:
    x = F.col(vector_col)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.filter(x.isNotNull() & (F.size(x) > 0) & sound)


class Codes:
    """Fitted codebooks: ``books[k]`` is a (entries, part dimension) array."""

    def __init__(self, books: list[np.ndarray], dimension: int):
        self.books, self.dimension = books, dimension

    def digest(self) -> str:
        """SHA-256 of all components, by part, entry and position."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes | None:
    """The codebooks of a table of vectors; none for a table without a sound one."""
    rows = _kept(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")), "vector")
    order = (F.col("id").asc_nulls_last(), F.col("vector"))
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return None
    dimension = len(first[0].vector)
    rows = rows.filter(F.size("vector") == dimension)
    seeds = [r.vector for r in rows.orderBy(*order).limit(entries).collect()]  # at most ``entries`` rows
    start = _integers(pa.array(seeds, pa.list_(pa.float64())), dimension, parts)
    books = [start[:, k].copy() for k in range(parts)]
    width = start.shape[2]
    for _ in range(rounds):
        for part, entry, n, sums in _sums(rows.select("vector"), books, dimension, width):
            books[part][entry] = np.array(sums) // n  # floors, also below zero
    return Codes(books, dimension)


def _sums(rows: DataFrame, books: list[np.ndarray], dimension: int, width: int) -> list[tuple]:
    """(part, entry, count, component sums) of the entries that have parts."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # PARTS x ENTRIES x width numbers
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Book(b) for b in shared.value]
        size = len(shared.value[0])
        total, count = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            vectors = _integers(batch.column("vector"), dimension, parts)
            codes, _ = _assign(found, vectors)
            for k in range(parts):
                np.add.at(total[k], codes[:, k], vectors[:, k])
                count[k] += np.bincount(codes[:, k], minlength=size)
        part, entry = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"]
        )

    sent = rows.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    columns = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)]
    added = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns)
    return [(r.part, r.entry, r.n, list(r[3:])) for r in added.collect()]  # at most PARTS x ENTRIES rows


def encode(vectors: DataFrame, codes: Codes | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: ``id_col``, ``code`` (bytes in part order), ``error`` (squared
    distances summed over parts) and ``label_error`` (``error`` summed over equal labels)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = _kept(rows, "vector").filter(F.size("vector") == (codes.dimension if codes else 0))
    shared = spark.sparkContext.broadcast(codes)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Book(b) for b in shared.value.books] if shared.value else []
        for batch in batches:
            if not batch.num_rows:
                continue
            assigned, errors = _assign(found, _integers(batch.column("vector"), shared.value.dimension, len(found)))
            # a byte a part; larger codebooks take two
            raw = assigned.astype(np.uint8 if len(shared.value.books[0]) <= 256 else ">u2")
            code = pa.array([r.tobytes() for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), code, pa.array(errors.sum(axis=1))], names=["id", "label", "code", "error"])

    coded = rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code binary, error long")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    same = salted.label.eqNullSafe(spread.label) & (salted.salt == spread.salt)
    out = salted.join(spread, same).select(F.col("id").alias(id_col), salted.label.alias("label"), "code", "error", "label_error")
    return out.withColumnRenamed("label", label_col)


def oracle() -> str:
    """The same rows in SQL: every part against every entry, all rounds written out."""
    width = "len(v) // 4"
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * ({width}) + 1 : (part + 1) * ({width})] AS p FROM kept, range(4) t(part)),
b0 AS MATERIALIZED (
  SELECT part, entry, p AS e FROM parts
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 256) USING (vec_id))"""]
    for k in range(5):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, label, part, p, m.entry AS entry, m.d AS d FROM (
    SELECT vec_id, parts.part AS part, any_value(label) AS label, any_value(p) AS p,
      min(struct_pack(d := list_dot_product(p, p) + list_dot_product(e, e) - 2 * list_dot_product(p, e), entry := entry)) AS m
    FROM parts JOIN b{k} ON parts.part = b{k}.part GROUP BY vec_id, parts.part))""")
        if k < 4:
            steps.append(f"""
s{k} AS (
  SELECT part, entry, j, floor(sum(p[j]) / count(*)) AS c FROM a{k}, range(1, 1 + (SELECT max(len(p)) FROM parts)) t(j) GROUP BY part, entry, j),
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.e, b.e) AS e FROM b{k} b
  LEFT JOIN (SELECT part, entry, list(c ORDER BY j) AS e FROM s{k} GROUP BY part, entry) n ON n.part = b.part AND n.entry = b.entry)""")
    return "WITH " + ",".join(steps) + """,
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, j))
   FROM (SELECT part, entry, unnest(e) AS c, generate_subscripts(e, 1) AS j FROM b4)) AS codebooks_sha256
FROM coded"""
