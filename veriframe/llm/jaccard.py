"""N-gram Jaccard join (3): a MinHash LSH forest of prefix tries, then exact verification.

Texts are sets of five-word shingles (words as they stand; a text of one to four words is a
single shingle of all its words; a text without words links to nothing). Texts of the same
word sequence are one text by digest, so that exact copies never enter the search; only one
representative of each does.

A text has ``TREES`` signatures of min-hashes, and each tree is the trie of its signatures: a
node is a prefix, named by the hash of its path, and texts under one node are candidates. The
search begins at the longest prefixes (``DEEPEST`` min-hashes) and verifies all candidates by the
exact Jaccard coefficient. A pair of similarity s meets under prefixes of d min-hashes in some
tree with probability 1 - (1 - s**d)**TREES, so the links found tell how many there are: each
counts for one over its probability. While the links found are less than the target recall of
that estimate, or none is found, prefixes are shortened by one min-hash and the pairs that did
not meet before are verified, down to the length at which even a pair at the threshold meets
with the target recall.

Every candidate pair is verified once, also inside a class, and no node has a cap. Nodes of at
most ``SMALL`` texts list their pairs, which are made distinct. Under larger nodes blocks of
texts meet blocks of texts: a task holds two blocks and compares their shingle sets by a sorted
list. There the first tree whose large node holds both texts owns a pair; other trees and the
small nodes leave it out. A task answers with the number of links of each of its texts and a
spanning forest of them, so that the rows grow with the texts of a node and not with its pairs.
``n_links`` is the number of all links of a text to other texts, ``n_copies`` that of other rows
of the same text; ``Join.links`` lists the links when it is read.

Rows are known by their id and a hash of their text, so different texts under one id are judged
apart; rows equal in both are one. Ids order the documents and name the classes by the smallest;
a null id comes last, and a class of null ids only has a null name. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import cut, shared_dir
from veriframe.llm.components import components
from veriframe.llm.wordhash import Words, mix, slices

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
TREES, DEEPEST = 16, 6
#: Texts in a block; texts under a node that lists its pairs.
BLOCK, SMALL = 512, 16
#: Shingles of texts that a verifying task remembers.
MEMORY = 2_000_000


def meets(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that two texts share a prefix of ``depth`` min-hashes in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depths(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST) -> list[int]:
    """Prefix lengths from the deepest to the one that reaches the target recall at the threshold."""
    enough = [d for d in range(1, deepest + 1) if meets(threshold, d, trees) >= recall]
    if not enough:
        raise ValueError("no prefix reaches the recall; take more trees")
    return list(range(deepest, max(enough) - 1, -1))


def _sketches(docs: DataFrame, levels: list[int], shingle: int, trees: int) -> DataFrame:
    """id, tag, digest of the word sequence (null without words), and for each level the node of each tree."""
    deepest = levels[0]
    seeds = mix(np.arange(1, trees * deepest + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(99))
    factors = mix(seeds + np.uint64(5)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, data, at in slices(batch):
                words = Words(data, at)
                begins, h = words.windows(shingle)
                keys = np.zeros((n, len(levels) * trees), np.int64)
                doc = words.doc[begins]
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
                owner = doc[first]
                if len(owner):
                    for t in range(trees):
                        node = np.full(len(owner), t, np.uint64)
                        for d in range(deepest):
                            k = t * deepest + d
                            node = mix(node * np.uint64(31) + np.minimum.reduceat((h ^ seeds[k]) * factors[k], first))
                            if d + 1 in levels:
                                keys[owner, levels.index(d + 1) * trees + t] = node.view(np.int64)
                has = np.zeros(n, bool)
                has[owner] = True
                raw = data.tobytes()
                parts = [raw[a:b].split() for a, b in zip(at[:-1], at[1:])]
                digests = [hashlib.md5(b" ".join(p)).digest() if p else None for p in parts]
                at_keys = np.r_[0, np.cumsum(has * keys.shape[1])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at_keys), pa.array(keys[has].ravel()), mask=pa.array(~has))
                columns = [batch.column("doc_id").slice(row, n), batch.column("tag").slice(row, n), pa.array(digests, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "digest", "nodes"])

    return docs.mapInArrow(run, "doc_id long, tag long, digest binary, nodes array<long>")


def _shingles(text: str, shingle: int) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    return np.unique(Words(data, np.array([0, len(data)])).windows(shingle)[1])


def _verifier(shingle: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[int, np.ndarray] = {}  # texts come again in other pairs
        held = 0
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found = []
            for k, (x, y) in enumerate(zip(a, b)):
                if held > MEMORY:
                    memory.clear()
                    held = 0
                for i, name in ((x, "text_a"), (y, "text_b")):
                    if i not in memory:
                        memory[i] = _shingles(batch.column(name)[k].as_py(), shingle)
                        held += len(memory[i])
                one, two = memory[x], memory[y]
                both = np.intersect1d(one, two, assume_unique=True).size
                found.append(both / (len(one) + len(two) - both))
            keep = np.array(found, float) >= threshold
            columns = [np.array(a, np.int64)[keep], np.array(b, np.int64)[keep], np.array(found, float)[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "similarity"])

    return run


def _block_pairs(rows: pd.DataFrame, shingle: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the rows, and (row, row, similarity) of the links that this tree owns.

    Pairs that share a longer prefix are known already.
    """
    lo, hi, tree = (int(rows[c].iloc[0]) for c in ("lo", "hi", "tree"))
    ids, spot = rows["id"].to_numpy(), rows["spot"].to_numpy()
    nodes, deeper = (np.array(rows[c].tolist(), np.int64) for c in ("big", "deeper"))
    one, two = np.flatnonzero(spot == lo), np.flatnonzero(spot == hi)
    mine = np.ones((len(one), len(two)), bool) if lo != hi else ids[one][:, None] < ids[two][None, :]
    for t in range(tree):
        mine &= (nodes[one, t][:, None] != nodes[two, t][None, :]) | (nodes[one, t] == 0)[:, None]
    for t in range(deeper.shape[1]):
        mine &= deeper[one, t][:, None] != deeper[two, t][None, :]
    need = np.unique(np.r_[one[mine.any(1)], two[mine.any(0)]])
    sets = {k: _shingles(t, shingle) for k, t in zip(need, rows["text"].to_numpy()[need])}
    targets = np.flatnonzero(mine.any(0))
    size = np.zeros(len(two), np.int64)
    size[targets] = [len(sets[two[k]]) for k in targets]
    flat = np.concatenate([sets[two[k]] for k in targets]) if len(targets) else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(targets, size[targets])[order]
    a, b, like = [], [], []
    for i in np.flatnonzero(mine.any(1)):
        own = sets[one[i]]
        begin, end = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
        n = end - begin
        at = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(two))
        share = both / np.maximum(size + len(own) - both, 1)
        hit = np.flatnonzero((share >= threshold) & mine[i])
        a.append(np.full(len(hit), one[i]))
        b.append(two[hit])
        like.append(share[hit])
    none = [np.zeros(0, np.int64)]
    return ids, np.concatenate(a or none), np.concatenate(b or none), np.concatenate(like or [np.zeros(0)])


def _block_lister(shingle: int, threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Every link of two blocks."""
        ids, a, b, like = _block_pairs(rows, shingle, threshold)
        return pd.DataFrame({"a": ids[a], "b": ids[b], "similarity": like})

    return run


def _block_counter(shingle: int, threshold: float, levels: list[int], trees: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The number of links of each text in two blocks, a text of its component there, and the
        links it stands for at each level."""
        ids, a, b, like = _block_pairs(rows, shingle, threshold)
        both = np.r_[a, b]
        n = np.bincount(both, minlength=len(ids))
        stand = np.stack([np.bincount(both, np.tile(1 / meets(like, d, trees), 2), len(ids)) for d in levels], axis=1)
        root = np.arange(len(ids))
        while True:
            least, last = np.minimum(root[a], root[b]), root
            root = root.copy()
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            root = root[root]
            if (root == last).all():
                break
        has = n > 0
        return pd.DataFrame({"a": ids[has], "b": ids[root[has]], "n": n[has], "stand": pd.Series(list(stand[has]), dtype=object)})

    return run


class Join:
    """The result of :func:`join`: ``membership`` (id, tag, class_id, text_id, n_links, n_copies,
    first) and ``links`` (a, b, similarity), every link between texts once.

    ``tag`` is ``xxhash64`` of the row's text. ``class_id`` and ``text_id`` are the smallest ids of
    the class and of the rows with the same text; ``first`` marks the row that stands for its class.
    """

    def __init__(self, membership: DataFrame, links: DataFrame, levels: list[int]):
        self.membership, self.links, self.levels = membership, links, levels


def tag_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


class _Level:
    """Verified links of the pairs that meet at one level of the tries and not at the one above."""

    def __init__(self, texts: DataFrame, bodies: DataFrame, levels: list[int], at: int, shingle: int, threshold: float, trees: int):
        cut_out = lambda k: F.slice("nodes", k * trees + 1, trees)
        deeper = cut_out(at - 1) if at else F.array().cast("array<long>")
        rows = texts.select("id", F.posexplode(cut_out(at)).alias("tree", "node"))
        full = rows.groupBy("tree", "node").agg(F.count("*").alias("n")).filter("n > 1")
        rows = cut(rows.join(full, ["tree", "node"]))
        crowded = rows.filter(F.col("n") > SMALL)
        # the large nodes of a text, by tree; 0 where it has none
        node_of = [F.coalesce(F.max(F.when(F.col("tree") == t, F.col("node"))), F.lit(0)) for t in range(trees)]
        big = crowded.groupBy("id").agg(F.array(*node_of).alias("big"))
        none = F.array_repeat(F.lit(0).cast("long"), trees)
        met = texts.select("id", deeper.alias("deeper")).join(rows.select("id").distinct(), "id", "left_semi")
        met = cut(met.join(big, "id", "left").withColumn("big", F.coalesce("big", none)))

        below = lambda x: lambda y: F.struct(x.alias("a"), y.alias("b"))
        listed = rows.filter(F.col("n") <= SMALL).groupBy("tree", "node").agg(F.collect_set("id").alias("ids"))
        listed = listed.select(F.explode(F.flatten(F.transform("ids", lambda x: F.transform(F.filter("ids", lambda y: y < x), below(x))))).alias("p"))
        ends = [met.select(F.col("id").alias(c), F.col("big").alias(f"big_{c}"), F.col("deeper").alias(f"deeper_{c}")) for c in "ab"]
        alike = lambda x, y: F.exists(F.zip_with(x, y, lambda u, v: (u == v) & (u != 0)), lambda z: z)
        pairs = listed.select("p.*").distinct().join(ends[0], "a").join(ends[1], "b")
        pairs = pairs.filter(~alike("big_a", "big_b") & ~alike("deeper_a", "deeper_b")).select("a", "b")
        side = lambda c: bodies.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
        self.listed = cut(both.mapInArrow(_verifier(shingle, threshold), "a long, b long, similarity double"))

        # block against block under the large nodes
        n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        spot = F.pmod(F.xxhash64("id"), n_blocks).cast("int")
        held = crowded.select("tree", "node", "id", spot.alias("spot"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other"))
        held = held.select("tree", "node", "id", "spot", F.least("spot", "other").alias("lo"), F.greatest("spot", "other").alias("hi"))
        blocks = held.join(met.join(bodies, "id"), "id").groupBy("tree", "node", "lo", "hi")
        self.blocks = lambda: blocks.applyInPandas(_block_lister(shingle, threshold), "a long, b long, similarity double")
        counted = cut(blocks.applyInPandas(_block_counter(shingle, threshold, levels, trees), "a long, b long, n long, stand array<double>"))

        stands = F.array(*[1 / (1 - F.pow(1 - F.pow("similarity", F.lit(d)), F.lit(trees))) for d in levels])
        ones = self.listed.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("n"), stands.alias("stand"))
        self.counts = ones.unionByName(counted.select(F.col("a").alias("id"), "n", "stand"))
        self.edges = self.listed.select("a", "b").unionByName(counted.select("a", "b"))
        sums = self.counts.agg(F.sum("n"), *[F.sum(F.col("stand")[k]) for k in range(len(levels))]).first()
        self.found, self.estimates = sums[0] or 0, [x or 0.0 for x in sums[1:]]


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
         threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST) -> Join:
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), tag_of(text).alias("tag"), text.alias("text"))
    levels = depths(threshold, recall, trees, deepest)
    path = shared_dir(spark)
    _sketches(source, levels, shingle, trees).write.parquet(f"{path}/sketches")
    sketches = spark.read.parquet(f"{path}/sketches")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tag")
    texts = sketches.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min(row).alias("row"), F.any_value("nodes").alias("nodes"), F.count("*").alias("n_rows")
    )
    # numbered once and kept as a table: the numbers are the vertices of everything that follows
    texts.select("digest", "row", "nodes", "n_rows", F.monotonically_increasing_id().alias("id")).write.parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    searched = texts.filter("nodes IS NOT NULL")

    # the texts that share a node at the shortest prefix; all others have no candidates
    nodes = searched.select("id", F.posexplode(F.slice("nodes", (len(levels) - 1) * trees + 1, trees)).alias("tree", "node"))
    full = nodes.groupBy("tree", "node").agg(F.count("*").alias("n")).filter("n > 1")
    searched = cut(searched.join(nodes.join(full, ["tree", "node"]).select("id").distinct(), "id", "left_semi"))
    wanted = searched.select("id", F.col("row.doc_id").alias("want_id"), F.col("row.tag").alias("want_tag"))
    bodies = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("tag") == F.col("want_tag"))).select("id", "text")
    bodies.dropDuplicates(["id"]).write.parquet(f"{path}/bodies")
    bodies = spark.read.parquet(f"{path}/bodies")

    steps: list[_Level] = []
    for at in range(len(levels)):
        steps.append(_Level(searched, bodies, levels, at, shingle, threshold, trees))
        found = sum(s.found for s in steps)
        if found and found >= recall * sum(s.estimates[at] for s in steps):
            break

    every = lambda name: reduce(DataFrame.unionByName, [getattr(s, name) for s in steps])
    names = texts.select("id", F.col("row.doc_id").alias("name"))
    ends = [names.toDF(c, f"name_{c}") for c in "ab"]
    links = reduce(DataFrame.unionByName, [s.listed.unionByName(s.blocks()) for s in steps]).join(ends[0], "a").join(ends[1], "b")
    links = links.select(F.greatest("name_a", "name_b").alias("a"), F.least("name_a", "name_b").alias("b"), "similarity")

    labels = components(every("edges"))
    count = every("counts").groupBy("id").agg(F.sum("n").alias("n_links"))
    classes = texts.drop("nodes").join(labels, "id", "left").join(count, "id", "left").withColumn("label", F.coalesce("label", "id"))
    heads = classes.groupBy("label").agg(F.min("row").alias("head"))
    classes = classes.join(heads, "label").select("digest", "row", "head", "n_links", "n_rows")
    here = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tag")
    membership = sketches.drop("nodes").join(classes, "digest", "left").select(
        "doc_id", "tag",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("row.doc_id")).alias("text_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("n_rows") - 1, F.lit(0)).cast("long").alias("n_copies"),
        F.coalesce(here == F.col("head"), F.lit(True)).alias("first"),
    )
    return Join(membership.withColumnRenamed("doc_id", id_col), links, levels[: len(steps)])
