"""Hash chains, reconciliation and digests.

A chain is verified without walking it: each entry is compared with the one before it by an
equi-join on (log, position), so logs of any length spread over all tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the first entry of a log follows.
GENESIS = ""
FIELDS = ("at", "actor", "action", "payload")


#: Characters that JSON text escapes, in the order in which they are replaced.
_ESCAPES = {"\\": "\\\\", '"': '\\"'} | {c: json.dumps(c)[1:-1] for c in map(chr, range(32))}


def _json_text(c: Column) -> Column:
    """A text as JSON has it, by the rule of ``json.dumps``: only quotes, backslashes and control
    characters are escaped, these in lower-case digits where they have no letter. A null is null."""
    plain = c.cast("string")
    for char in ("\\", '"'):
        plain = F.replace(plain, F.lit(char), F.lit(_ESCAPES[char]))
    held = plain
    for char in map(chr, range(32)):
        held = F.replace(held, F.lit(char), F.lit(_ESCAPES[char]))
    return F.coalesce(F.concat(F.lit('"'), F.when(plain.rlike(r"[\x00-\x1f]"), held).otherwise(plain), F.lit('"')), F.lit("null"))


def json_digest(*fields: Column) -> Column:
    """SHA-256 over the JSON array of the fields as text, so that the bounds of the fields are part
    of it and a null is not an empty text."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *map(_json_text, fields)), F.lit("]")), 256)


def entry_hash(prev: Column, *fields: Column) -> Column:
    """The digest of the hash before and the entry's fields. A null field is an empty one."""
    return json_digest(*[F.coalesce(c.cast("string"), F.lit("")) for c in (prev, *fields)])


def build_chain(entries: DataFrame, log: str, order: str) -> DataFrame:
    """(log, seq, at, actor, action, payload, prev_hash, hash) of each log, in order of ``order``,
    then the fields; ``seq`` counts from 1. ``entries`` holds the four ``FIELDS`` as text.

    Each hash needs the one before it, so a log is one sorted pass of one task; only the last hash
    is carried, so a log of any length takes the same memory."""
    spark = entries.sparkSession
    rows = entries.select(F.col(log).alias("log"), F.col(order).alias("o"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FIELDS])
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "log").sortWithinPartitions("log", "o", *FIELDS)
    kind = entries.schema[log].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, prev = object(), 0, GENESIS
        for batch in batches:
            places, before, hashes = [], [], []
            for key, *fields in zip(*[batch.column(c).to_pylist() for c in ("log", *FIELDS)]):
                if key != now:
                    now, seq, prev = key, 0, GENESIS
                seq += 1
                places.append(seq)
                before.append(prev)
                prev = hashlib.sha256(json.dumps([prev, *fields], ensure_ascii=False).encode("utf-8")).hexdigest()  # as entry_hash
                hashes.append(prev)
            columns = [batch.column("log"), pa.array(places, pa.int32()), *[batch.column(c) for c in FIELDS], pa.array(before, pa.string()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["log", "seq", *FIELDS, "prev_hash", "hash"])

    chain = rows.select("log", *FIELDS).mapInArrow(run, f"log {kind}, seq int, " + "".join(f"{c} string, " for c in FIELDS) + "prev_hash string, hash string")
    return chain.withColumnRenamed("log", log)


def withhold(chain: DataFrame, condition: Column) -> DataFrame:
    """The chain with the fields of some entries left out; their hashes stay and link on."""
    return chain.withColumns({c: F.when(~condition, F.col(c)) for c in FIELDS})


def first_break(chain: DataFrame, log: str) -> DataFrame:
    """(log, n, n_withheld, first_break): the first place whose hash, link or number is wrong, null
    if none. An entry whose fields are all null is withheld: its hash cannot be made again, but
    its links hold."""
    before = chain.select(log, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("last_hash"))
    j = chain.join(before, [log, "seq"], "left")
    withheld = F.coalesce(*FIELDS).isNull()
    linked = F.col("prev_hash") == F.coalesce("last_hash", F.when(F.col("seq") == 1, GENESIS))
    made = withheld | (entry_hash(F.col("prev_hash"), *map(F.col, FIELDS)) == F.col("hash"))
    wrong = ~F.coalesce(linked & made, F.lit(False))
    return j.groupBy(log).agg(F.count("*").alias("n"), F.count_if(withheld).alias("n_withheld"), F.min(F.when(wrong, F.col("seq"))).alias("first_break"))


def heads(chain: DataFrame, log: str) -> DataFrame:
    """(log, n, head): the last hash of each log, which stands for all of it."""
    return chain.groupBy(log).agg(F.count("*").alias("n"), F.max_by("hash", "seq").alias("head"))


def lost_anchors(anchors: DataFrame, chain: DataFrame, log: str) -> DataFrame:
    """Recorded (log, seq, hash) that the log does not hold any more."""
    return anchors.select(log, "seq", "hash").join(chain.select(log, "seq", "hash"), [log, "seq", "hash"], "left_anti")


def status_at(events: DataFrame, key: str, value: str, seq: str, position: DataFrame) -> DataFrame:
    """As-of: the value of each key's last event at or before a log position.

    events: run, key, value, seq; position: run, position. A key without an event by then has none.
    """
    seen = events.join(position, "run").filter(F.col(seq) <= F.col("position"))
    return seen.groupBy("run", key).agg(F.max_by(value, seq).alias(value))


def changed_since(rows: DataFrame, digests: DataFrame, key: str) -> DataFrame:
    """Keys whose rows' digest is not the recorded one, with what happened: changed, gone, new."""
    j = rows.select(key, F.col("digest").alias("now")).join(digests.select(key, F.col("digest").alias("then")), key, "full")
    what = F.when(F.col("now").isNull(), "gone").when(F.col("then").isNull(), "new").when(F.col("now") != F.col("then"), "changed")
    return j.select(key, what.alias("change")).filter("change IS NOT NULL")


def compare_decisions(stored: DataFrame, derived: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, problem): decisions that, made again from their inputs, come out otherwise."""
    a = stored.select(key, *[F.col(f).alias(f"s_{f}") for f in fields], F.lit(True).alias("in_s"))
    b = derived.select(key, *[F.col(f).alias(f"d_{f}") for f in fields], F.lit(True).alias("in_d"))
    j = a.join(b, key, "full")
    first = F.coalesce(*[F.when(~F.col(f"s_{f}").eqNullSafe(F.col(f"d_{f}")), f"{f}_differs") for f in fields])
    problem = F.when(F.col("in_d").isNull(), "not_derived").when(F.col("in_s").isNull(), "not_stored").otherwise(first)
    return j.select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def export_plan(rows: DataFrame, scope: DataFrame, key: str, digest: Column) -> DataFrame:
    """Every row as it leaves: ``shipped`` with its scope, or withheld as its digest only."""
    marked = rows.join(scope.select(key).distinct().withColumn("shipped", F.lit(True)), key, "left")
    return marked.withColumn("shipped", F.coalesce("shipped", F.lit(False))).withColumn("stub", F.when(~F.col("shipped"), digest))


def reconcile(logged: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """(key, problem): decisions that only one side has, or that differ."""
    j = logged.select(key, F.col(value).alias("a"), F.lit(True).alias("in_a")).join(stored.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b")), key, "full")
    problem = F.when(F.col("in_b").isNull(), "not_stored").when(F.col("in_a").isNull(), "not_logged").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return j.select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def rows_digest(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """(by, n, digest): SHA-256 over the sorted hashes of a group's rows. The hashes are sorted by
    Spark and fed to the digest one by one, so a group of any size takes the same memory."""
    spark = rows.sparkSession
    h = json_digest(*[F.col(f) for f in fields])
    hashed = rows.select(F.col(by).alias("by"), h.alias("h"))
    hashed = hashed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "by").sortWithinPartitions("by", "h")
    kind = rows.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, state = None, 0, hashlib.sha256()
        for batch in batches:
            done = []
            for key, one in zip(batch.column("by").to_pylist(), batch.column("h").to_pylist()):
                if n and key != now:
                    done.append((now, n, state.hexdigest()))
                    n, state = 0, hashlib.sha256()
                now, n = key, n + 1
                state.update(one.encode("ascii"))
            yield _groups(done, batch.schema.field("by").type)
            last = batch.schema.field("by").type
        if n:
            yield _groups([(now, n, state.hexdigest())], last)

    return hashed.mapInArrow(run, f"by {kind}, n long, digest string").withColumnRenamed("by", by)


def _groups(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    keys, counts, digests = zip(*done) if done else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["by", "n", "digest"])


def dangling(rows: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose reference resolves nowhere."""
    return rows.filter(F.col(key).isNotNull()).join(other.select(F.col(other_key).alias(key)).distinct(), key, "left_anti")
