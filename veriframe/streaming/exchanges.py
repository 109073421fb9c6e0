"""Streaming twins of operators whose meaning does not depend on the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exchange_sessions(messages: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Exchanges of a thread as session windows: batch or stream (thread_id, ts).

    A message exactly ``gap`` after the last still joins its session, as in the batch operator;
    a microsecond more starts a new one. Rows without
    a time have no place in a stream of times and are left to the batch operator.
    """
    rows = messages.filter("ts IS NOT NULL")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    spans = rows.groupBy("thread_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return spans.select("thread_id", "n", "first_ts", "last_ts")


def run_to_table(stream: DataFrame, sessions, path: str) -> DataFrame:
    """Runs ``sessions`` over what a stream of rows (thread_id, ts) holds now and reads its result.

    Finished sessions are appended as the watermark passes them and their state is dropped. What is
    still open when the stream has no more rows is closed from the rows behind the last mark: they
    are kept beside the result by the same stream, and only those of open sessions are read again.
    """
    spark = stream.sparkSession
    kept = sessions(stream)
    run = lambda out, name, mode: (
        out.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}_state").trigger(availableNow=True).start().awaitTermination()
    )
    run(kept, "closed", "append")
    run(stream, "rows", "append")
    closed = spark.read.schema(kept.schema).parquet(f"{path}/closed")
    rows = spark.read.schema(stream.schema).parquet(f"{path}/rows")
    # a thread's open session begins after its last closed one
    last = closed.groupBy("thread_id").agg(F.max("last_ts").alias("done"))
    still = rows.join(last, "thread_id", "left").filter("done IS NULL OR ts > done").select(*stream.columns)
    return closed.unionByName(sessions(still))
