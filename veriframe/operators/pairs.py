"""Equi-joins whose result is as large as both sides of a key multiplied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that meet as many of the other side in one piece of work.
BLOCK = 2048


def all_pairs(left: DataFrame, right: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """The inner equi-join on ``keys``, dealt by pieces of a key: the rows of a key are cut into
    blocks on both sides by a hash of the row, and a task joins pairs of blocks. No task holds more
    than a block or makes all the rows of a common key; none of the result is shuffled. ``left`` and
    ``right`` share no columns but the keys and are read twice: ``stored`` if they are costly."""
    n = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = n(left.dropna(subset=keys), "_nl").join(n(right, "_nr"), keys)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*df.columns), F.col(f"_n{own}")).cast("int").alias(f"_{own}")
        every = F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1)).alias(f"_{other}")
        out = df.join(sizes, keys).select(*df.columns, mine, every)
        # a given number of parts: by their bytes the two sides would be put together in a few tasks
        return out.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_l", "_r")

    return dealt(left, "l", "r").join(dealt(right, "r", "l").hint("merge"), [*keys, "_l", "_r"]).drop("_l", "_r")
