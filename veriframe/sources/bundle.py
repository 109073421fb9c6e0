"""Bundles: tables as JSON lines with a manifest of digests, written and verified by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def digest(df: DataFrame) -> DataFrame:
    """(n, digest): an order-free digest of a table: count and sum of row hashes, hashed."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", *[F.coalesce(part(k), F.lit(0)).cast("string") for k in range(5)]), 256).alias("digest"))


def write(tables: dict[str, DataFrame], path: str) -> None:
    manifest = None
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")
        line = digest(df).select(F.lit(name).alias("name"), "n", "digest")
        manifest = line if manifest is None else manifest.unionByName(line)
    if manifest is not None:
        manifest.coalesce(1).write.json(f"{path}/manifest")


def load(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def verify(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> DataFrame:
    """(name, n, ok): each table of the manifest and whether its rows still give its digest."""
    manifest = spark.read.schema("name string, n long, digest string").json(f"{path}/manifest")
    found = None
    for name, df in load(spark, path, schemas).items():
        line = digest(df).select(F.lit(name).alias("name"), F.col("digest").alias("now"))
        found = line if found is None else found.unionByName(line)
    return manifest.join(found, "name", "left").select("name", "n", F.coalesce(F.col("digest") == F.col("now"), F.lit(False)).alias("ok"))
