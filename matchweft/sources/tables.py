"""Parquet and JSONL tables of the match store.

Observations and events are append-only JSONL, states and decisions are Parquet in
folders by ``match_id`` or buckets of it; reads always take an explicit schema, so that no pass over the
data is spent on inference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines read with a fixed schema; lines that are no JSON give null fields and are kept."""
    return spark.read.schema(schema).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows to a JSONL log; nulls are written, as the record model writes them."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_by_match(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a derived table in folders by match, for stores of few matches; only the matches in ``df`` are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("match_id").parquet(path)


def write_bucketed(df: DataFrame, path: str, mode: str = "overwrite", buckets: int = 64) -> None:
    """Write a derived table of many matches in folders by bucket of match_id, sorted by match within them; only the buckets in ``df`` are replaced.

    A folder for each match would be millions of small files; files of a bucket are skipped by
    their ranges of match_id just the same.
    """
    placed = df.withColumn("match_bucket", F.pmod(F.xxhash64("match_id"), F.lit(buckets)))
    placed = placed.repartition("match_bucket").sortWithinPartitions("match_bucket", "match_id")
    placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("match_bucket").parquet(path)


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of ``write_bucketed`` with its own columns."""
    whole = T.StructType([*schema.fields, T.StructField("match_bucket", T.LongType())])
    return spark.read.schema(whole).parquet(path).drop("match_bucket")


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Read Parquet files written under additive schema versions as one table."""
    return spark.read.option("mergeSchema", "true").parquet(path)
