"""Provenance: evidence catalogue, links by id, dangling ids, and what must be rebuilt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def evidence_catalog(documents: DataFrame) -> DataFrame:
    """Documents as evidence references; the hash tells contents apart. A null text has no hash."""
    return documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("evidence_id"), F.coalesce("match_id", F.lit("")).alias("match_id"), F.lit(0.0).alias("timestamp_s"),
        F.lit("external_api").alias("kind"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("uri"), F.sha2("text", 256).alias("sha256"), F.coalesce("source", F.lit("screen")).alias("source"),
    )


def duplicate_evidence(catalog: DataFrame) -> DataFrame:
    """Contents stored more than once."""
    return catalog.where("sha256 is not null").groupBy("sha256").agg(F.count(F.lit(1)).alias("n_copies"), F.min("evidence_id").alias("kept_id")).where("n_copies > 1")


def links(df: DataFrame, id_: str, ids: str, name: str) -> DataFrame:
    """One row for each id in an id array, with its place."""
    return df.select(F.col(id_), F.posexplode(ids).alias("pos", name)).where(F.col(name).isNotNull()).withColumn("pos", F.col("pos").cast("bigint"))


def dangling(refs: DataFrame, ref: str, targets: DataFrame, target: str) -> DataFrame:
    """References that name no target; null references name nothing and are left out."""
    named = refs.where(F.col(ref).isNotNull())
    return named.join(targets.select(F.col(target).alias(ref)).distinct(), ref, "left_anti")


def rebuild_candidates(states: DataFrame, manifests: DataFrame, expected: Column) -> DataFrame:
    """Matches with states made by another reducer version than their manifest asks for: match_id, n_stale, found, wanted."""
    wanted = manifests.groupBy("match_id").agg(F.max("versions.reducer").alias("r")).select("match_id", expected.alias("wanted"))
    stale = states.groupBy("match_id", "reducer_version").agg(F.countDistinct("state_id").alias("n_stale")).join(wanted, "match_id")
    return stale.where("reducer_version <> wanted").select("match_id", "n_stale", F.col("reducer_version").alias("found"), "wanted")


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tables of two additive schema versions as one; fields the old one lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)
