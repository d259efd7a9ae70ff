"""Confidence gates, keyframes and confirmation: what is let through from one layer to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .order import differs, scan, stretches


def confident(confidence: Column, least: float) -> Column:
    """At least the given confidence; null and NaN are not."""
    return F.coalesce((confidence >= F.lit(least)) & ~F.isnan(confidence), F.lit(False))


def gate_observations(observations: DataFrame, least: float = 0.70) -> DataFrame:
    """Observations under the floor keep their row but lose their reading (``{}``)."""
    return observations.withColumn("value", F.when(confident(F.col("confidence"), least), F.col("value")).otherwise(F.lit("{}")))


def gate_events(events: DataFrame, least: float = 0.80) -> DataFrame:
    """Events that may change a state; the others stay in the log only."""
    return events.where(confident(F.col("confidence"), least))


def rejected_evidence(observations: DataFrame, least: float = 0.70) -> DataFrame:
    """Evidence ids of observations under the floor, once each, to be kept for review."""
    rejects = observations.where(~confident(F.col("confidence"), least))
    return rejects.select("match_id", F.explode("evidence_ids").alias("evidence_id")).where("evidence_id is not null").distinct()


def keyframes(records: DataFrame, every_s: float = 10, time: str = "timestamp_s", id_: str = "observation_id") -> DataFrame:
    """The first record of each match in each interval: match_id, slot, id, time. A partial aggregate, so hot matches are reduced before the shuffle."""
    t = F.col(time)
    slots = records.where(t.between(0, 1e15)).withColumn("slot", F.floor(t / every_s).cast("bigint"))
    first = F.min(F.struct(t.alias("t"), F.col(id_).alias("i")))
    return slots.groupBy("match_id", "slot").agg(first.alias("f")).select("match_id", "slot", F.col("f.i").alias(id_), F.col("f.t").alias(time))


def _runs(records: DataFrame, value: str, time: str, id_: str, within: tuple[str, ...]) -> DataFrame:
    return stretches(records, ["match_id", *within], time, id_, F.col(value), differs)


def changes(records: DataFrame, value: str, time: str = "timestamp_s", id_: str = "observation_id", within: tuple[str, ...] = ()) -> DataFrame:
    """Records whose value differs from the one before in the match; the first one does."""
    rows = scan(records, ["match_id", *within], time, id_, {"__b": ("before", F.col(value))})
    return rows.where(F.col("__b").isNull() | differs(F.col(value), F.col("__b.v"))).drop("__b")


def confirmed(records: DataFrame, value: str, frames: int = 2, time: str = "timestamp_s", id_: str = "observation_id", within: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Records that are at least the n-th in a row with the same value in their match (and kind)."""
    return _runs(records, value, time, id_, within).where(F.col("stretch_place") >= frames).drop("stretch_no", "stretch_place")


def first_confirmation(records: DataFrame, value: str, frames: int = 2, time: str = "timestamp_s", id_: str = "observation_id") -> DataFrame:
    """One record for each confirmed stretch: the one that completes the confirmation. A value that is confirmed again after others that were not is no new one."""
    return changes(confirmed(records, value, frames, time, id_), value, time, id_, ("kind",))
