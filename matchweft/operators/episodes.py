"""Decision episodes: many events grouped into one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .order import CHUNK_S, differs, scan, stretches

ROLLDOWN = ("refresh_shop", "buy_unit", "sell_unit")


def episodes_by_run(events: DataFrame, kind: str = "event_type", time: str = "timestamp_s", id_: str = "event_id", chunk_s: int = CHUNK_S) -> DataFrame:
    """Stretches of events of one kind: match_id, episode_no, kind, n_events, start and end time, first id."""
    rows = stretches(events.select("match_id", kind, time, id_), ["match_id"], time, id_, F.col(kind), differs, chunk_s).withColumnRenamed("stretch_no", "episode_no")
    return rows.groupBy("match_id", "episode_no", kind).agg(F.count(F.lit(1)).alias("n_events"), F.min(time).alias("start_timestamp_s"), F.max(time).alias("end_timestamp_s"), F.min_by(id_, F.struct(time, id_)).alias("first_id"))


def rolldowns(events: DataFrame, gap_s: float, chunk_s: int = CHUNK_S) -> DataFrame:
    """Refresh, buy and sell events with less than the gap between them, as ROLLDOWN episodes."""
    rows = events.where(F.col("event_type").isin(*ROLLDOWN)).select("match_id", "timestamp_s", "event_id", "confidence")
    rows = stretches(rows, ["match_id"], "timestamp_s", "event_id", F.col("timestamp_s"), lambda t, before: t - before >= gap_s, chunk_s).withColumnRenamed("stretch_no", "episode_no")
    return rows.groupBy("match_id", "episode_no").agg(F.count(F.lit(1)).alias("n_events"), F.min("timestamp_s").alias("start_timestamp_s"), F.max("timestamp_s").alias("end_timestamp_s"), F.min("confidence").alias("confidence"))


def sessions(events: DataFrame, ts: str, gap: str) -> DataFrame:
    """Sessions of each match by Spark's session window: match_id, started, n_events."""
    return events.groupBy("match_id", F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("started")).drop("w")


def episode_lengths(decisions: DataFrame) -> DataFrame:
    """Episodes of each type with usable bounds: how many, how long, how sure; re-sent ones once."""
    ok = decisions.where("start_timestamp_s <= end_timestamp_s and abs(end_timestamp_s) < 1e15 and abs(start_timestamp_s) < 1e15").dropDuplicates(["decision_id"])
    ms = F.round((F.col("end_timestamp_s") - F.col("start_timestamp_s")) * 1000).cast("bigint")
    return ok.groupBy("decision_type").agg(F.count(F.lit(1)).alias("n_episodes"), F.sum(ms).alias("total_ms"), F.max(ms).alias("longest_ms"), F.min("confidence").alias("least_confidence"))


def actions_of_episodes(decisions: DataFrame) -> DataFrame:
    """One row for each action id of an episode, in order; the way from an episode to its actions."""
    return decisions.dropDuplicates(["decision_id"]).select("decision_id", "match_id", F.posexplode("action_ids").alias("action_pos", "action_id")).where("action_id is not null").withColumn("action_pos", F.col("action_pos").cast("bigint"))


def overlapping_episodes(decisions: DataFrame) -> DataFrame:
    """Episodes of a match that start before one that started earlier has ended."""
    ok = decisions.where("start_timestamp_s <= end_timestamp_s").dropDuplicates(["decision_id"]).select("match_id", "decision_id", "start_timestamp_s", "end_timestamp_s")
    rows = scan(ok, ["match_id"], "start_timestamp_s", "decision_id", {"busy": ("most_before", F.col("end_timestamp_s"))})
    return rows.where("start_timestamp_s < busy").select("match_id", "decision_id")
