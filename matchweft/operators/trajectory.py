"""Trajectories: state, action, next state; the empirical transition model; encoded states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..contracts import ATOMIC_ACTIONS
from .order import scan


def transition_links(states: DataFrame) -> DataFrame:
    """Each state with the next one of its match; the last one is done. Re-sent states are one."""
    rows = states.dropDuplicates(["match_id", "timestamp_s", "state_id"]).select("match_id", "state_id", "timestamp_s")
    rows = scan(rows, ["match_id"], "timestamp_s", "state_id", {"n": ("before", F.col("state_id"))}, backwards=True)
    return rows.select("match_id", "state_id", "timestamp_s", F.col("n.v").alias("next_state_id"), F.col("n").isNull().alias("done"))


def atomic_actions(samples: DataFrame) -> DataFrame:
    """Samples whose action is one of the atomic ones."""
    return samples.where(F.col("action.action_type").isin(*ATOMIC_ACTIONS))


def action_masks(samples: DataFrame) -> DataFrame:
    """The actions seen in each match, in order of name, and whether each sample's mask holds its own action."""
    own = F.array_contains("action_mask", F.col("action.action_type"))
    return samples.groupBy("match_id").agg(F.array_join(F.array_sort(F.collect_set("action.action_type")), ",").alias("actions"), F.sum(F.when(own, 0).otherwise(1)).cast("bigint").alias("n_outside_mask"))


def transition_model(links: DataFrame, state: str, action: str, following: str) -> DataFrame:
    """P(next | state, action) by counts; the probabilities of each (state, action) add up to 1."""
    counts = links.groupBy(state, action, following).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(state, action))
    return counts.withColumn("probability", F.col("n") / total)


def phase_links(samples: DataFrame, states: DataFrame) -> DataFrame:
    """Samples with the phase of their state and of the next; samples of unknown states have none."""
    phases = states.dropDuplicates(["state_id"]).select("state_id", "phase")
    rows = samples.dropDuplicates(["match_id", "state_id", "timestamp_s"]).select("match_id", "state_id", "next_state_id", F.col("action.action_type").alias("action_type"))
    after = phases.select(F.col("state_id").alias("next_state_id"), F.col("phase").alias("next_phase"))
    return rows.join(phases, "state_id").join(after, "next_state_id").select("match_id", "phase", "action_type", "next_phase")


def encode_states(states: DataFrame, champions: int = 32) -> DataFrame:
    """Numeric features of each state for learners: player, clock and a hashed count vector of the board's champions."""
    number = lambda c: F.coalesce(F.col(c).cast("float"), F.lit(-1.0).cast("float"))
    hashed = F.transform(F.filter(F.coalesce("board", F.array().cast(states.schema["board"].dataType)), lambda u: u.isNotNull() & u["champion_id"].isNotNull()), lambda u: F.pmod(F.xxhash64(u["champion_id"]), F.lit(champions)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(champions - 1)), lambda i: F.size(F.filter(hashed, lambda h: h == i)).cast("float"))
    return states.select("match_id", "state_id", F.concat(F.array(number("stage"), number("round"), number("player.hp"), number("player.gold"), number("player.level"), number("player.xp")), counts).alias("features"))


def dataset(samples: DataFrame, states: DataFrame) -> DataFrame:
    """Offline-learning rows: sample, encoded state and next state; a dangling next state gives null features."""
    known = encode_states(states.dropDuplicates(["state_id"])).drop("match_id")
    after = known.select(F.col("state_id").alias("next_state_id"), F.col("features").alias("next_features"))
    return samples.join(known, "state_id").join(after, "next_state_id", "left")
