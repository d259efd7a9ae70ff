"""States from events: a fold in the order of the match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .order import CHUNK_S, latest, scan

def reduce_states(events: DataFrame, fields: dict[str, tuple[str, Column]], count_of: str | None = None, chunk_s: int = CHUNK_S) -> DataFrame:
    """One state for each event time: the last value of each field and the number of events so far.

    ``fields`` gives for each state field the event type that sets it and the value. Rows of
    one match and time collapse to one state, that after the last of them by id. All fields share
    one scan, which takes a match ``chunk_s`` seconds at a time.
    """
    running = {name: ("last", F.when(F.col("event_type") == kind, value)) for name, (kind, value) in fields.items()}
    counted = F.when(F.col("event_type") == count_of, 1) if count_of else F.lit(1)
    rows = events.select("match_id", "timestamp_s", "event_id", "event_type", F.col("confidence").alias("__confidence"), *[x.alias(f"__{n}") for n, (_, x) in running.items()], counted.alias("__one"))
    values = {n: ("last", F.col(f"__{n}")) for n in running} | {"n_events": ("count", F.col("__one")), "confidence": ("min", F.col("__confidence"))}
    rows = scan(rows, ["match_id"], "timestamp_s", "event_id", values, chunk_s=chunk_s)
    # A state for each time: the one after its last event. Events of one time share an hour.
    last = rows.groupBy("match_id", "timestamp_s").agg(F.max_by(F.struct("event_id", *values), "event_id").alias("s"))
    return last.select("match_id", "timestamp_s", "s.*")


def latest_states(states: DataFrame, id_: str = "state_id") -> DataFrame:
    """The current state of every match."""
    return latest(states, "match_id", "timestamp_s", id_)


def fold_board(events: DataFrame, unit: str = "unit_id") -> DataFrame:
    """The units each match holds after its last event: match_id, unit, stars, since.

    Buying a unit again raises it by a star, selling removes it. What happens to one unit depends
    on no other, so the fold runs within (match, unit): the last sale of a unit ends its former
    lives, and the purchases after it count. Two partial aggregates, so no unit's events are sorted.
    """
    rows = events.where(F.col("event_type").isin("buy_unit", "sell_unit") & F.col(unit).isNotNull()).select("match_id", F.col(unit).alias("unit"), "timestamp_s", "event_id", (F.col("event_type") == "sell_unit").alias("sold"))
    at = F.struct(F.coalesce("timestamp_s", F.lit(float("-inf"))).alias("t"), F.coalesce("event_id", F.lit("")).alias("i"))
    sales = rows.where("sold").groupBy(F.coalesce("match_id", F.lit("")).alias("__m"), F.col("match_id").isNull().alias("__none"), F.col("unit").alias("__u")).agg(F.max(at).alias("sale"))
    bought = rows.where("not sold").withColumn("at", at)
    same = (F.coalesce("match_id", F.lit("")) == F.col("__m")) & (F.col("match_id").isNull() == F.col("__none")) & (F.col("unit") == F.col("__u"))
    live = bought.join(sales, same, "left").where(F.col("sale").isNull() | (F.col("at") > F.col("sale")))
    return live.groupBy("match_id", "unit").agg(F.count(F.lit(1)).alias("stars"), F.min("timestamp_s").alias("since"))
