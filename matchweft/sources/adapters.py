"""The driver's event and document tables in the shape of the contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The event type that stands for each kind of row of the events table.
EVENT_TYPES = {"click": "refresh_shop", "purchase": "buy_unit", "signup": "purchase_xp", "view": "shop_changed", "error": "unknown"}


def event_kind(raw: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])
    return F.coalesce(kinds[raw], F.lit("unknown"))


def game_events(events: DataFrame) -> DataFrame:
    """Rows of the events table as GameEvents. Seconds count from the first event of a match; events without a user belong to none and are left out; ids are padded, so their order as text is that of the numbers. The original time stays as ``ts``."""
    starts = events.groupBy("user_id").agg(F.min("ts").alias("start"))
    micros = F.expr("timestampdiff(MICROSECOND, start, ts)")
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = events.join(starts, "user_id").withColumn("k", k)
    return rows.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"),
        F.concat(F.lit("m-"), F.col("user_id").cast("string")).alias("match_id"),
        (micros / F.lit(1_000_000.0)).alias("timestamp_s"),
        event_kind(F.col("event_type")).alias("event_type"),
        F.to_json(F.struct("value", "k")).alias("payload"),
        (F.col("k") / F.lit(100.0)).alias("confidence"),
        F.array(F.concat(F.lit("doc-"), F.col("k").cast("string"))).alias("evidence_ids"),
        F.array().cast("array<string>").alias("observation_ids"),
        F.lit("event-engine-0.1.0").alias("producer_version"),
        F.lit(1).cast("bigint").alias("schema_version"),
        "ts", "value", "k",
    )
