"""Continuous periods of overlapping intervals, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_MS = 3_600_000
#: Bounds beyond this cannot be counted in whole half milliseconds by Spark's timestamps (60 million years).
MAX_MS = 1_900_000_000_000_000_000
HOUR_US = 3_600_000_000


def _session(start: Column, end: Column) -> Column:
    """A session of one interval, half a millisecond longer than it, so that bounds are included but 1 ms apart is apart. Half a millisecond is a microsecond of the session's own clock, which so reaches farther than the calendar."""
    length = 2 * (end - start) + 1
    hours = F.floor(length / F.lit(HOUR_US).cast("decimal(20,0)")).cast("int")
    seconds = ((length - hours.cast("bigint") * HOUR_US) / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")
    return F.session_window(F.timestamp_micros(2 * start), F.make_interval(hours=hours, secs=seconds))


def continuous_periods(intervals: DataFrame, key: str, start_s: str, end_s: str) -> DataFrame:
    """Merge the intervals of each key into maximal periods: key, start_ms, end_ms.

    Bounds are seconds and count to the millisecond; they are included, so intervals that
    touch join and intervals 1 ms apart do not. An instant can be a period. Rows whose key
    is null, whose bounds are null, not finite or more than 1.9e18 ms away, or that end
    before they start take no part. Repeated rows change nothing.

    Spark's session_window with a duration of its own for each row merges what overlaps.
    It runs twice: first within (key, hour of start), which spreads a hot key over many
    tasks and leaves one row for each merged stretch, then over the key.
    """
    start, end = F.round(F.col(start_s) * 1000), F.round(F.col(end_s) * 1000)
    usable = intervals.where(F.col(key).isNotNull() & (F.abs(start) <= MAX_MS) & (F.abs(end) <= MAX_MS) & (F.col(start_s) <= F.col(end_s)))
    rows = usable.select(F.col(key).alias("k"), start.cast("bigint").alias("s"), end.cast("bigint").alias("e"))
    bounds = [F.min("s").alias("s"), F.max("e").alias("e")]
    stretches = rows.groupBy("k", F.floor(F.col("s") / CHUNK_MS).alias("chunk"), _session(F.col("s"), F.col("e")).alias("w")).agg(*bounds)
    periods = stretches.select("k", "s", "e").groupBy("k", _session(F.col("s"), F.col("e")).alias("w")).agg(*bounds)
    return periods.select(F.col("k").alias(key), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


def periods_and_gaps(intervals: DataFrame, key: str, start_s: str, end_s: str) -> DataFrame:
    """``continuous_periods`` and the gaps between successive ones: key, span, start_ms, end_ms."""
    periods = continuous_periods(intervals, key, start_s, end_s)
    following = periods.withColumn("next_ms", F.lead("start_ms").over(Window.partitionBy(key).orderBy("start_ms")))
    spans = F.array(
        F.struct(F.lit("period").alias("span"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b")),
        F.struct(F.lit("gap").alias("span"), F.col("end_ms").alias("a"), F.col("next_ms").alias("b")),
    )
    return following.select(key, F.explode(spans).alias("x")).where("x.b is not null").select(key, "x.span", F.col("x.a").alias("start_ms"), F.col("x.b").alias("end_ms"))
