"""Streams of events: latest state, one state per event, detection, sessions and advice.

Rows come late and twice. What only needs the latest value is built in (deduplication and an
aggregate by time); what needs every event in order is buffered until the watermark has
passed it and then folded in (timestamp_s, id) order, so a stream and a batch over the rows it
accepted give the same states.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_SCHEMA = "event_id string, match_id string, timestamp_s double, event_type string, value bigint, confidence double"
STATE_SCHEMA = "match_id string, timestamp_s double, event_id string, gold bigint, hp bigint, n_events bigint"
#: Which event sets which field of the streamed state.
SETS = {"gold_changed": "gold", "hp_changed": "hp"}


def read_log(spark: SparkSession, path: str, schema: str | StructType = EVENT_SCHEMA, files_per_batch: int = 100) -> DataFrame:
    """An append-only JSONL log as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def with_event_time(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Event time from the seconds of the match, with a watermark. Rows without a usable time are dropped: they can never be ordered."""
    timed = events.where(F.col("timestamp_s").between(0, 1e11)).withColumn("event_time", F.timestamp_micros(F.round(F.col("timestamp_s") * 1_000_000).cast("bigint")))
    return timed.withWatermark("event_time", delay)


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event once, with state only for ids within the watermark."""
    return events.dropDuplicatesWithinWatermark(["match_id", "event_id"])


def latest_states(events: DataFrame) -> DataFrame:
    """The current gold and hp of each match and its number of events, for update mode. The latest event by time and id wins, in whatever order they arrive.

    A row of state is kept for each match ever seen, as the current state of all matches is what is
    asked for; ``session_counts`` and ``ordered_states`` keep only what the watermark has not passed.
    """
    at = F.struct("timestamp_s", "event_id")
    last = lambda kind: F.max_by("value", F.when(F.col("event_type") == kind, at))
    return events.groupBy("match_id").agg(*[last(kind).alias(field) for kind, field in SETS.items()], F.count(F.lit(1)).alias("n_events"))


def session_counts(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of each match, emitted once the watermark has closed them."""
    return events.groupBy("match_id", F.session_window("event_time", gap)).agg(F.count(F.lit(1)).alias("n_events"))


#: Seconds of event time that one timer stands for.
BUCKET_S = 10


class _Buffered(StatefulProcessor):
    """Buffers rows until the watermark passes their time, then gives those that are due, once each and in order, to ``fold``.

    A timer is set for each bucket of event time rather than for each row. A bucket's expiry reads
    what still waits, which is what arrived within the delay of the watermark; so each row is
    read as often as there are buckets in the delay, however many rows a match has.
    """

    fields: list[str]
    waiting_schema: str
    state_schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.state = handle.getValueState("state", self.state_schema)

    def fold(self, key: tuple, state: tuple | None, due: list[tuple]) -> tuple[tuple, pd.DataFrame]:
        raise NotImplementedError

    def typed(self, row: tuple) -> tuple:
        """The row as plain values of the waiting list's types."""
        return (float(row[0]), *(int(x) if isinstance(x, float) else x for x in row[1:]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            new = [tuple(None if pd.isna(x) else x for x in r) for r in df[self.fields].itertuples(index=False)]
            self.waiting.appendList([self.typed(r) for r in new])
            for bucket in {math.ceil(r[0] / BUCKET_S) for r in new}:
                self.handle.registerTimer(bucket * BUCKET_S * 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        buffered = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted({x for x in buffered if x[0] <= now}, key=lambda x: (x[0], x[1] or ""))
        if not due:
            yield pd.DataFrame()
            return
        rest = [x for x in buffered if x[0] > now]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        state, out = self.fold(key, self.state.get() if self.state.exists() else None, due)
        self.state.update(state)
        yield out

    def close(self) -> None:
        pass


class _OrderedFold(_Buffered):
    fields = ["timestamp_s", "event_id", "event_type", "value"]
    waiting_schema, state_schema = "timestamp_s double, event_id string, event_type string, value bigint", "gold bigint, hp bigint, n_events bigint"

    def fold(self, key, state, due):
        gold, hp, n = state or (None, None, 0)
        rows = []
        for t, i, kind, value in due:
            n += 1
            value = None if value is None else int(value)
            gold = value if kind == "gold_changed" else gold
            hp = value if kind == "hp_changed" else hp
            rows.append((key[0], t, i, gold, hp, n))
        return (gold, hp, n), pd.DataFrame(rows, columns=["match_id", "timestamp_s", "event_id", "gold", "hp", "n_events"]).astype({"gold": "Int64", "hp": "Int64"})


def ordered_states(events: DataFrame) -> DataFrame:
    """One state for each event, in order, for append mode; needs the RocksDB state store. Events later than the watermark are dropped by it, and those after the last watermark wait."""
    return events.groupBy("match_id").transformWithStateInPandas(statefulProcessor=_OrderedFold(), outputStructType=STATE_SCHEMA, outputMode="Append", timeMode="EventTime")


class _Detect(_Buffered):
    fields = ["timestamp_s", "observation_id", "same"]
    waiting_schema, state_schema = "timestamp_s double, observation_id string, same string", "same string"

    def fold(self, key, state, due):
        known, last = state is not None, state[0] if state else None
        rows = []
        for t, i, same in due:
            if not known or same != last:
                rows.append((key[0], key[1], t, i))
            known, last = True, same
        return (last,), pd.DataFrame(rows, columns=["match_id", "kind", "timestamp_s", "observation_id"])


def changed_readings(observations: DataFrame) -> DataFrame:
    """Observations that differ from the last one of their match and kind (columns match_id, kind, timestamp_s, observation_id, same, event_time), for append mode."""
    return observations.groupBy("match_id", "kind").transformWithStateInPandas(statefulProcessor=_Detect(), outputStructType="match_id string, kind string, timestamp_s double, observation_id string", outputMode="Append", timeMode="EventTime")


def advise_stream(states: DataFrame, enabled: bool) -> DataFrame:
    """Suggestions from current states, in update mode; a read-only consumer behind its switch."""
    action = F.when(F.col("hp") <= 20, "stabilize").when(F.col("gold") >= 50, "level_to").when(F.coalesce("gold", F.lit(0)) < 20, "hold_economy").otherwise("roll_to_gold")
    return states.where(F.lit(enabled)).select("match_id", action.alias("action_type"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all there is and stop. Append mode writes Parquet; update mode writes each batch's rows with its number, so the last one of a key is its current row."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/{n:08d}"))
    writer.start().awaitTermination()
