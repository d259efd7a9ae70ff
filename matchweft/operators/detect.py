"""Events from observations: what changed since the last known reading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.jsonvalue import canonical_object
from .gates import confident
from .order import differs, scan

#: The event that tells of a change of each kind of reading.
EVENT_OF_KIND = {"gold": "gold_changed", "hp": "hp_changed", "level": "level_changed", "xp": "xp_changed", "shop": "shop_changed"}
EVENT_FLOOR, PRODUCER = 0.70, "event-engine-0.1.0"


def detect_events(observations: DataFrame, least: float = EVENT_FLOOR) -> DataFrame:
    """GameEvents for changed readings.

    Readings under the confidence floor and empty ones say nothing. A reading is compared with
    the last one of its match and kind, which is what the state holds if it keeps last
    values. An event's confidence is the lower of the two. The first reading of a match is an event.
    Re-sent observations are one.
    """
    rows = observations.where(F.col("kind").isin(*EVENT_OF_KIND) & confident(F.col("confidence"), least))
    rows = rows.dropDuplicates(["match_id", "kind", "timestamp_s", "observation_id"]).withColumn("same", canonical_object(F.col("value"), ["ocr_score"])).where("same <> ''")
    rows = scan(rows, ["match_id", "kind"], "timestamp_s", "observation_id", {"b": ("before", F.struct("same", "value", "confidence"))}).withColumn("before", F.col("b.v"))
    rows = rows.where(differs(F.col("same"), F.col("before.same")))
    kinds = F.create_map(*[F.lit(x) for kv in EVENT_OF_KIND.items() for x in kv])
    return rows.select(
        F.concat(F.lit("e-"), "observation_id").alias("event_id"), "match_id", "timestamp_s",
        kinds[F.col("kind")].alias("event_type"),
        F.to_json(F.struct(F.col("before.value").alias("from"), F.col("value").alias("to")), {"ignoreNullFields": "false"}).alias("payload"),
        F.least("confidence", "before.confidence").alias("confidence"),
        "evidence_ids", F.array("observation_id").alias("observation_ids"), F.lit(PRODUCER).alias("producer_version"), F.lit(1).cast("bigint").alias("schema_version"),
    )


def perceive(evidence: DataFrame, recognise: Callable[[str, bytes], list[dict]], schema: str) -> DataFrame:
    """Observations of evidence files (path, content, as the binaryFile source reads them), by a given recogniser, Arrow batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [row for path, content in zip(df["path"], df["content"]) for row in recognise(path, content)]
            if rows:
                yield pd.DataFrame(rows)

    return evidence.select("path", "content").mapInPandas(run, schema)
