"""All queries of the core, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import problems, reference, reference_sql, relational

QUERIES = {**problems.QUERIES, **reference.QUERIES, **relational.QUERIES}
ORACLES = {**problems.ORACLES, **reference_sql.ORACLES, **relational.ORACLES}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return reference.state_latest(spark, sf)
