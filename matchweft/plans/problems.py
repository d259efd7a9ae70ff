"""Queries of the general data problems, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.drift import schema_changes, unify_records
from ..operators.impute import fill_states
from ..operators.nested import flatten_boards, item_occurrences, nested_counts, rebuild_boards, unit_occurrences
from ..operators.outliers import implausible_readings
from ..operators.periods import periods_and_gaps
from ..sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return item_occurrences(flatten_boards(table(spark, sf, "game_states")))


def p1_units(spark: SparkSession, sf: str) -> DataFrame:
    tables = flatten_boards(table(spark, sf, "game_states"))
    return unit_occurrences(tables).join(tables.units, "unit_key").select("state_id", "opponent_pos", "unit_pos", "instance_id", "champion_id", "stars")


def p1_opponents(spark: SparkSession, sf: str) -> DataFrame:
    tables = flatten_boards(table(spark, sf, "game_states"))
    return tables.state_opponents.join(tables.opponents, "opponent_key").select("state_id", "opponent_pos", "player_id", "hp", "level")


def p1_boards(spark: SparkSession, sf: str) -> DataFrame:
    boards = rebuild_boards(flatten_boards(table(spark, sf, "game_states")))
    return boards.select("state_id", "opponent_pos", F.size("board").cast("bigint").alias("n_units"))


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each of the flat tables."""
    return nested_counts(flatten_boards(table(spark, sf, "game_states")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return periods_and_gaps(table(spark, sf, "decisions"), "match_id", "start_timestamp_s", "end_timestamp_s")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_changes(table(spark, sf, "raw_records"))


def p4_observations(spark: SparkSession, sf: str) -> DataFrame:
    return unify_records(table(spark, sf, "raw_records"), "observation")


def p4_game_states(spark: SparkSession, sf: str) -> DataFrame:
    return unify_records(table(spark, sf, "raw_records"), "game_state")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return implausible_readings(table(spark, sf, "observations"), table(spark, sf, "game_states")).select("record_type", "record_id", "field")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return fill_states(table(spark, sf, "game_states")).select("state_id", F.explode("filled").alias("field")).distinct()


def p6_filled(spark: SparkSession, sf: str) -> DataFrame:
    return fill_states(table(spark, sf, "game_states")).withColumn("filled", F.array_join("filled", ","))


QUERIES = {f.__name__: f for f in (p1_found, p1_units, p1_opponents, p1_boards, p1_counts, p2_found, p4_found, p4_observations, p4_game_states, p5_found, p6_found, p6_filled)}

_OCCURRENCES = """
WITH boards AS (
  SELECT state_id, CAST(-1 AS BIGINT) AS opponent_pos, board FROM game_states
  UNION ALL
  SELECT state_id, CAST(i AS BIGINT) AS opponent_pos, observed_opponents[i + 1].board AS board
  FROM (SELECT state_id, observed_opponents, unnest(range(len(observed_opponents))) AS i FROM game_states)),
units AS (
  SELECT DISTINCT state_id, opponent_pos, CAST(i AS BIGINT) AS unit_pos, board[i + 1] AS u
  FROM (SELECT state_id, opponent_pos, board, unnest(range(len(board))) AS i FROM boards))
"""

_SPANS = """
WITH e AS (
  SELECT DISTINCT match_id, CAST(round(start_timestamp_s * 1000) AS BIGINT) AS s, CAST(round(end_timestamp_s * 1000) AS BIGINT) AS e
  FROM (SELECT * FROM decisions WHERE isfinite(start_timestamp_s) AND isfinite(end_timestamp_s))
  WHERE match_id IS NOT NULL AND start_timestamp_s <= end_timestamp_s),
m AS (SELECT *, max(e) OVER (PARTITION BY match_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e),
g AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
p AS (SELECT match_id, min(s) AS start_ms, max(e) AS end_ms FROM g GROUP BY match_id, g),
n AS (SELECT *, lead(start_ms) OVER (PARTITION BY match_id ORDER BY start_ms) AS next_ms FROM p)
SELECT match_id, 'period' AS span, start_ms, end_ms FROM n
UNION ALL SELECT match_id, 'gap' AS span, end_ms AS start_ms, next_ms AS end_ms FROM n WHERE next_ms IS NOT NULL
"""

_MISSING = " UNION ".join(
    f"SELECT state_id, '{name}' AS field FROM game_states WHERE {cell} IS NULL OR {cell} < {least}"
    for name, cell, least in (("stage", "stage", 1), ("round", "round", 1), ("gold", "player.gold", 0), ("hp", "player.hp", 0))
)

ORACLES = {
    "p1_found": _OCCURRENCES
    + """SELECT state_id, opponent_pos, unit_pos, CAST(i AS BIGINT) AS item_pos, items[i + 1] AS item_id
FROM (SELECT state_id, opponent_pos, unit_pos, u.items AS items, unnest(range(len(u.items))) AS i FROM units) WHERE items[i + 1] IS NOT NULL""",
    "p1_units": _OCCURRENCES + "SELECT state_id, opponent_pos, unit_pos, u.instance_id AS instance_id, u.champion_id AS champion_id, u.stars AS stars FROM units WHERE u IS NOT NULL",
    "p1_opponents": """SELECT DISTINCT state_id, CAST(i AS BIGINT) AS opponent_pos, o.player_id AS player_id, o.hp AS hp, o.level AS level
FROM (SELECT state_id, i, observed_opponents[i + 1] AS o FROM (SELECT state_id, observed_opponents, unnest(range(len(observed_opponents))) AS i FROM game_states)) WHERE o IS NOT NULL""",
    "p1_boards": _OCCURRENCES + "SELECT state_id, opponent_pos, count(*) AS n_units FROM units WHERE u IS NOT NULL GROUP BY state_id, opponent_pos",
    "p1_counts": _OCCURRENCES
    + """, b AS (SELECT DISTINCT board FROM boards WHERE len(board) > 0),
bu AS (SELECT board, u, i FROM (SELECT board, i, board[i + 1] AS u FROM (SELECT board, unnest(range(len(board))) AS i FROM b)) WHERE u IS NOT NULL),
du AS (SELECT DISTINCT u FROM bu),
o AS (SELECT DISTINCT state_id, i, observed_opponents[i + 1] AS o FROM (SELECT state_id, observed_opponents, unnest(range(len(observed_opponents))) AS i FROM game_states) WHERE observed_opponents[i + 1] IS NOT NULL)
SELECT 'state_boards' AS table_name, count(*) AS n_rows FROM (SELECT DISTINCT state_id, opponent_pos, board FROM boards WHERE len(board) > 0)
UNION ALL SELECT 'state_opponents', count(*) FROM o
UNION ALL SELECT 'board_units', count(*) FROM bu
UNION ALL SELECT 'board_items', count(*) FROM (SELECT unnest(u.items) AS x FROM bu) WHERE x IS NOT NULL
UNION ALL SELECT 'unit_items', count(*) FROM (SELECT unnest(u.items) AS x FROM du) WHERE x IS NOT NULL
UNION ALL SELECT 'opponents', count(*) FROM (SELECT DISTINCT o.player_id AS a, o.hp AS b, o.level AS c, o.confidence AS d, o.schema_version AS e, CASE WHEN len(o.board) > 0 THEN o.board END AS f FROM o)
UNION ALL SELECT 'units', count(*) FROM du""",
    "p2_found": _SPANS,
    "p6_found": _MISSING,
}
