"""Queries of the training-data problems, over the whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from ..sources.tables import table
from .bpe import encode_corpus, token_counts
from .packing import pack
from .runs import near_runs, observation_runs
from .splits import assign_splits, linked_pairs, match_components
from .stuffing import stuffed_pages


#: Squared points of experience that a boundary must save.
XP_PENALTY = 30.0


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    runs = observation_runs(table(spark, sf, "observations"))
    return runs.where("n >= 2").select("match_id", "kind", F.col("first_id").alias("first_observation_id"), F.col("last_id").alias("last_observation_id"))


def p3_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = observation_runs(table(spark, sf, "observations"))
    return runs.select("match_id", "kind", F.col("first_id").alias("first_observation_id"), F.col("last_id").alias("last_observation_id"), "n", F.round("duration", 3).alias("duration_s"))


def p3_near(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of about the same experience in each match."""
    runs = near_runs(table(spark, sf, "observations"), "xp", XP_PENALTY)
    return runs.select("match_id", F.col("first_id").alias("first_observation_id"), F.col("last_id").alias("last_observation_id"), "n", F.round("duration", 3).alias("duration_s"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return linked_pairs(table(spark, sf, "transitions"))


def p7_components(spark: SparkSession, sf: str) -> DataFrame:
    """Every match with the match that stands for its component."""
    return match_components(table(spark, sf, "transitions"))


def p7_whole(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the splits: matches and rows assigned, and components in more than one split."""
    samples = table(spark, sf, "transitions")
    out = assign_splits(samples, table(spark, sf, "split_shares"))
    sizes = samples.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    rows = out.join(sizes, out["match_id"].eqNullSafe(sizes["match_id"])).groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), (F.min("split") != F.max("split")).alias("torn"))
    return rows.agg(F.sum("m").alias("n_matches"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_components"), F.sum(F.col("torn").cast("bigint")).alias("n_torn"))


def p7_splits(spark: SparkSession, sf: str) -> DataFrame:
    return assign_splits(table(spark, sf, "transitions"), table(spark, sf, "split_shares"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and share of each split, beside its target."""
    samples, shares = table(spark, sf, "transitions"), table(spark, sf, "split_shares")
    sizes = samples.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    counted = assign_splits(samples, shares).select("match_id", "split").join(sizes, "match_id").groupBy("split").agg(F.sum("n").alias("n_rows"))
    met = F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(F.lit(0)))  # a row for each split
    return counted.join(shares, "split").select("split", "n_rows", F.col("share").alias("target"), met.alias("met"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"))


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"))


def _capacities(spark: SparkSession, sf: str) -> list[tuple[str, int]]:
    """The settings table; it has a few rows."""
    rows = table(spark, sf, "containers").where("capacity_tokens > 0").orderBy("container").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("containers is a table of settings and has at most 1000 rows")
    return [(r["container"], r["capacity_tokens"]) for r in rows]


def _packed(sizes: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [pack(sizes, "doc_id", "n_tokens", [c]).withColumn("container", F.lit(name)) for name, c in containers])


def _packings(spark: SparkSession, sf: str) -> DataFrame:
    """The packing of each container and the joint one, from one count of the tokens."""
    sizes, containers = cut_lineage(token_counts(table(spark, sf, "documents"))), _capacities(spark, sf)
    joint = pack(sizes, "doc_id", "n_tokens", [c for _, c in containers]).withColumn("container", F.lit("joint"))
    return _packed(sizes, containers).unionByName(joint)


def p9_packed(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in containers of each capacity: one packing for each row of containers."""
    return _packed(cut_lineage(token_counts(table(spark, sf, "documents"))), _capacities(spark, sf))


def p9_joint(spark: SparkSession, sf: str) -> DataFrame:
    """One packing that may use all capacities together; each bin ends at the least one that holds its contents."""
    sizes = token_counts(table(spark, sf, "documents"))
    return pack(cut_lineage(sizes), "doc_id", "n_tokens", [c for _, c in _capacities(spark, sf)])


def p9_whole(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the packings: documents placed, tokens placed, and bins over their capacity, in each."""
    each = _packings(spark, sf)
    bins = each.groupBy("container", "bin_id").agg(F.sum("size").alias("size"), F.max("capacity").alias("capacity"), F.count_if(F.col("piece") == 0).alias("n"), F.count_if((F.col("n_pieces") > 1) & (F.col("size") == 0)).alias("empty"))
    sums = bins.groupBy("container").agg(F.sum("n").alias("n_documents"), F.count_if(F.col("size") > F.col("capacity")).alias("n_over"), F.sum("empty").alias("n_empty_pieces"))
    return sums.select("container", "n_documents", "n_over", "n_empty_pieces")


def p9_waste(spark: SparkSession, sf: str) -> DataFrame:
    """Bins, tokens and unused share of each packing."""
    each = _packings(spark, sf)
    bins = each.groupBy("container", "bin_id").agg(F.sum("size").alias("size"), F.max("capacity").alias("capacity"))
    return bins.groupBy("container").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("size").alias("n_tokens"), (1 - F.sum("size") / F.sum("capacity")).alias("unused"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return stuffed_pages(table(spark, sf, "documents")).select("doc_id")


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    return stuffed_pages(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_runs, p3_near, p7_found, p7_components, p7_splits, p7_shares, p7_whole, p8_ids, p8_counts, p9_packed, p9_joint, p9_waste, p9_whole, p10_found, p10_scores)}

_RUNS = """
WITH o AS (
  SELECT DISTINCT observation_id, match_id, kind, timestamp_s, json(lower(value)) AS v FROM observations
  WHERE match_id IS NOT NULL AND kind IS NOT NULL AND isfinite(timestamp_s)),
f AS (SELECT o.*, unnest(CASE WHEN len(json_keys(v)) = 0 THEN [''] ELSE json_keys(v) END) AS k FROM o),
c AS (
  SELECT observation_id, match_id, kind, timestamp_s,
    coalesce(string_agg(k || '=' || coalesce(CAST(try_cast(json_extract_string(v, k) AS DECIMAL(38, 9)) AS VARCHAR), trim(json_extract_string(v, k)), 'null'), ';' ORDER BY k)
      FILTER (WHERE k NOT IN ('', 'ocr_score')), '') AS same
  FROM f GROUP BY ALL),
m AS (SELECT *, CASE WHEN lag(same) OVER w = same THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY match_id, kind ORDER BY timestamp_s, observation_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY match_id, kind ORDER BY timestamp_s, observation_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT match_id, kind, arg_min(observation_id, (timestamp_s, observation_id)) AS first_observation_id,
  arg_max(observation_id, (timestamp_s, observation_id)) AS last_observation_id, count(*) AS n, round(max(timestamp_s) - min(timestamp_s), 3) AS duration_s
FROM g GROUP BY match_id, kind, run
"""

_REACHED = """
WITH RECURSIVE s AS (
  SELECT DISTINCT match_id, s FROM (SELECT match_id, state_id AS s FROM transitions UNION ALL SELECT match_id, next_state_id AS s FROM transitions)
  WHERE regexp_matches(s, '[0-9]') AND NOT regexp_matches(s, '^([A-Za-z]+[-_:#])?0+$') AND match_id IS NOT NULL),
e AS (SELECT DISTINCT a.match_id AS a, b.match_id AS b FROM s AS a JOIN s AS b ON a.s = b.s AND a.match_id <> b.match_id),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
"""

ORACLES = {
    "p3_found": f"SELECT match_id, kind, first_observation_id, last_observation_id FROM ({_RUNS}) WHERE n >= 2",
    "p3_runs": _RUNS,
    "p7_found": f"{_REACHED} SELECT a AS match_id_a, b AS match_id_b FROM r WHERE a < b",
    "p7_components": f"""{_REACHED}, c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT m.match_id AS match_id, CASE WHEN c.b < m.match_id THEN c.b ELSE m.match_id END AS component FROM (SELECT DISTINCT match_id FROM transitions) AS m LEFT JOIN c ON m.match_id = c.a
""",
    "p7_whole": f"""{_REACHED}, c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
d AS (SELECT m.match_id AS match_id, CASE WHEN c.b < m.match_id THEN c.b ELSE m.match_id END AS component, n FROM (SELECT match_id, count(*) AS n FROM transitions GROUP BY match_id) AS m LEFT JOIN c ON m.match_id = c.a)
SELECT count(*) AS n_matches, CAST(sum(n) AS BIGINT) AS n_rows, count(DISTINCT coalesce(component, '(null)')) AS n_components, CAST(0 AS BIGINT) AS n_torn FROM d
""",
    "p9_whole": """
SELECT container, (SELECT count(*) FROM documents) AS n_documents, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_empty_pieces
FROM (SELECT container FROM containers WHERE capacity_tokens > 0 UNION ALL SELECT 'joint' AS container)
""",
}
