"""Queries over contracts as JSON, sinks, settings and relational operators, over the whole tables, with their SQL."""

from __future__ import annotations

from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import load_config
from ..contracts import contracts, schema
from ..operators import analysis, detect, gates, lineage, order, trajectory, validate
from ..session import ensure_checkpoint_dir
from ..sources import tables
from ..sources.records import to_records
from ..sources.tables import table
from . import reference, reference_sql as sql

TYPED = {"observations": "Observation", "decisions": "DecisionEpisode", "transitions": "TransitionSample", "manifests": "MatchManifest"}


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"


def json_contract_violations(spark, sf):
    """Typed tables written as JSON records and judged by the validator of JSON; the same codes as for the typed rows."""
    found = None
    for name, contract in TYPED.items():
        codes = validate.validate_json(to_records(table(spark, sf, name), contract), contract).select(F.lit(name).alias("table_name"), F.explode("violations").alias("code"))
        found = codes if found is None else found.unionByName(codes)
    return found.groupBy("table_name", "code").agg(F.count(F.lit(1)).alias("n"))


def manifest_roundtrip(spark, sf):
    """Whole manifests written as JSON, validated and read back, nested versions and resolution included."""
    m = table(spark, sf, "manifests")
    read = validate.validate_json(to_records(m, "MatchManifest"), "MatchManifest")
    same = F.lit(True)
    for f in contracts()["MatchManifest"]:
        now, then = F.col(f.name), F.col(f"record.{f.name}")
        if f.type == "pair":
            now = F.when(now.isNotNull(), F.struct(now["width"].alias("width"), now["height"].alias("height")))
        elif f.type in contracts():
            now, then = (F.struct(*[x[g.name].alias(g.name) for g in contracts()[f.type]]) for x in (now, then))
        same = same & now.eqNullSafe(then)
    return read.select("match_id", same.alias("same"), F.size("violations").cast("bigint").alias("n_violations"))


def _judged_lines(spark, sf):
    return validate.validate_json(table(spark, sf, "raw_records").where("record_type = 'observation'"), "Observation", "payload")


def record_codes(spark, sf):
    """Violations of the written observation records by code: missing, null, wrong type, out of range, unknown field."""
    return _judged_lines(spark, sf).select(F.explode("violations").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def accepted_records(spark, sf):
    """The valid written observation records with their defaults filled and their numbers coerced."""
    ok = validate.accepted(_judged_lines(spark, sf))
    return ok.select("observation_id", "kind", "timestamp_s", "confidence", F.size("evidence_ids").cast("bigint").alias("n_evidence"), "schema_version")


def finding_contract(spark, sf):
    """Findings as JSON records, some in other spellings, judged by the literals of the contract."""
    f = reference._findings(spark, sf).select(
        "finding_id", "match_id", F.lit(None).cast("string").alias("decision_id"), "category", "title", F.lit(None).cast("double").alias("score"),
        F.when(F.col("category") == "health", F.upper("severity")).otherwise(F.col("severity")).alias("severity"), "confidence",
        F.when(F.col("category") == "scouting", "guess").otherwise(F.col("evidence_type")).alias("evidence_type"),
        F.lit("{}").alias("metrics"), F.lit(None).cast("string").alias("explanation"), F.array().cast("array<string>").alias("evidence_ids"), F.lit(1).cast("bigint").alias("schema_version"),
    )
    codes = validate.validate_json(to_records(f, "Finding"), "Finding").select("category", F.explode("violations").alias("code"))
    return codes.where("code like 'severity%' or code like 'evidence_type%'").groupBy("category", "code").agg(F.count(F.lit(1)).alias("n"))


def schema_summary(spark, sf):
    """Introspection: fields of each contract, those that must be given and those that may be null."""
    rows = [(name, len(fields), sum(f.default is None for f in fields), sum(f.nullable for f in fields)) for name, fields in contracts().items()]
    return spark.createDataFrame(rows, "contract string, n_fields bigint, n_required bigint, n_nullable bigint")


def jsonl_log(spark, sf):
    """Observations appended to a JSONL log in two writes and read back with the contract's schema."""
    path = _scratch(spark, "jsonl")
    o = table(spark, sf, "observations").select(*schema("Observation").names)
    for part in ("confidence >= 0.7", "confidence < 0.7 or confidence is null"):
        tables.append_jsonl(o.where(part), path)
    read = tables.read_jsonl(spark, path, schema("Observation"))
    return read.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("confidence").alias("n_confidence"), F.sum(F.size("evidence_ids")).alias("n_evidence"), F.max("observation_id").alias("last_id"), F.sum(F.round(F.col("timestamp_s") * 1000).cast("bigint")).alias("total_ms"))


def parquet_by_match(spark, sf):
    """Decisions written by buckets of matches, some buckets written again, and read back."""
    path = _scratch(spark, "by-match")
    d = table(spark, sf, "decisions").select("decision_id", "match_id", "decision_type")
    tables.write_bucketed(d, path)
    again = d.withColumn("decision_type", F.upper("decision_type"))
    chosen = F.pmod(F.xxhash64("match_id"), F.lit(64)) < 8  # whole buckets are replaced
    tables.write_bucketed(again.where(chosen), path)
    read = tables.read_bucketed(spark, path, d.schema)
    return read.select(F.lower("decision_type").alias("decision_type"), "match_id").groupBy("decision_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("match_id").alias("n_matches"))


def schema_merged(spark, sf):
    """Files of two additive schema versions in one folder, read as one table."""
    path = _scratch(spark, "merged")
    m = table(spark, sf, "manifests").select("match_id", "patch")
    m.write.parquet(f"{path}/v=1")
    m.withColumn("region", F.lit("eu")).write.parquet(f"{path}/v=2")
    return tables.read_merged(spark, path).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


def perceived(spark, sf):
    """Observations recognised in binary evidence files: here lines of text that name a match and a placement."""
    path = _scratch(spark, "evidence")
    table(spark, sf, "manifests").select(F.concat_ws(" ", "match_id", F.coalesce(F.col("final_placement").cast("string"), F.lit("?")))).write.text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)

    def recognise(path: str, content: bytes) -> list[dict]:
        pairs = (line.rsplit(" ", 1) for line in content.decode().splitlines())
        return [{"match_id": m, "placement": p} for m, p in pairs]

    return detect.perceive(files, recognise, "match_id string, placement string")


def settings_gate(spark, sf):
    """Gates and switches as the settings say: floors, frames of confirmation, and a realtime switch that is off by default."""
    config = load_config({"perception": {"min_confidence": 0.9}, "tracking": {"min_event_confidence": 0.5, "temporal_confirmation_frames": 3}, "capture": {"keyframe_interval_seconds": 60}})
    o, e = table(spark, sf, "observations"), reference._events(spark, sf)
    read = gates.gate_observations(o, config.perception.min_confidence).where("value <> '{}'")
    counted = {
        "readings": read, "events": gates.gate_events(e, config.tracking.min_event_confidence),
        "keyframes": gates.keyframes(o, config.capture.keyframe_interval_seconds),
        "confirmed": gates.confirmed(reference._scenes(spark, sf), "scene", config.tracking.temporal_confirmation_frames),
        "advice": analysis.advise(reference.reduce.latest_states(table(spark, sf, "game_states")), reference._findings(spark, sf), config.realtime.enabled),
    }
    out = None
    for name, df in counted.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def counterfactual_actual(spark, sf):
    """For each sample the expected value of its action less the value of the phase that followed, by phase and action."""
    values = reference._phase_values(spark, sf)
    expected = analysis.expected_values(reference._model(spark, sf), values, "phase", "action_type", "next_phase")
    links = trajectory.phase_links(table(spark, sf, "transitions"), table(spark, sf, "game_states"))
    gaps = analysis.actual_gaps(links, expected, values, "action_type", "phase", "next_phase")
    return gaps.groupBy("phase", "action_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gap"), 4).alias("total_gap"), F.round(F.max("gap"), 6).alias("most"))


def state_percentiles(spark, sf):
    p = analysis.percentiles(table(spark, sf, "game_states").dropDuplicates(["state_id"]), "phase", [0.1, 0.5, 0.9])
    return p.select("phase", *[F.round(c, 6).alias(c) for c in p.columns[1:]])


def report_cube(spark, sf):
    return reference._findings(spark, sf).cube("category", "severity").agg(F.count(F.lit(1)).alias("n_findings"), F.grouping_id().cast("bigint").alias("level"))


def report_pivot(spark, sf):
    p = reference._findings(spark, sf).groupBy("category").pivot("severity", ["info", "minor", "major", "critical"]).agg(F.count(F.lit(1)))
    return p.select("category", *[F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in ("info", "minor", "major", "critical")])


def report_top(spark, sf):
    """The ten matches with most findings."""
    return reference._findings(spark, sf).groupBy("match_id").agg(F.count(F.lit(1)).alias("n_findings")).orderBy(F.desc("n_findings"), "match_id").limit(10)


def placement_ranks(spark, sf):
    """Rank, dense rank and quartile of the patches by the number of their matches."""
    m = table(spark, sf, "manifests").dropDuplicates(["match_id"]).groupBy("patch", "set_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("set_id").orderBy(F.desc("n"), F.asc_nulls_first("patch"))
    return m.select("set_id", "patch", "n", F.rank().over(w).cast("bigint").alias("place"), F.dense_rank().over(Window.partitionBy("set_id").orderBy(F.desc("n"))).cast("bigint").alias("level"), F.ntile(4).over(w).cast("bigint").alias("quarter"))


def rebuild_diff(spark, sf):
    """States that transitions name and that exist, and named ones that do not, as sets."""
    named = table(spark, sf, "transitions").select("state_id").union(table(spark, sf, "transitions").select(F.col("next_state_id"))).where("state_id is not null")
    known = table(spark, sf, "game_states").select("state_id")
    parts = {"both": named.intersect(known), "named_only": named.subtract(known), "known_only": known.subtract(named)}
    out = None
    for name, df in parts.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def episode_observations(spark, sf):
    """How many readings fall within each decision episode."""
    o = table(spark, sf, "observations").dropDuplicates(["observation_id"]).select("match_id", "timestamp_s")
    d = table(spark, sf, "decisions").dropDuplicates(["decision_id"]).select("match_id", "decision_id", "start_timestamp_s", "end_timestamp_s")
    return order.within(o, d, "match_id", "timestamp_s", "start_timestamp_s", "end_timestamp_s").groupBy("decision_id").agg(F.count(F.lit(1)).alias("n"))


def states_decided_on(spark, sf):
    """States before which a decision began (a semi join)."""
    s = table(spark, sf, "game_states").dropDuplicates(["state_id"])
    d = table(spark, sf, "decisions").select(F.col("state_before_id").alias("state_id"))
    return s.join(d, "state_id", "left_semi").select("state_id", "match_id", "phase")


def match_sides(spark, sf):
    """Matches by the tables they occur in (a full outer join)."""
    m = table(spark, sf, "manifests").select("match_id").distinct().withColumn("m", F.lit(1))
    d = table(spark, sf, "documents").where("match_id is not null").groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    joined = m.join(d, "match_id", "full")
    return joined.groupBy(F.col("m").isNotNull().alias("in_manifests"), F.col("n").isNotNull().alias("in_documents")).agg(F.count(F.lit(1)).alias("n_matches"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"))


def hourly_events(spark, sf):
    """Events in tumbling windows of a day and sliding ones of a week."""
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    day = e.groupBy(F.window("t", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("day"))
    week = e.groupBy(F.window("t", "7 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("week"))
    return day.unionByName(week).select("kind", F.unix_micros("w.start").alias("start_us"), "n")


def recent_gold(spark, sf):
    """Greatest gold of the match in the two minutes up to each state (a range frame, within a match's quarter of an hour and the two minutes before it)."""
    s = table(spark, sf, "game_states").where("timestamp_s >= 0 and timestamp_s < 1e12 and match_id is not null").dropDuplicates(["state_id"])
    s = s.select("match_id", "state_id", F.round(F.col("timestamp_s") * 1000).cast("bigint").alias("ms"), F.col("player.gold").alias("gold"))
    part, own = F.explode(F.array_distinct(F.array(F.floor(F.col("ms") / 900_000), F.floor((F.col("ms") + 120_000) / 900_000)))), F.floor(F.col("ms") / 900_000)
    w = Window.partitionBy("match_id", "part").orderBy("ms").rangeBetween(-120_000, 0)
    rows = s.select("*", part.alias("part")).withColumn("top", F.max("gold").over(w))
    return rows.where(F.col("part") == own).select("state_id", "top")


def learned_value(spark, sf):
    """Value of encoded states by a model that only Python has, Arrow batch by batch."""

    @F.pandas_udf("double")
    def predict(hp: pd.Series, gold: pd.Series, level: pd.Series) -> pd.Series:
        return 0.6 * hp + 0.25 * gold + 3.0 * level

    s = table(spark, sf, "game_states").dropDuplicates(["state_id"])
    known = [F.coalesce(F.col(f"player.{c}"), F.lit(0)).cast("double") for c in ("hp", "gold", "level")]
    return s.select("state_id", F.round(predict(*known), 6).alias("value"))


def session_sql(spark, sf):
    """The same tables by SQL: a view, a common table expression, a correlated subquery."""
    name = f"decisions_{uuid4().hex}"
    table(spark, sf, "decisions").dropDuplicates(["decision_id"]).createOrReplaceTempView(name)
    query = f"""
      WITH sure AS (SELECT decision_type, count(*) AS n_sure FROM {name} WHERE confidence >= 0.8 GROUP BY decision_type)
      SELECT decision_type, n_sure, (SELECT count(*) FROM {name} AS d WHERE d.decision_type = sure.decision_type) AS n_all FROM sure"""
    return spark.sql(query)


def stale_states(spark, sf):
    """States of matches whose reducer version is not the one asked for: what a rebuild reads."""
    found = lineage.rebuild_candidates(table(spark, sf, "game_states"), table(spark, sf, "manifests"), F.concat(F.lit("statefold-"), F.col("r")))
    stale = found.select("match_id", F.col("found").alias("reducer_version"))
    return table(spark, sf, "game_states").join(stale, ["match_id", "reducer_version"], "left_semi").select("match_id", "state_id").distinct()


_NAMES = """json_contract_violations manifest_roundtrip record_codes accepted_records finding_contract schema_summary jsonl_log parquet_by_match schema_merged perceived settings_gate
counterfactual_actual state_percentiles report_cube report_pivot report_top placement_ranks rebuild_diff episode_observations states_decided_on match_sides hourly_events recent_gold
learned_value session_sql stale_states""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_LINES = """
WITH p AS (SELECT row_number() OVER () AS r, CAST(payload AS JSON) AS j FROM raw_records WHERE record_type = 'observation' AND json_valid(payload)),
f AS (SELECT unnest(['observation_id', 'match_id', 'timestamp_s', 'kind', 'value', 'confidence', 'evidence_ids', 'producer_version', 'schema_version']) AS k),
x AS (SELECT r, k, list_contains(json_keys(j), k) AS given, json_type(j, '$.' || k) AS t, json_extract_string(j, '$.' || k) AS s, json_extract(j, '$.' || k) AS v FROM p, f),
n AS (SELECT *, CASE t WHEN 'BOOLEAN' THEN CASE s WHEN 'true' THEN 1.0 ELSE 0.0 END ELSE CASE WHEN t IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN try_cast(trim(s) AS DOUBLE) END END AS d FROM x),
e AS (SELECT r, CAST(unnest(CAST(v AS JSON[])) AS JSON) AS i FROM (SELECT * FROM x WHERE k = 'evidence_ids' AND t = 'ARRAY')),
c AS (
  SELECT r, 'record:json' AS code FROM (SELECT -row_number() OVER () AS r FROM raw_records WHERE record_type = 'observation' AND NOT coalesce(json_valid(payload), false))
  UNION ALL SELECT r, k || ':missing' AS code FROM n WHERE NOT given AND k NOT IN ('evidence_ids', 'schema_version')
  UNION ALL SELECT r, k || ':null' AS code FROM n WHERE given AND t = 'NULL'
  UNION ALL SELECT r, k || ':type' AS code FROM n WHERE t <> 'NULL' AND (
    (k IN ('observation_id', 'match_id', 'kind', 'producer_version') AND t <> 'VARCHAR') OR (k = 'value' AND t <> 'OBJECT') OR (k = 'evidence_ids' AND t <> 'ARRAY')
    OR (k IN ('timestamp_s', 'confidence') AND d IS NULL) OR (k = 'schema_version' AND (d IS NULL OR d <> floor(d))))
  UNION ALL SELECT r, 'kind:domain' AS code FROM n WHERE k = 'kind' AND t = 'VARCHAR'
    AND s NOT IN ('scene', 'stage', 'round', 'gold', 'hp', 'level', 'xp', 'shop', 'board', 'bench', 'inventory', 'augments', 'traits', 'opponent')
  UNION ALL SELECT r, k || ':range' AS code FROM n WHERE t <> 'NULL' AND ((k = 'timestamp_s' AND d < 0) OR (k = 'confidence' AND (d < 0 OR d > 1)) OR (k = 'schema_version' AND d = floor(d) AND d < 1))
  UNION ALL SELECT DISTINCT r, 'evidence_ids[]:null' AS code FROM e WHERE json_type(i) = 'NULL'
  UNION ALL SELECT DISTINCT r, 'evidence_ids[]:type' AS code FROM e WHERE json_type(i) NOT IN ('NULL', 'VARCHAR')
  UNION ALL SELECT r, u || ':unknown_field' AS code FROM (SELECT r, unnest(json_keys(j)) AS u FROM p) WHERE u NOT IN (SELECT k FROM f))
"""
# Fields of the contracts, with schema_version; those without a default; those that may be null.
_FIELD_COUNTS = [
    ("EvidenceRef", 8, 5, 1), ("Observation", 9, 7, 0), ("GameEvent", 10, 6, 0), ("BoardPosition", 3, 2, 0), ("UnitInstance", 7, 1, 3), ("PlayerState", 5, 0, 4), ("ShopState", 3, 0, 1),
    ("OpponentSnapshot", 6, 1, 2), ("GameState", 20, 4, 4), ("SemanticAction", 5, 2, 1), ("DecisionEpisode", 13, 7, 1), ("Finding", 13, 4, 3), ("TransitionSample", 12, 5, 3),
    ("PipelineVersions", 8, 0, 0), ("MatchManifest", 10, 2, 6),
]
_SCENE_RUNS = """
q AS (SELECT *, sum(CASE WHEN n > 1 AND scene IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY timestamp_s, observation_id ROWS UNBOUNDED PRECEDING) AS run FROM p),
z AS (SELECT row_number() OVER (PARTITION BY match_id, run ORDER BY timestamp_s, observation_id) AS place FROM q)
"""

ORACLES = {
    "json_contract_violations": f"SELECT * FROM ({sql.ORACLES['contract_violations']}) WHERE table_name <> 'game_states'",
    "manifest_roundtrip": "SELECT match_id, true AS same, CAST(0 AS BIGINT) AS n_violations FROM manifests",
    "record_codes": _LINES + "SELECT code, count(*) AS n FROM c GROUP BY code",
    "accepted_records": _LINES + """
, ok AS (SELECT r, j FROM p WHERE r NOT IN (SELECT r FROM c))
SELECT json_extract_string(j, '$.observation_id') AS observation_id, json_extract_string(j, '$.kind') AS kind, CAST(trim(json_extract_string(j, '$.timestamp_s')) AS DOUBLE) AS timestamp_s,
  CAST(trim(json_extract_string(j, '$.confidence')) AS DOUBLE) AS confidence, CAST(coalesce(json_array_length(j, '$.evidence_ids'), 0) AS BIGINT) AS n_evidence,
  coalesce(CAST(CAST(json_extract_string(j, '$.schema_version') AS DOUBLE) AS BIGINT), 1) AS schema_version FROM ok
""",
    "finding_contract": sql.FINDINGS + """
SELECT category, 'severity:domain' AS code, count(*) AS n FROM fi WHERE category = 'health' GROUP BY category
UNION ALL SELECT category, 'evidence_type:domain' AS code, count(*) AS n FROM fi WHERE category = 'scouting' GROUP BY category
""",
    "jsonl_log": """
SELECT kind, count(*) AS n, count(confidence) AS n_confidence, CAST(sum(len(evidence_ids)) AS BIGINT) AS n_evidence, max(observation_id) AS last_id, CAST(sum(CAST(round(timestamp_s * 1000) AS BIGINT)) AS BIGINT) AS total_ms
FROM observations GROUP BY kind
""",
    "parquet_by_match": "SELECT decision_type, count(*) AS n, count(DISTINCT match_id) AS n_matches FROM decisions GROUP BY decision_type",
    "schema_summary": "SELECT * FROM (VALUES " + ", ".join(f"('{name}', CAST({a} AS BIGINT), CAST({b} AS BIGINT), CAST({c} AS BIGINT))" for name, a, b, c in _FIELD_COUNTS) + ") AS t(contract, n_fields, n_required, n_nullable)",
    "schema_merged": "SELECT NULL AS region, count(*) AS n FROM manifests UNION ALL SELECT 'eu' AS region, count(*) AS n FROM manifests",
    "perceived": "SELECT match_id, coalesce(CAST(final_placement AS VARCHAR), '?') AS placement FROM manifests",
    "settings_gate": sql.SCENES + ", " + _SCENE_RUNS + ", " + sql.EVENTS.replace("WITH ", "", 1) + """
SELECT 'readings' AS stage, count(*) AS n FROM observations WHERE confidence >= CAST(0.9 AS DOUBLE) AND value <> '{}'
UNION ALL SELECT 'events' AS stage, count(*) AS n FROM ev WHERE confidence >= 0.5
UNION ALL SELECT 'keyframes' AS stage, count(*) AS n FROM (SELECT DISTINCT match_id, floor(timestamp_s / 60) AS slot FROM observations WHERE timestamp_s >= 0)
UNION ALL SELECT 'confirmed' AS stage, count(*) AS n FROM z WHERE place >= 3
UNION ALL SELECT 'advice' AS stage, CAST(0 AS BIGINT) AS n
""",
    "counterfactual_actual": sql.MODEL + f""",
v AS (SELECT phase, avg(CAST({sql.VALUE} AS DOUBLE)) AS value FROM st GROUP BY phase),
e AS (SELECT mo.phase AS phase, action_type, sum(probability * value) AS expected FROM mo JOIN v ON mo.next_phase = v.phase GROUP BY mo.phase, action_type),
l AS (SELECT a.phase AS phase, tr.action.action_type AS action_type, b.phase AS next_phase FROM tr JOIN st AS a ON tr.state_id = a.state_id JOIN st AS b ON tr.next_state_id = b.state_id)
SELECT l.phase AS phase, l.action_type AS action_type, count(*) AS n, round(sum(e.expected - v.value), 4) AS total_gap, round(max(e.expected - v.value), 6) AS most
FROM l JOIN e ON l.phase = e.phase AND l.action_type = e.action_type JOIN v ON l.next_phase = v.phase GROUP BY l.phase, l.action_type
""",
    "state_percentiles": f"WITH {sql.ONCE_STATES}, x AS (SELECT phase, CASE WHEN player.gold >= 0 THEN player.gold END AS gold, CASE WHEN player.hp >= 0 THEN player.hp END AS hp FROM st) SELECT phase, "
    + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_p{round(q * 100)}" for c in ("gold", "hp") for q in (0.1, 0.5, 0.9)) + " FROM x GROUP BY phase",
    "report_cube": sql.FINDINGS + "SELECT category, severity, count(*) AS n_findings, CAST(grouping(category, severity) AS BIGINT) AS level FROM fi GROUP BY CUBE (category, severity)",
    "report_pivot": sql.FINDINGS + "SELECT category, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS n_{s}" for s in ("info", "minor", "major", "critical")) + " FROM fi GROUP BY category",
    "report_top": sql.FINDINGS + "SELECT match_id, count(*) AS n_findings FROM fi GROUP BY match_id ORDER BY n_findings DESC, match_id LIMIT 10",
    "placement_ranks": """
WITH m AS (SELECT patch, set_id, count(DISTINCT match_id) AS n FROM manifests GROUP BY patch, set_id)
SELECT set_id, patch, n, rank() OVER w AS place, dense_rank() OVER (PARTITION BY set_id ORDER BY n DESC) AS level, ntile(4) OVER w AS quarter FROM m WINDOW w AS (PARTITION BY set_id ORDER BY n DESC, patch NULLS FIRST)
""",
    "rebuild_diff": """
WITH n AS (SELECT state_id FROM transitions UNION SELECT next_state_id FROM transitions WHERE next_state_id IS NOT NULL), k AS (SELECT DISTINCT state_id FROM game_states)
SELECT 'both' AS side, count(*) AS n FROM (SELECT state_id FROM n INTERSECT SELECT state_id FROM k)
UNION ALL SELECT 'named_only' AS side, count(*) AS n FROM (SELECT state_id FROM n WHERE state_id IS NOT NULL EXCEPT SELECT state_id FROM k)
UNION ALL SELECT 'known_only' AS side, count(*) AS n FROM (SELECT state_id FROM k EXCEPT SELECT state_id FROM n)
""",
    "episode_observations": f"""
WITH {sql.ONCE_DECISIONS}, o AS (SELECT DISTINCT observation_id, match_id, timestamp_s FROM observations)
SELECT decision_id, count(*) AS n FROM (SELECT * FROM de WHERE isfinite(start_timestamp_s) AND isfinite(end_timestamp_s)) AS d JOIN o ON o.match_id = d.match_id AND o.timestamp_s BETWEEN d.start_timestamp_s AND d.end_timestamp_s GROUP BY decision_id
""",
    "states_decided_on": f"WITH {sql.ONCE_STATES} SELECT state_id, match_id, phase FROM st WHERE EXISTS (SELECT 1 FROM decisions AS d WHERE d.state_before_id = st.state_id)",
    "match_sides": """
WITH m AS (SELECT DISTINCT match_id FROM manifests), d AS (SELECT match_id, count(*) AS n FROM documents WHERE match_id IS NOT NULL GROUP BY match_id)
SELECT m.match_id IS NOT NULL AS in_manifests, d.match_id IS NOT NULL AS in_documents, count(*) AS n_matches, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_documents FROM m FULL JOIN d ON m.match_id = d.match_id GROUP BY 1, 2
""",
    "hourly_events": """
WITH e AS (SELECT epoch_us(ts) // 86400000000 AS day FROM events)
SELECT 'day' AS kind, day * 86400000000 AS start_us, count(*) AS n FROM e GROUP BY day
UNION ALL SELECT 'week' AS kind, (day - back) * 86400000000 AS start_us, count(*) AS n FROM e, (SELECT unnest(range(7)) AS back) GROUP BY day - back
""",
    "recent_gold": f"""
WITH {sql.ONCE_STATES}, x AS (SELECT match_id, state_id, CAST(round(timestamp_s * 1000) AS BIGINT) AS ms, player.gold AS gold FROM st WHERE timestamp_s >= 0 AND timestamp_s < 1e12 AND match_id IS NOT NULL)
SELECT state_id, max(gold) OVER (PARTITION BY match_id ORDER BY ms RANGE BETWEEN 120000 PRECEDING AND CURRENT ROW) AS top FROM x
""",
    "learned_value": f"WITH {sql.ONCE_STATES} SELECT state_id, round(CAST(coalesce(player.hp, 0) * 0.6 + coalesce(player.gold, 0) * 0.25 + coalesce(player.level, 0) * 3.0 AS DOUBLE), 6) AS value FROM st",
    "session_sql": f"WITH {sql.ONCE_DECISIONS} SELECT decision_type, count(*) FILTER (WHERE confidence >= CAST(0.8 AS DOUBLE)) AS n_sure, count(*) AS n_all FROM de GROUP BY decision_type HAVING count(*) FILTER (WHERE confidence >= CAST(0.8 AS DOUBLE)) > 0",
    "stale_states": """
WITH w AS (SELECT match_id, 'statefold-' || max(versions.reducer) AS wanted FROM manifests GROUP BY match_id)
SELECT DISTINCT s.match_id AS match_id, s.state_id AS state_id FROM game_states AS s JOIN w ON s.match_id = w.match_id WHERE s.reducer_version <> w.wanted
""",
}
