"""SQL counterparts of the record pipeline's queries."""

from __future__ import annotations

EVENTS = """
WITH ev AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, 'm-' || CAST(user_id AS VARCHAR) AS match_id, ts, value,
    date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) / 1000000.0 AS timestamp_s,
    CASE event_type WHEN 'click' THEN 'refresh_shop' WHEN 'purchase' THEN 'buy_unit' WHEN 'signup' THEN 'purchase_xp' WHEN 'view' THEN 'shop_changed' ELSE 'unknown' END AS event_type,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS confidence
  FROM events)
"""
ONCE_STATES = "st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY ingested_at) AS copy FROM game_states) WHERE copy = 1)"
ONCE_DECISIONS = "de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY decision_id) AS copy FROM decisions) WHERE copy = 1)"
ONCE_SAMPLES = "tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, state_id, timestamp_s ORDER BY next_state_id) AS copy FROM transitions) WHERE copy = 1)"
SCENES = """
WITH sc AS (
  SELECT DISTINCT match_id, observation_id, timestamp_s, lower(json_extract_string(value, '$.scene')) AS scene FROM observations WHERE kind = 'scene'),
p AS (SELECT *, row_number() OVER w AS n, lag(scene) OVER w AS before FROM sc WINDOW w AS (PARTITION BY match_id ORDER BY timestamp_s, observation_id))
"""
REDUCED = EVENTS + """
, r AS (
  SELECT match_id, event_id, timestamp_s,
    last_value(CASE WHEN event_type = 'buy_unit' THEN k END IGNORE NULLS) OVER w AS bought,
    last_value(CASE WHEN event_type = 'refresh_shop' THEN k END IGNORE NULLS) OVER w AS shop,
    last_value(CASE WHEN event_type = 'purchase_xp' THEN k END IGNORE NULLS) OVER w AS xp,
    CAST(sum(CASE WHEN event_type = 'buy_unit' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_events,
    min(confidence) OVER w AS confidence,
    lead(timestamp_s) OVER (PARTITION BY match_id ORDER BY timestamp_s, event_id) AS next_s
  FROM ev WHERE confidence >= 0.8
  WINDOW w AS (PARTITION BY match_id ORDER BY timestamp_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""
VALUE = "coalesce(player.hp, 0) * 0.6 + coalesce(player.gold, 0) * 0.25 + coalesce(player.level, 0) * 3.0 + coalesce(player.xp, 0) * 0.05"
FINDINGS = f"""
WITH {ONCE_STATES},
fi AS (
  SELECT state_id || ':economy' AS finding_id, match_id, 'economy' AS category, CASE WHEN player.gold >= 80 THEN 'major' ELSE 'minor' END AS severity FROM st WHERE player.gold >= 50
  UNION ALL SELECT state_id || ':health', match_id, 'health', CASE WHEN player.hp <= 10 THEN 'critical' ELSE 'major' END FROM st WHERE player.hp BETWEEN 0 AND 30
  UNION ALL SELECT state_id || ':scouting', match_id, 'scouting', 'info' FROM st WHERE len(observed_opponents) = 0)
"""
MODEL = f"""
WITH {ONCE_STATES}, {ONCE_SAMPLES},
c AS (
  SELECT a.phase AS phase, tr.action.action_type AS action_type, b.phase AS next_phase, count(*) AS n
  FROM tr JOIN st AS a ON tr.state_id = a.state_id JOIN st AS b ON tr.next_state_id = b.state_id GROUP BY 1, 2, 3),
mo AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY phase, action_type) AS probability FROM c)
"""

READINGS = """o AS (
  SELECT DISTINCT observation_id, match_id, kind, timestamp_s, confidence,
    CASE WHEN kind = 'shop' THEN coalesce(CAST(try_cast(json_extract_string(value, '$.slot') AS DECIMAL(38, 9)) AS VARCHAR), '') || '/' || coalesce(lower(json_extract_string(value, '$.champion_id')), '')
      ELSE CAST(try_cast(json_extract_string(value, '$.' || kind) AS DECIMAL(38, 9)) AS VARCHAR) END AS same
  FROM observations WHERE kind IN ('gold', 'hp', 'level', 'xp', 'shop') AND confidence >= CAST(0.7 AS DOUBLE) AND len(json_keys(CAST(value AS JSON))) > CASE WHEN json_extract_string(value, '$.ocr_score') IS NULL THEN 0 ELSE 1 END)"""


def _flat_tests() -> list[tuple[str, str, str]]:
    """(table, code, condition) for the fields of the tables themselves."""
    required = {
        "observations": "observation_id match_id timestamp_s kind value confidence evidence_ids producer_version schema_version",
        "game_states": "state_id match_id timestamp_s phase player shop board bench inventory augments active_traits observed_opponents source_event_ids confidence reducer_version schema_version",
        "decisions": "decision_id match_id decision_type start_timestamp_s end_timestamp_s state_before_id event_ids action_ids summary confidence extractor_version schema_version",
        "transitions": "match_id state_id action timestamp_s done action_mask state_confidence action_confidence schema_version",
        "manifests": "match_id started_at versions schema_version",
    }
    tests = [(t, f"{c}:null", f"{c} IS NULL") for t, names in required.items() for c in names.split()]
    least = {"game_states": {"stage": 1, "round": 1, "player.hp": 0, "player.gold": 0, "player.level": 1, "player.xp": 0, "schema_version": 1}, "transitions": {"action.schema_version": 1}}
    tests += [(t, f"{c}:range", f"{c} < {n}") for t, fields in least.items() for c, n in fields.items()]
    shares = {"observations": ["confidence"], "game_states": ["confidence"], "decisions": ["confidence"], "transitions": ["state_confidence", "action_confidence"]}
    tests += [(t, f"{c}:range", f"{c} < 0 OR {c} > 1") for t, names in shares.items() for c in names]
    seconds = {"observations": ["timestamp_s"], "game_states": ["timestamp_s"], "decisions": ["start_timestamp_s", "end_timestamp_s"], "transitions": ["timestamp_s"]}
    endless = "({c} = CAST('Infinity' AS DOUBLE) OR {c} = CAST('-Infinity' AS DOUBLE))"
    for t, names in seconds.items():
        for c in names:
            tests.append((t, f"{c}:finite", endless.format(c=c)))
            tests.append((t, f"{c}:range", f"NOT {endless.format(c=c)} AND (NOT isfinite({c}) OR {c} < 0)"))
    return tests


_IN_BOARDS = """
g AS (SELECT row_number() OVER () AS r, * FROM game_states),
o AS (SELECT r, unnest(observed_opponents) AS x FROM g),
u AS (
  SELECT r, 'board[]' AS place, unnest(board) AS x FROM g UNION ALL SELECT r, 'bench[]' AS place, unnest(bench) AS x FROM g
  UNION ALL SELECT r, 'observed_opponents[].board[]' AS place, unnest(x.board) AS x FROM o WHERE x IS NOT NULL),
i AS (
  SELECT r, place || '.items[]' AS place, unnest(x.items) AS x FROM u WHERE x IS NOT NULL
  UNION ALL SELECT r, 'inventory[]' AS place, unnest(inventory) AS x FROM g UNION ALL SELECT r, 'augments[]' AS place, unnest(augments) AS x FROM g
  UNION ALL SELECT r, 'active_traits[]' AS place, unnest(active_traits) AS x FROM g UNION ALL SELECT r, 'source_event_ids[]' AS place, unnest(source_event_ids) AS x FROM g),
b AS (
  SELECT r, place || ':null' AS code FROM u WHERE x IS NULL
  UNION SELECT r, place || ':null' AS code FROM i WHERE x IS NULL
  UNION SELECT r, place || '.instance_id:null' AS code FROM u WHERE x IS NOT NULL AND x.instance_id IS NULL
  UNION SELECT r, place || '.items:null' AS code FROM u WHERE x IS NOT NULL AND x.items IS NULL
  UNION SELECT r, place || '.confidence:null' AS code FROM u WHERE x IS NOT NULL AND x.confidence IS NULL
  UNION SELECT r, place || '.confidence:range' AS code FROM u WHERE x.confidence < 0 OR x.confidence > 1
  UNION SELECT r, place || '.stars:range' AS code FROM u WHERE x.stars < 1 OR x.stars > 4
  UNION SELECT r, place || '.position.row:range' AS code FROM u WHERE x.position.row < 0
  UNION SELECT r, place || '.position.col:range' AS code FROM u WHERE x.position.col < 0
  UNION SELECT r, 'observed_opponents[]:null' AS code FROM o WHERE x IS NULL
  UNION SELECT r, 'observed_opponents[].player_id:null' AS code FROM o WHERE x IS NOT NULL AND x.player_id IS NULL
  UNION SELECT r, 'observed_opponents[].board:null' AS code FROM o WHERE x IS NOT NULL AND x.board IS NULL
  UNION SELECT r, 'observed_opponents[].confidence:null' AS code FROM o WHERE x IS NOT NULL AND x.confidence IS NULL
  UNION SELECT r, 'observed_opponents[].hp:range' AS code FROM o WHERE x.hp < 0
  UNION SELECT r, 'observed_opponents[].level:range' AS code FROM o WHERE x.level < 1)
"""
_VIOLATIONS = (
    "WITH " + _IN_BOARDS + "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{code}' AS code, count(*) AS n FROM {t} WHERE {test}" for t, code, test in _flat_tests())
    + " UNION ALL SELECT 'transitions' AS table_name, 'final_placement:range' AS code, count(*) AS n FROM transitions WHERE final_placement < 1 OR final_placement > 8"
    + " UNION ALL SELECT 'game_states' AS table_name, code, count(*) AS n FROM b GROUP BY code) WHERE n > 0"
)
_LATEST = "la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY timestamp_s DESC, state_id DESC, ingested_at) AS pick FROM game_states) WHERE pick = 1)"

STREAMED = """
WITH x AS (SELECT 'm-' || CAST(user_id AS VARCHAR) AS match_id, event_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
g AS (SELECT match_id, k FROM (SELECT match_id, k, row_number() OVER (PARTITION BY match_id ORDER BY ts DESC, event_id DESC) AS n FROM x WHERE event_type = 'purchase') WHERE n = 1),
h AS (SELECT match_id, k FROM (SELECT match_id, k, row_number() OVER (PARTITION BY match_id ORDER BY ts DESC, event_id DESC) AS n FROM x WHERE event_type = 'view') WHERE n = 1),
c AS (SELECT match_id, count(*) AS n_events FROM x GROUP BY match_id)
"""

ORACLES = {
    "event_normalize": EVENTS + "SELECT event_id, match_id, round(timestamp_s, 6) AS timestamp_s, event_type, confidence, 'doc-' || CAST(k AS VARCHAR) AS evidence_ids FROM ev",
    "event_confidence_gate": EVENTS + "SELECT event_id, match_id, event_type, confidence FROM ev WHERE confidence >= 0.8",
    "observation_gate": "SELECT observation_id, kind, CASE WHEN confidence >= CAST(0.7 AS DOUBLE) THEN value ELSE '{}' END AS value, confidence FROM observations",
    "unknown_field_audit": """
SELECT k AS field, count(*) AS n FROM (SELECT unnest(json_keys(CAST(payload AS JSON))) AS k FROM (SELECT payload FROM raw_records WHERE record_type = 'observation' AND json_valid(payload)))
WHERE k NOT IN ('observation_id', 'match_id', 'timestamp_s', 'kind', 'value', 'confidence', 'evidence_ids', 'producer_version', 'schema_version') GROUP BY k
""",
    "nested_projection": "SELECT action.action_type AS action_type, action.legal AS legal, count(*) AS n FROM transitions GROUP BY 1, 2",
    "evidence_catalog": "SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS evidence_id, 'external_api' AS kind, sha256(text) AS sha256, coalesce(source, 'screen') AS source FROM documents",
    "evidence_duplicates": "SELECT sha256(text) AS sha256, count(*) AS n_copies, min('doc-' || CAST(doc_id AS VARCHAR)) AS kept_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "provenance_explode": """
SELECT observation_id, CAST(i AS BIGINT) AS pos, evidence_ids[i + 1] AS evidence_id
FROM (SELECT observation_id, evidence_ids, unnest(range(len(evidence_ids))) AS i FROM (SELECT DISTINCT observation_id, evidence_ids FROM observations)) WHERE evidence_ids[i + 1] IS NOT NULL
""",
    "provenance_resolved": f"""
WITH {ONCE_STATES}, {ONCE_DECISIONS}
SELECT decision_id, a.phase AS phase_before, b.phase AS phase_after FROM de LEFT JOIN st AS a ON de.state_before_id = a.state_id LEFT JOIN st AS b ON de.state_after_id = b.state_id
""",
    "provenance_dangling": """
SELECT DISTINCT match_id, state_id, next_state_id FROM transitions AS t
WHERE next_state_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM game_states AS s WHERE s.state_id = t.next_state_id)
""",
    "keyframe_periodic": """
SELECT match_id, slot, observation_id FROM (
  SELECT match_id, CAST(floor(timestamp_s / 10) AS BIGINT) AS slot, observation_id, row_number() OVER (PARTITION BY match_id, floor(timestamp_s / 10) ORDER BY timestamp_s, observation_id) AS n
  FROM observations WHERE timestamp_s >= 0) WHERE n = 1
""",
    "keyframe_daily": EVENTS + """
SELECT match_id, slot, event_id FROM (
  SELECT match_id, CAST(floor(timestamp_s / 86400) AS BIGINT) AS slot, event_id, row_number() OVER (PARTITION BY match_id, floor(timestamp_s / 86400) ORDER BY timestamp_s, event_id) AS n FROM ev) WHERE n = 1
""",
    "scene_change": SCENES + "SELECT match_id, observation_id, scene FROM p WHERE n = 1 OR scene IS DISTINCT FROM before",
    "temporal_confirmation": SCENES + "SELECT match_id, observation_id, scene FROM p WHERE n > 1 AND scene IS NOT DISTINCT FROM before",
    "first_confirmation": SCENES + """
, q AS (SELECT *, row_number() OVER w AS m, lag(scene) OVER w AS earlier FROM p WHERE n > 1 AND scene IS NOT DISTINCT FROM before WINDOW w AS (PARTITION BY match_id ORDER BY timestamp_s, observation_id))
SELECT match_id, observation_id, scene FROM q WHERE m = 1 OR scene IS DISTINCT FROM earlier
""",
    "low_confidence_evidence": """
SELECT DISTINCT match_id, evidence_id FROM (SELECT match_id, unnest(evidence_ids) AS evidence_id FROM observations WHERE confidence IS NULL OR confidence < CAST(0.7 AS DOUBLE)) WHERE evidence_id IS NOT NULL
""",
    "state_reduce_last": REDUCED + "SELECT match_id, event_id, bought, shop, xp FROM r WHERE next_s IS NULL OR next_s > timestamp_s",
    "state_reduce_count": REDUCED + "SELECT match_id, event_id, n_events, confidence FROM r WHERE next_s IS NULL OR next_s > timestamp_s",
    "state_fold_board": EVENTS + """
, u AS (SELECT match_id, k, event_type, timestamp_s, event_id FROM ev WHERE event_type IN ('buy_unit', 'purchase_xp')),
l AS (SELECT match_id, k, max(CASE WHEN event_type = 'purchase_xp' THEN event_id END) AS sold FROM u GROUP BY match_id, k)
SELECT u.match_id AS match_id, u.k AS k, count(*) AS stars FROM u JOIN l ON u.match_id = l.match_id AND u.k = l.k
WHERE u.event_type = 'buy_unit' AND (l.sold IS NULL OR u.event_id > l.sold) GROUP BY u.match_id, u.k
""",
    "state_latest": REDUCED + "SELECT match_id, event_id, bought, shop, n_events FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY timestamp_s DESC, event_id DESC) AS pick FROM r) WHERE pick = 1",
    "current_states": f"WITH {_LATEST} SELECT match_id, state_id, phase, player.gold AS gold FROM la",
    "state_asof_decision": f"""
WITH {ONCE_STATES}, {ONCE_DECISIONS},
b AS (
  SELECT match_id, start_timestamp_s AS t, 1 AS side, decision_id, NULL AS state_id FROM de WHERE isfinite(start_timestamp_s)
  UNION ALL SELECT match_id, timestamp_s, 0, NULL, state_id FROM st WHERE isfinite(timestamp_s)),
c AS (SELECT decision_id, side, last_value(state_id IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY t, side, state_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state_id FROM b)
SELECT decision_id, state_id FROM c WHERE side = 1
""",
    "episode_by_run": EVENTS + """
, n AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY match_id ORDER BY timestamp_s, event_id)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY match_id ORDER BY timestamp_s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode_no FROM n)
SELECT match_id, episode_no, event_type, count(*) AS n_events, min(event_id) AS first_id FROM g GROUP BY match_id, episode_no, event_type
""",
    "episode_rolldown": EVENTS + """
, n AS (SELECT *, CASE WHEN timestamp_s - lag(timestamp_s) OVER w < 21600 THEN 0 ELSE 1 END AS new FROM ev WHERE event_type IN ('refresh_shop', 'buy_unit', 'sell_unit') WINDOW w AS (PARTITION BY match_id ORDER BY timestamp_s, event_id)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY match_id ORDER BY timestamp_s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode_no FROM n)
SELECT match_id, episode_no, count(*) AS n_events, min(confidence) AS confidence FROM g GROUP BY match_id, episode_no
""",
    "episode_by_gap": EVENTS + """
, n AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY match_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY match_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM n)
SELECT match_id, epoch_us(min(ts)) AS started_us, count(*) AS n_events FROM g GROUP BY match_id, no
""",
    "episode_lengths": f"""
WITH {ONCE_DECISIONS}
SELECT decision_type, count(*) AS n_episodes, CAST(sum(CAST(round((end_timestamp_s - start_timestamp_s) * 1000) AS BIGINT)) AS BIGINT) AS total_ms,
  max(CAST(round((end_timestamp_s - start_timestamp_s) * 1000) AS BIGINT)) AS longest_ms, min(confidence) AS least_confidence
FROM (SELECT * FROM de WHERE isfinite(start_timestamp_s) AND isfinite(end_timestamp_s)) WHERE start_timestamp_s <= end_timestamp_s GROUP BY decision_type
""",
    "episode_actions": f"""
WITH {ONCE_DECISIONS}
SELECT decision_id, match_id, CAST(i AS BIGINT) AS action_pos, action_ids[i + 1] AS action_id FROM (SELECT decision_id, match_id, action_ids, unnest(range(len(action_ids))) AS i FROM de) WHERE action_ids[i + 1] IS NOT NULL
""",
    "episode_overlaps": f"""
WITH {ONCE_DECISIONS},
b AS (SELECT *, max(end_timestamp_s) OVER (PARTITION BY match_id ORDER BY start_timestamp_s, decision_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM de WHERE start_timestamp_s <= end_timestamp_s)
SELECT match_id, decision_id FROM b WHERE start_timestamp_s < busy
""",
    "action_projection": """
SELECT match_id, state_id, action.action_id AS action_id, action.action_type AS action_type FROM transitions
WHERE action.action_type IN ('buy_unit', 'sell_unit', 'refresh_shop', 'purchase_xp', 'equip_item', 'move_unit', 'choose_augment')
""",
    "action_mask": """
SELECT match_id, string_agg(DISTINCT action.action_type, ',' ORDER BY action.action_type) AS actions,
  CAST(sum(CASE WHEN list_contains(action_mask, action.action_type) THEN 0 ELSE 1 END) AS BIGINT) AS n_outside_mask FROM transitions GROUP BY match_id
""",
    "transition_samples": f"""
WITH {ONCE_STATES}, x AS (SELECT match_id, state_id, lead(state_id) OVER (PARTITION BY match_id ORDER BY timestamp_s, state_id) AS next_state_id FROM st)
SELECT match_id, state_id, next_state_id, next_state_id IS NULL AS done FROM x
""",
    "transition_model": MODEL + "SELECT phase, action_type, next_phase, n, round(probability, 9) AS probability FROM mo",
    "value_model": f"WITH {ONCE_STATES} SELECT state_id, round(CAST({VALUE} AS DOUBLE), 6) AS value FROM st",
    "counterfactual_gap": MODEL + f""",
v AS (SELECT phase, avg(CAST({VALUE} AS DOUBLE)) AS value FROM st GROUP BY phase),
e AS (SELECT mo.phase AS phase, action_type, sum(probability * value) AS expected FROM mo JOIN v ON mo.next_phase = v.phase GROUP BY mo.phase, action_type)
SELECT phase, action_type, round(expected, 6) AS expected, round(max(expected) OVER (PARTITION BY phase) - expected, 6) AS gap FROM e
""",
    "encoded_states": f"""
WITH {ONCE_STATES}, u AS (SELECT state_id, unnest(board) AS x FROM st), n AS (SELECT state_id, count(x.champion_id) AS n FROM u GROUP BY state_id)
SELECT st.state_id AS state_id, CAST(38 AS BIGINT) AS n_features, CAST(coalesce(n.n, 0) AS DOUBLE) AS n_units FROM st LEFT JOIN n ON st.state_id = n.state_id
""",
    "offline_dataset": f"""
WITH {ONCE_STATES}, {ONCE_SAMPLES}
SELECT tr.match_id AS match_id, tr.state_id AS state_id, tr.action.action_type AS action_type, CAST(coalesce(a.player.gold, -1) AS DOUBLE) AS gold,
  CASE WHEN b.state_id IS NULL THEN NULL ELSE CAST(coalesce(b.player.gold, -1) AS DOUBLE) END AS next_gold
FROM tr JOIN st AS a ON tr.state_id = a.state_id LEFT JOIN st AS b ON tr.next_state_id = b.state_id
""",
    "finding_statistics": f"""
WITH {ONCE_STATES}, x AS (SELECT phase, CASE WHEN player.gold >= 0 THEN player.gold END AS gold, CASE WHEN player.hp >= 0 THEN player.hp END AS hp FROM st)
SELECT phase, count(*) AS n_states, count(gold) AS n_gold, round(avg(gold), 6) AS avg_gold, round(stddev_samp(gold), 6) AS sd_gold, min(gold) AS min_gold, max(gold) AS max_gold,
  count(hp) AS n_hp, round(avg(hp), 6) AS avg_hp, round(stddev_samp(hp), 6) AS sd_hp, min(hp) AS min_hp, max(hp) AS max_hp FROM x GROUP BY phase
""",
    "finding_rules": FINDINGS + "SELECT finding_id, match_id, category, severity FROM fi",
    "report_rollup": FINDINGS + """
SELECT match_id, severity, count(*) AS n_findings, CAST(0 AS BIGINT) AS level FROM fi GROUP BY match_id, severity
UNION ALL SELECT match_id, NULL, count(*), 1 FROM fi GROUP BY match_id
UNION ALL SELECT NULL, NULL, count(*), 3 FROM fi
""",
    "manifest_build": "SELECT 'm-' || CAST(user_id AS VARCHAR) AS match_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS n_events FROM events GROUP BY user_id",
    "rebuild_candidates": """
WITH w AS (SELECT match_id, 'statefold-' || max(versions.reducer) AS wanted FROM manifests GROUP BY match_id)
SELECT s.match_id AS match_id, count(DISTINCT s.state_id) AS n_stale, s.reducer_version AS found, w.wanted AS wanted
FROM game_states AS s JOIN w ON s.match_id = w.match_id WHERE s.reducer_version <> w.wanted GROUP BY s.match_id, s.reducer_version, w.wanted
""",
    "schema_additive": "SELECT event_id, user_id, CASE WHEN event_id % 2 = 1 THEN upper(event_type) END AS label FROM events",
    "advise": FINDINGS + f""",
{_LATEST}, x AS (SELECT match_id, max(CASE severity WHEN 'critical' THEN 2 WHEN 'major' THEN 1 ELSE 0 END) AS urgency FROM fi GROUP BY match_id)
SELECT la.match_id AS match_id, la.state_id AS state_id, CASE WHEN coalesce(x.urgency, 0) >= 2 THEN 'stabilize' WHEN coalesce(la.player.gold, 0) >= 50 AND coalesce(la.player.level, 0) < 8 THEN 'level_to'
  WHEN coalesce(la.player.gold, 0) < 20 THEN 'hold_economy' ELSE 'roll_to_gold' END AS action_type
FROM la LEFT JOIN x ON la.match_id = x.match_id
""",
    "record_json_roundtrip": """
SELECT match_id, CAST(to_json({'match_id': match_id, 'patch': patch, 'set_id': set_id, 'final_placement': final_placement, 'notes': notes, 'schema_version': schema_version}) AS VARCHAR) AS text, true AS same FROM manifests
""",
    "vector_model": """
WITH x AS (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT vec_id, round(sum(CAST(embedding[i + 1] AS DOUBLE) / (1 + i)), 5) AS value FROM x GROUP BY vec_id
""",
    "detected_events": f"""
WITH {READINGS},
n AS (
  SELECT *, lag(same) OVER w AS before, lag(confidence) OVER w AS earlier, row_number() OVER w AS place FROM o
  WINDOW w AS (PARTITION BY match_id, kind ORDER BY timestamp_s, observation_id))
SELECT 'e-' || observation_id AS event_id, match_id, kind || '_changed' AS event_type, CASE WHEN earlier < confidence THEN earlier ELSE confidence END AS confidence, observation_id
FROM n WHERE place = 1 OR same IS DISTINCT FROM before
""",
    "canonical_values": """
WITH o AS (SELECT kind, coalesce(CAST(try_cast(json_extract_string(value, '$.' || kind) AS DECIMAL(38, 9)) AS VARCHAR), json_extract_string(value, '$.' || kind), '') AS same FROM observations WHERE kind IN ('gold', 'hp', 'level', 'xp'))
SELECT kind, count(DISTINCT same) AS n_values, count(*) AS n_readings FROM o GROUP BY kind
""",
    "contract_violations": _VIOLATIONS,
    "stream_states": STREAMED + "SELECT c.match_id AS match_id, g.k AS gold, h.k AS hp, c.n_events AS n_events FROM c LEFT JOIN g ON c.match_id = g.match_id LEFT JOIN h ON c.match_id = h.match_id",
    "stream_advice": STREAMED + """
SELECT c.match_id AS match_id, CASE WHEN h.k <= 20 THEN 'stabilize' WHEN g.k >= 50 THEN 'level_to' WHEN coalesce(g.k, 0) < 20 THEN 'hold_economy' ELSE 'roll_to_gold' END AS action_type
FROM c LEFT JOIN g ON c.match_id = g.match_id LEFT JOIN h ON c.match_id = h.match_id
""",
    "stream_sessions": EVENTS + """
, n AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY match_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY match_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM n),
s AS (SELECT match_id, epoch_us(min(ts)) AS started_us, count(*) AS n_events, epoch_us(max(ts)) + 21600000000 AS ends_us FROM g GROUP BY match_id, no)
SELECT match_id, started_us, n_events FROM s WHERE ends_us <= ((SELECT max(epoch_us(ts)) FROM events) // 1000 - 86400000) * 1000
""",
}
