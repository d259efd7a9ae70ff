"""Queries of the record pipeline, over the whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.jsonvalue import canonical_object
from ..operators import analysis, detect, episodes, gates, lineage, order, reduce, trajectory, validate
from ..sources.adapters import game_events
from ..sources.tables import table

KEYFRAME_DAY_S, SESSION_S = 86_400, 21_600
#: The matches of the events table last a month, with an event every few hours.
LONG_S = 864_000


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return game_events(table(spark, sf, "events"))


def event_normalize(spark, sf):
    return _events(spark, sf).select("event_id", "match_id", F.round("timestamp_s", 6).alias("timestamp_s"), "event_type", "confidence", F.array_join("evidence_ids", ",").alias("evidence_ids"))


def event_confidence_gate(spark, sf):
    return gates.gate_events(_events(spark, sf)).select("event_id", "match_id", "event_type", "confidence")


def observation_gate(spark, sf):
    return gates.gate_observations(table(spark, sf, "observations")).select("observation_id", "kind", "value", "confidence")


def contract_violations(spark, sf):
    """Violations of every typed table by code."""
    found = None
    for name, contract in (("observations", "Observation"), ("game_states", "GameState"), ("decisions", "DecisionEpisode"), ("transitions", "TransitionSample"), ("manifests", "MatchManifest")):
        codes = validate.validate_table(table(spark, sf, name), contract).select(F.lit(name).alias("table_name"), F.explode("violations").alias("code"))
        found = codes if found is None else found.unionByName(codes)
    return found.groupBy("table_name", "code").agg(F.count(F.lit(1)).alias("n"))


def record_validation(spark, sf):
    """Written observation records with all their violations, judged from the JSON itself."""
    raw = table(spark, sf, "raw_records").where("record_type = 'observation'")
    return validate.validate_json(raw, "Observation", "payload").select("stream_id", "file_no", "line_no", F.array_join("violations", ",").alias("violations"))


def unknown_field_audit(spark, sf):
    raw = table(spark, sf, "raw_records").where("record_type = 'observation'")
    codes = validate.validate_json(raw, "Observation", "payload").select(F.explode("violations").alias("code")).where("code like '%:unknown_field'")
    return codes.groupBy(F.split("code", ":")[0].alias("field")).agg(F.count(F.lit(1)).alias("n"))


def record_json_roundtrip(spark, sf):
    """Manifests written as JSON and read back: the text, and whether both are equal."""
    m = table(spark, sf, "manifests").select("match_id", "patch", "set_id", "final_placement", "notes", "schema_version")
    both = m.withColumn("r", F.struct(*m.columns)).withColumn("text", F.to_json("r", {"ignoreNullFields": "false"}))
    return both.select("match_id", "text", F.from_json("text", both.schema["r"].dataType).eqNullSafe(F.col("r")).alias("same"))


def schema_defaults(spark, sf):
    """Introspection: every field with its default."""
    from ..contracts import contracts

    rows = [(c, f.name, f.type, f.nullable, f.default) for c, fields in contracts().items() for f in fields]
    return spark.createDataFrame(rows, "contract string, field string, type string, nullable boolean, default_json string")


def nested_projection(spark, sf):
    return table(spark, sf, "transitions").groupBy(F.col("action.action_type").alias("action_type"), F.col("action.legal").alias("legal")).agg(F.count(F.lit(1)).alias("n"))


def evidence_catalog(spark, sf):
    return lineage.evidence_catalog(table(spark, sf, "documents")).select("evidence_id", "kind", "sha256", "source")


def evidence_duplicates(spark, sf):
    return lineage.duplicate_evidence(lineage.evidence_catalog(table(spark, sf, "documents")))


def provenance_explode(spark, sf):
    links = lineage.links(table(spark, sf, "observations").dropDuplicates(["observation_id"]), "observation_id", "evidence_ids", "evidence_id")
    return links.select("observation_id", "pos", "evidence_id")


def provenance_resolved(spark, sf):
    """Decisions with the phase of the states before and after them."""
    d = table(spark, sf, "decisions").dropDuplicates(["decision_id"]).select("decision_id", "state_before_id", "state_after_id")
    phases = table(spark, sf, "game_states").dropDuplicates(["state_id"]).select("state_id", "phase")
    before = phases.select(F.col("state_id").alias("state_before_id"), F.col("phase").alias("phase_before"))
    after = phases.select(F.col("state_id").alias("state_after_id"), F.col("phase").alias("phase_after"))
    return d.join(before, "state_before_id", "left").join(after, "state_after_id", "left").select("decision_id", "phase_before", "phase_after")


def provenance_dangling(spark, sf):
    refs = table(spark, sf, "transitions").select("match_id", "state_id", "next_state_id").distinct()
    return lineage.dangling(refs, "next_state_id", table(spark, sf, "game_states"), "state_id").select("match_id", "state_id", "next_state_id")


def keyframe_periodic(spark, sf):
    return gates.keyframes(table(spark, sf, "observations")).select("match_id", "slot", "observation_id")


def keyframe_daily(spark, sf):
    return gates.keyframes(_events(spark, sf), KEYFRAME_DAY_S, id_="event_id").select("match_id", "slot", "event_id")


def _scenes(spark, sf):
    scenes = table(spark, sf, "observations").where("kind = 'scene'").dropDuplicates(["observation_id"])
    return scenes.withColumn("scene", F.lower(F.get_json_object("value", "$.scene")))


def scene_change(spark, sf):
    return gates.changes(_scenes(spark, sf), "scene").select("match_id", "observation_id", "scene")


def temporal_confirmation(spark, sf):
    return gates.confirmed(_scenes(spark, sf), "scene", 2).select("match_id", "observation_id", "scene")


def first_confirmation(spark, sf):
    return gates.first_confirmation(_scenes(spark, sf), "scene", 2).select("match_id", "observation_id", "scene")


def low_confidence_evidence(spark, sf):
    return gates.rejected_evidence(table(spark, sf, "observations"))


def detected_events(spark, sf):
    events = detect.detect_events(table(spark, sf, "observations"))
    return events.select("event_id", "match_id", "event_type", "confidence", F.element_at("observation_ids", 1).alias("observation_id"))


def _reduced(spark, sf):
    events = gates.gate_events(_events(spark, sf))
    return reduce.reduce_states(events, {"bought": ("buy_unit", F.col("k")), "shop": ("refresh_shop", F.col("k")), "xp": ("purchase_xp", F.col("k"))}, count_of="buy_unit", chunk_s=LONG_S)


def state_reduce_last(spark, sf):
    return _reduced(spark, sf).select("match_id", "event_id", "bought", "shop", "xp")


def state_reduce_count(spark, sf):
    return _reduced(spark, sf).select("match_id", "event_id", "n_events", "confidence")


def state_fold_board(spark, sf):
    events = _events(spark, sf).withColumn("event_type", F.when(F.col("event_type") == "purchase_xp", "sell_unit").otherwise(F.col("event_type")))
    return reduce.fold_board(events, "k").select("match_id", F.col("unit").alias("k"), "stars")


def state_latest(spark, sf):
    """The flagship: events, validated, gated, folded to states, and the current state of each match."""
    valid = validate.validate_table(_events(spark, sf), "GameEvent").where(F.size("violations") == 0)
    states = reduce.reduce_states(gates.gate_events(valid), {"bought": ("buy_unit", F.col("k")), "shop": ("refresh_shop", F.col("k"))}, count_of="buy_unit", chunk_s=LONG_S)
    return order.latest(states, "match_id", "timestamp_s", "event_id").select("match_id", "event_id", "bought", "shop", "n_events")


def current_states(spark, sf):
    s = reduce.latest_states(table(spark, sf, "game_states"))
    return s.select("match_id", "state_id", "phase", F.col("player.gold").alias("gold"))


def state_asof_decision(spark, sf):
    """The state in force when a decision starts."""
    d = table(spark, sf, "decisions").dropDuplicates(["decision_id"]).where("abs(start_timestamp_s) < 1e15").select("decision_id", "match_id", "start_timestamp_s")
    s = table(spark, sf, "game_states").dropDuplicates(["state_id"])
    return order.asof(d, s, "match_id", "start_timestamp_s", "timestamp_s", "state_id", ["state_id"]).select("decision_id", "state_id")


def episode_by_run(spark, sf):
    return episodes.episodes_by_run(_events(spark, sf), chunk_s=LONG_S).select("match_id", F.col("episode_no").cast("bigint").alias("episode_no"), "event_type", "n_events", "first_id")


def episode_rolldown(spark, sf):
    return episodes.rolldowns(_events(spark, sf), SESSION_S, LONG_S).select("match_id", F.col("episode_no").cast("bigint").alias("episode_no"), "n_events", "confidence")


def episode_by_gap(spark, sf):
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return episodes.sessions(e, "ts", "6 hours").select("match_id", F.unix_micros("started").alias("started_us"), "n_events")


def episode_lengths(spark, sf):
    return episodes.episode_lengths(table(spark, sf, "decisions"))


def episode_actions(spark, sf):
    return episodes.actions_of_episodes(table(spark, sf, "decisions"))


def episode_overlaps(spark, sf):
    return episodes.overlapping_episodes(table(spark, sf, "decisions"))


def action_projection(spark, sf):
    return trajectory.atomic_actions(table(spark, sf, "transitions")).select("match_id", "state_id", F.col("action.action_id").alias("action_id"), F.col("action.action_type").alias("action_type"))


def action_mask(spark, sf):
    return trajectory.action_masks(table(spark, sf, "transitions"))


def transition_samples(spark, sf):
    return trajectory.transition_links(table(spark, sf, "game_states")).select("match_id", "state_id", "next_state_id", "done")


def _model(spark, sf):
    links = trajectory.phase_links(table(spark, sf, "transitions"), table(spark, sf, "game_states"))
    return trajectory.transition_model(links, "phase", "action_type", "next_phase")


def transition_model(spark, sf):
    return _model(spark, sf).select("phase", "action_type", "next_phase", "n", F.round("probability", 9).alias("probability"))


def value_model(spark, sf):
    s = table(spark, sf, "game_states").dropDuplicates(["state_id"])
    return s.select("state_id", F.round(analysis.state_value(), 6).alias("value"))


def vector_model(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(analysis.vector_value("embedding", [1.0 / (1 + i) for i in range(64)]), 5).alias("value"))


def _phase_values(spark, sf):
    s = table(spark, sf, "game_states").dropDuplicates(["state_id"])
    return s.groupBy("phase").agg(F.avg(analysis.state_value()).alias("value"))


def counterfactual_gap(spark, sf):
    expected = analysis.expected_values(_model(spark, sf), _phase_values(spark, sf), "phase", "action_type", "next_phase")
    return analysis.counterfactual_gaps(expected, "phase", "action_type").select("phase", "action_type", F.round("expected", 6).alias("expected"), F.round("gap", 6).alias("gap"))


def encoded_states(spark, sf):
    s = trajectory.encode_states(table(spark, sf, "game_states").dropDuplicates(["state_id"]))
    return s.select("state_id", F.size("features").cast("bigint").alias("n_features"), F.aggregate(F.slice("features", 7, 1000), F.lit(0.0), lambda a, x: a + x).alias("n_units"))


def offline_dataset(spark, sf):
    rows = trajectory.dataset(table(spark, sf, "transitions").dropDuplicates(["match_id", "state_id", "timestamp_s"]), table(spark, sf, "game_states"))
    return rows.select("match_id", "state_id", F.col("action.action_type").alias("action_type"), F.get("features", F.lit(3)).cast("double").alias("gold"), F.get("next_features", F.lit(3)).cast("double").alias("next_gold"))


def finding_statistics(spark, sf):
    s = analysis.state_statistics(table(spark, sf, "game_states").dropDuplicates(["state_id"]))
    return s.select("phase", "n_states", *[c for x in ("gold", "hp") for c in (f"n_{x}", F.round(f"avg_{x}", 6).alias(f"avg_{x}"), F.round(f"sd_{x}", 6).alias(f"sd_{x}"), f"min_{x}", f"max_{x}")])


def _findings(spark, sf):
    gold, hp = F.col("player.gold"), F.col("player.hp")
    rules = [
        ("economy", "gold not put to use", gold >= 50, F.when(gold >= 80, "major").otherwise("minor")),
        ("health", "low health", hp.between(0, 30), F.when(hp <= 10, "critical").otherwise("major")),
        ("scouting", "no opponent seen", F.coalesce(F.size("observed_opponents") == 0, F.lit(False)), F.lit("info")),
    ]
    return analysis.rule_findings(table(spark, sf, "game_states").dropDuplicates(["state_id"]), rules)


def finding_rules(spark, sf):
    return _findings(spark, sf).select("finding_id", "match_id", "category", "severity")


def report_rollup(spark, sf):
    return analysis.report(_findings(spark, sf))


def manifest_build(spark, sf):
    """Manifests derived from the event log."""
    e = _events(spark, sf)
    return e.groupBy("match_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("n_events")).select("match_id", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_us"), F.unix_micros(F.col("ended_at").cast("timestamp")).alias("ended_us"), "n_events")


def rebuild_candidates(spark, sf):
    return lineage.rebuild_candidates(table(spark, sf, "game_states"), table(spark, sf, "manifests"), F.concat(F.lit("statefold-"), F.col("r")))


def schema_additive(spark, sf):
    """Two versions of the event table, the newer with one field more, as one."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    newer = table(spark, sf, "events").select("event_id", "user_id", F.upper("event_type").alias("label"))
    return lineage.evolve(e.where("event_id % 2 = 0"), newer.where("event_id % 2 = 1"))


def advise(spark, sf):
    return analysis.advise(reduce.latest_states(table(spark, sf, "game_states")), _findings(spark, sf), enabled=True)


def canonical_values(spark, sf):
    """Readings by their canonical value."""
    o = table(spark, sf, "observations").where("kind in ('gold', 'hp', 'level', 'xp')")
    return o.groupBy("kind", canonical_object(F.col("value"), ["ocr_score"]).alias("same")).agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_readings"))


def _event_stream(spark, sf):
    """The event log as a stream of gold and hp changes, and a new folder for what it writes."""
    from uuid import uuid4

    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid4().hex}"
    log = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet(sf)
    kind = F.when(F.col("event_type") == "purchase", "gold_changed").when(F.col("event_type") == "view", "hp_changed").otherwise("unknown")
    rows = log.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), F.concat(F.lit("m-"), F.col("user_id").cast("string")).alias("match_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp_s"), kind.alias("event_type"), F.get_json_object("props", "$.k").cast("bigint").alias("value"),
    )
    return rows, folder


def stream_states(spark, sf):
    """The current state of every match from the event log read as a stream, run to its end; equals the batch over the same log."""
    from ..streaming import events as st

    rows, folder = _event_stream(spark, sf)
    st.run_to_end(st.latest_states(st.deduplicated(st.with_event_time(rows, "1 hour"))), f"{folder}/out", f"{folder}/log", "update")
    written = spark.read.parquet(f"{folder}/out/*")
    return written.groupBy("match_id").agg(F.max_by(F.struct("gold", "hp", "n_events"), "batch").alias("s")).select("match_id", "s.gold", "s.hp", "s.n_events")


def stream_sessions(spark, sf):
    """Sessions of every match that a stream has closed: those whose gap ends before the watermark, a day behind the last event."""
    from ..streaming import events as st

    rows, folder = _event_stream(spark, sf)
    st.run_to_end(st.session_counts(st.with_event_time(rows, "1 day")), f"{folder}/out", f"{folder}/log")
    return spark.read.parquet(f"{folder}/out").select("match_id", F.unix_micros("session_window.start").alias("started_us"), "n_events")


def stream_advice(spark, sf):
    """Advice from current states as they stream by; the last one of each match."""
    from ..streaming import events as st

    rows, folder = _event_stream(spark, sf)
    st.run_to_end(st.advise_stream(st.latest_states(st.with_event_time(rows, "1 hour")), True), f"{folder}/out", f"{folder}/log", "update")
    written = spark.read.parquet(f"{folder}/out/*")
    return written.groupBy("match_id").agg(F.max_by("action_type", "batch").alias("action_type"))


_NAMES = """event_normalize event_confidence_gate observation_gate contract_violations record_validation unknown_field_audit record_json_roundtrip schema_defaults
nested_projection evidence_catalog evidence_duplicates provenance_explode provenance_resolved provenance_dangling keyframe_periodic keyframe_daily scene_change
temporal_confirmation first_confirmation low_confidence_evidence detected_events state_reduce_last state_reduce_count state_fold_board state_latest current_states
state_asof_decision episode_by_run episode_rolldown episode_by_gap episode_lengths episode_actions episode_overlaps action_projection action_mask transition_samples
transition_model value_model vector_model counterfactual_gap encoded_states offline_dataset finding_statistics finding_rules report_rollup manifest_build
rebuild_candidates schema_additive advise canonical_values stream_states stream_sessions stream_advice""".split()
QUERIES = {name: globals()[name] for name in _NAMES}
