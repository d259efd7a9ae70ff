"""Contracts, validation (one case for each rejection), settings and banner."""

import json

import pytest
from pyspark.sql import functions as F

from matchweft import app
from matchweft.config import load_config
from matchweft.contracts import DOMAINS, contracts, default_of, schema
from matchweft.operators.validate import accepted, quarantined, validate_json, validate_table

EVENT = {"event_id": "event-1", "match_id": "m-1", "timestamp_s": 11.0, "event_type": "refresh_shop", "payload": {"gold_cost": 2}, "confidence": 0.99, "producer_version": "event-engine-0.1.0"}
STATE = {"state_id": "state-1", "match_id": "m-1", "timestamp_s": 11.0, "player": {"hp": 100, "gold": 48, "level": 4, "xp": 0}, "shop": {"slots": list("ABCDE")}, "source_event_ids": ["event-1"], "reducer_version": "state-reducer-0.1.0"}
SAMPLE = {"match_id": "m-1", "state_id": "state-1", "action": {"action_id": "action-1", "action_type": "refresh_shop", "legal": True}, "next_state_id": "state-2", "timestamp_s": 11.0, "action_mask": ["refresh_shop", "purchase_xp"]}
MANIFEST = {"match_id": "m-1", "started_at": "2024-01-01T00:00:00Z", "patch": "test", "set_id": "test-set"}
OBSERVATION = {"observation_id": "obs-1", "match_id": "m-1", "timestamp_s": 10.0, "kind": "shop", "value": {"slot": 0, "champion_id": "TEST_Unit"}, "confidence": 0.98, "evidence_ids": ["ev-1"], "producer_version": "shop-recognizer-0.1.0"}


def _unit(**more):
    return [{"instance_id": "u", **more}]


CASES = [
    ("GameEvent", EVENT, {}, []),
    ("GameEvent", EVENT, {"confidence": 1.0000001}, ["confidence:range"]),
    ("GameEvent", EVENT, {"confidence": -0.1}, ["confidence:range"]),
    ("GameEvent", EVENT, {"confidence": "NaN"}, ["confidence:range"]),
    ("GameEvent", EVENT, {"timestamp_s": "NaN"}, ["timestamp_s:range"]),
    ("GameEvent", EVENT, {"timestamp_s": -1}, ["timestamp_s:range"]),
    ("GameEvent", EVENT, {"timestamp_s": "Infinity"}, ["timestamp_s:finite"]),
    ("GameEvent", EVENT, {"confidence": ...}, ["confidence:missing"]),
    ("GameEvent", EVENT, {"confidence": None}, ["confidence:null"]),
    ("GameEvent", EVENT, {"event_type": "BUY_UNIT"}, ["event_type:domain"]),
    ("GameEvent", EVENT, {"event_type": "click"}, ["event_type:domain"]),
    ("GameEvent", EVENT, {"mood": 1}, ["mood:unknown_field"]),
    ("GameEvent", EVENT, {"payload": None}, ["payload:null"]),
    ("GameEvent", EVENT, {"payload": [1]}, ["payload:type"]),
    ("GameEvent", EVENT, {"evidence_ids": ["a", None]}, ["evidence_ids[]:null"]),
    ("GameEvent", EVENT, {"match_id": 1}, ["match_id:type"]),
    ("GameEvent", EVENT, {"match_id": ""}, []),
    ("GameEvent", EVENT, {"schema_version": 0}, ["schema_version:range"]),
    ("GameEvent", EVENT, {"schema_version": 7}, []),
    ("GameState", STATE, {}, []),
    ("GameState", STATE, {"player": {"hp": 1, "mana": 2}}, ["player.mana:unknown_field"]),
    ("GameState", STATE, {"player": {"gold": "48"}}, []),
    ("GameState", STATE, {"player": {"gold": 48.0}}, []),
    ("GameState", STATE, {"player": {"gold": 48.5}}, ["player.gold:type"]),
    ("GameState", STATE, {"player": {"gold": -1}}, ["player.gold:range"]),
    ("GameState", STATE, {"player": {"gold": 9223372036854775808}}, ["player.gold:type"]),
    ("GameState", STATE, {"player": None}, ["player:null"]),
    ("GameState", STATE, {"shop": {"slots": ["A", None], "locked": "yes"}}, []),
    ("GameState", STATE, {"shop": {"locked": 2}}, ["shop.locked:type"]),
    ("GameState", STATE, {"board": _unit(items=["A", None])}, ["board[].items[]:null"]),
    ("GameState", STATE, {"board": _unit(stars=5)}, ["board[].stars:range"]),
    ("GameState", STATE, {"board": _unit(position={"row": -1, "col": 0})}, ["board[].position.row:range"]),
    ("GameState", STATE, {"board": [None]}, ["board[]:null"]),
    ("GameState", STATE, {"observed_opponents": [{"player_id": "p", "board": _unit(z=1)}]}, ["observed_opponents[].board[].z:unknown_field"]),
    ("TransitionSample", SAMPLE, {}, []),
    ("TransitionSample", SAMPLE, {"next_state_id": ...}, ["next_state_id:missing"]),
    ("TransitionSample", SAMPLE, {"next_state_id": None}, []),
    ("TransitionSample", SAMPLE, {"final_placement": 9}, ["final_placement:range"]),
    ("MatchManifest", MANIFEST, {"final_placement": 9}, []),
    ("MatchManifest", MANIFEST, {"client_resolution": [1, 2, 3]}, ["client_resolution:arity"]),
    ("MatchManifest", MANIFEST, {"client_resolution": [1920, 1080]}, []),
    ("MatchManifest", MANIFEST, {"started_at": 1700000000}, ["started_at:type"]),
    ("MatchManifest", MANIFEST, {"started_at": "2024-01-01"}, []),
]


def test_every_rejection(spark):
    for contract in {c[0] for c in CASES}:
        mine = [(i, json.dumps({k: v for k, v in (base | change).items() if v is not ...})) for i, (c, base, change, _) in enumerate(CASES) if c == contract]
        got = validate_json(spark.createDataFrame(mine, "i int, json string"), contract).select("i", "violations").collect()
        for row in got:
            assert row["violations"] == CASES[row["i"]][3], CASES[row["i"]]


def test_unreadable_texts_are_quarantined(spark):
    texts = ["{bad", None, "", '{"a":1,"a":2}', "[1]", json.dumps(EVENT)]
    out = validate_json(spark.createDataFrame([(x,) for x in texts], "json string"), "GameEvent")
    assert [r["violations"][:1] for r in out.collect()] == [["record:json"]] * 4 + [["record:type"], []]
    assert accepted(out).count() == 1 and quarantined(out).count() == 5
    with pytest.raises(Exception, match="invalid record"):
        validate_json(spark.createDataFrame([("[1]",)], "json string"), "GameEvent", mode="failfast").collect()


def test_defaults_and_links(spark):
    state, sample, observation = (validate_json(spark.createDataFrame([(json.dumps(x),)], "json string"), c).first()["record"] for c, x in (("GameState", STATE), ("TransitionSample", SAMPLE), ("Observation", OBSERVATION)))
    assert (state["phase"], state["confidence"], state["shop"]["locked"], state["board"], state["schema_version"]) == ("unknown", 1.0, None, [], 1)
    assert sample["action"]["action_type"] == "refresh_shop" and sample["done"] is False and sample["action"]["params"] == "{}"
    assert observation["evidence_ids"] == ["ev-1"]


def test_manifest_round_trip(spark):
    once = accepted(validate_json(spark.createDataFrame([(json.dumps(MANIFEST),)], "json string"), "MatchManifest"))
    assert once.first()["versions"]["reducer"] == "0.1.0"
    text = once.withColumn("client_resolution", F.lit(None).cast("array<bigint>")).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
    again = accepted(validate_json(text, "MatchManifest"))
    assert again.collect() == once.collect()


def test_typed_tables(spark, sf):
    rows = validate_table(spark.read.parquet(f"{sf}/observations.parquet"), "Observation")
    assert rows.where("size(violations) > 0").count() == rows.where("confidence is null").count()
    assert validate_table(spark.read.parquet(f"{sf}/game_states.parquet").limit(0), "GameState").count() == 0


def test_contracts_are_complete():
    assert len(contracts()) == 15
    assert sum(len(DOMAINS[d]) for d in ("GamePhase", "EvidenceKind", "ObservationKind", "EventType", "ActionType", "DecisionType")) == 66
    assert default_of("GameState", "schema_version") == 1
    assert not schema("GameEvent")["confidence"].nullable and schema("TransitionSample")["next_state_id"].nullable


def test_settings(tmp_path, capsys):
    assert load_config().perception.min_confidence == 0.70 and not load_config().realtime.enabled
    assert load_config({"tracking": {"min_event_confidence": 0.9}}).tracking.min_event_confidence == 0.9
    for bad in ({"tracking": {"x": 1}}, {"schema_version": 2}):
        with pytest.raises(ValueError):
            load_config(bad)
    app.main()
    assert capsys.readouterr().out.count("\n") == 4
