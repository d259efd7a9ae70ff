"""A stream gives what a batch over the accepted rows gives."""

import json
import os

import pytest

from matchweft.streaming import events as st


def _write(folder, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        file = folder / f"{i:03d}.json"
        file.write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in order of time
    return str(folder)


def _event(i, t, kind="gold_changed", value=1, match="m"):
    return {"event_id": f"e{i}", "match_id": match, "timestamp_s": t, "event_type": kind, "value": value, "confidence": 0.9}


BATCHES = [
    [_event(1, 10.0, value=5), _event(2, 20.0, "hp_changed", 90), _event(1, 10.0, value=5)],
    [_event(4, 900.0, value=40), _event(3, 15.0, value=7), _event(5, 30.0, value=1, match="n")],
    [_event(6, 5000.0, value=50)],
]


@pytest.fixture()
def log(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    return st.read_log(spark, _write(tmp_path / "log", BATCHES), files_per_batch=1)


def test_latest_state_ignores_arrival_order_and_copies(spark, log, tmp_path):
    stream = st.latest_states(st.deduplicated(st.with_event_time(log, "2 hours")))
    st.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    rows = spark.read.parquet(str(tmp_path / "out/*")).orderBy("batch").collect()
    last = {r["match_id"]: (r["gold"], r["hp"], r["n_events"]) for r in rows}
    assert last == {"m": (50, 90, 5), "n": (1, None, 1)}


def test_ordered_states_equal_the_batch_fold(spark, log, tmp_path):
    stream = st.ordered_states(st.deduplicated(st.with_event_time(log, "20 minutes")))
    st.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out")).where("match_id = 'm'").orderBy("n_events").collect()
    assert [(r["event_id"], r["gold"], r["hp"], r["n_events"]) for r in rows] == [("e1", 5, None, 1), ("e3", 7, None, 2), ("e2", 7, 90, 3), ("e4", 40, 90, 4)]


def test_changed_readings(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    rows = [[{"match_id": "m", "kind": "gold", "timestamp_s": t, "observation_id": f"o{i}", "same": v}] for i, (t, v) in enumerate([(1.0, "a"), (3.0, "b"), (2.0, "a"), (4.0, "b"), (9999.0, "c")])]
    log = st.read_log(spark, _write(tmp_path / "log", rows), "match_id string, kind string, timestamp_s double, observation_id string, same string", 1)
    st.run_to_end(st.changed_readings(st.with_event_time(log, "20 minutes")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r["observation_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"o0", "o1"}


def test_sessions_and_advice(spark, log, tmp_path):
    timed = st.with_event_time(log, "1 minute")
    st.run_to_end(st.session_counts(timed, "5 minutes"), str(tmp_path / "s"), str(tmp_path / "cs"))
    assert {(r["match_id"], r["n_events"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()} >= {("n", 1)}
    for enabled, n in ((True, 2), (False, 0)):
        advice = st.advise_stream(st.latest_states(st.with_event_time(log)), enabled)
        st.run_to_end(advice, str(tmp_path / f"a{enabled}"), str(tmp_path / f"c{enabled}"), "update")
        assert spark.read.parquet(str(tmp_path / f"a{enabled}/*")).select("match_id").distinct().count() == n
