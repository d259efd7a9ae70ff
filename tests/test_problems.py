"""The general data problems: brute force, round trips, held-out accuracy, and awkward inputs."""

import json
import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from matchweft.operators import drift, impute, nested, outliers, periods


@pytest.fixture(scope="module")
def states(spark, sf):
    return spark.read.parquet(f"{sf}/game_states.parquet")


@pytest.fixture(scope="module")
def observations(spark, sf):
    return spark.read.parquet(f"{sf}/observations.parquet")


# ---- 1 nested records


def test_boards_round_trip(states):
    tables = nested.flatten_boards(states)
    units = tables.units.withColumnRenamed("unit_key", "k")
    got = {}
    for r in nested.unit_occurrences(tables).join(units, F.col("unit_key") == F.col("k")).collect():
        got[r["state_id"], r["opponent_pos"], r["unit_pos"]] = (r["instance_id"], r["champion_id"], r["stars"], r["confidence"])
    want = {}
    for s in states.collect():
        for pos, board in [(-1, s["board"]), *((i, o["board"] if o else None) for i, o in enumerate(s["observed_opponents"] or []))]:
            for j, u in enumerate(board or []):
                if u:
                    want[s["state_id"], pos, j] = (u["instance_id"], u["champion_id"], u["stars"], u["confidence"])
    assert got == want


def test_equal_subtrees_are_stored_once(spark, states):
    unit = "named_struct('instance_id','u','champion_id','c','stars',1L,'position',cast(null as struct<row:bigint,col:bigint>),'items',array('A',null,'A'),'confidence',1.0D)"
    df = spark.range(4).selectExpr(
        "if(id < 2, 's0', concat('s', id)) as state_id", f"if(id = 3, null, array(null, {unit}, {unit})) as board",
        f"array(null, named_struct('player_id','p','hp',null,'level',1L,'board',array({unit}),'confidence',1.0D)) as observed_opponents", "id as unit_key", "'x' as opponent_pos",
    )
    t = nested.flatten_boards(df)
    assert (t.units.count(), t.opponents.count(), t.unit_items.count()) == (1, 1, 2)
    assert {tuple(r) for r in nested.item_occurrences(t).where("state_id = 's0'").select("opponent_pos", "unit_pos", "item_pos", "item_id").collect()} == {(-1, 1, 0, "A"), (-1, 1, 2, "A"), (-1, 2, 0, "A"), (-1, 2, 2, "A"), (1, 0, 0, "A"), (1, 0, 2, "A")}
    assert t.state_units.where("state_id = 's0'").count() == 2
    assert {r["table_name"]: r["n_rows"] for r in nested.nested_counts(t).collect()}["state_opponents"] == 3
    assert nested.item_occurrences(nested.flatten_boards(states.limit(0))).count() == 0


# ---- 2 periods


def _brute_periods(rows):
    out = {}
    for k in {r[0] for r in rows}:
        spans = sorted((round(s * 1000), round(e * 1000)) for m, s, e in rows if m == k and s is not None and e is not None and abs(s) < 1e12 and abs(e) < 1e12 and s <= e)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out[k] = merged
    found = {(k, "period", s, e) for k, m in out.items() for s, e in m}
    return found | {(k, "gap", a[1], b[0]) for k, m in out.items() for a, b in zip(m, m[1:])}


def test_periods_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b"]), (s := rng.randrange(0, 9_000_000, 500) / 1000), s + rng.choice([0, 0.001, 0.5, 3, 4000])) for _ in range(800)]
    rows += [("a", None, 1.0), ("a", 1.0, None), ("b", float("nan"), 1.0), ("b", 1.0, float("inf")), ("b", 5.0, 4.0), ("c", 1.0, 2.0), ("c", 2.0, 3.0), ("c", 3.001, 4.0), ("c", 9.0, 9.0), ("d", -2.0, -1.0), ("d", -2.0, -1.0), ("e", 1.0, 2e9)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "match_id string, s double, e double, k int")
    got = {tuple(r) for r in periods.periods_and_gaps(df, "match_id", "s", "e").collect()}
    assert got == _brute_periods(rows)
    far = spark.createDataFrame([("m", 0.0, 1e15), ("m", 5e14, 1e15 + 1), ("m", 1.2e15, 1.5e15), ("m", -1.8e15, -1.7e15)], "match_id string, s double, e double")
    ends = [(r["start_ms"], r["end_ms"]) for r in periods.continuous_periods(far, "match_id", "s", "e").orderBy("start_ms").collect()]
    assert [(a // 10**12, b // 10**12) for a, b in ends] == [(-1_800_000, -1_700_000), (0, 1_000_000), (1_200_000, 1_500_000)]
    assert periods.periods_and_gaps(spark.createDataFrame([(None, 1.0, 2.0)], "match_id string, s double, e double"), "match_id", "s", "e").count() == 0


# ---- 4 drift


def _raw(spark, files, stream="s", kind="observation"):
    rows = [(stream, i, kind, n, json.dumps(r) if not isinstance(r, (str, type(None))) else r) for i, lines in enumerate(files) for n, r in enumerate(lines)]
    return spark.createDataFrame(rows, "stream_id string, file_no bigint, record_type string, line_no bigint, payload string")


def test_changes_are_found(spark):
    files = [
        [{"match_id": f"m-{i}", "conf": 0.5 + i / 100, "player": {"hp": i, "gold": 3}, "board": [{"stars": 1}], "ids": ["ev-1"]} for i in range(9)],
        [{"ids": ["ev-2"], "game_id": f"m-{i}", "certainty": 0.6 + i / 100, "player": {"hp": i + 2.0, "gold": 4}, "board": [{"stars": 2, "mood": "x"}]} for i in range(9)],
        ["{cut", None, "[1]", {"game_id": "m-3", "certainty": "0.7", "player": {"hp": 3}, "board": [{"stars": None, "mood": "y"}, {"stars": 48.0}], "ids": "ev-1;ev-2", "frame_no": 123456}],
        [{"game_id": "m-3", "certainty": "0.7", "me": {"hp": 3}, "board": [{"stars": 2, "mood": "y"}], "ids": "ev-1"}],
    ]
    got = {tuple(r)[1:] for r in drift.schema_changes(_raw(spark, files)).collect()}
    assert got == {
        (1, "renamed", "match_id", "game_id"), (1, "renamed", "conf", "certainty"), (1, "added", "", "board[].mood"),
        (2, "retyped", "certainty", "certainty"), (2, "removed", "player.gold", ""), (2, "retyped", "ids", "ids"), (2, "added", "", "frame_no"),
        (3, "renamed", "player", "me"), (3, "removed", "frame_no", ""),
    }


def test_unlike_fields_are_no_rename(spark):
    files = [[{"a": i, "timestamp_s": 10.5 + i, "kind": "gold"} for i in range(9)], [{"a": i, "frame_no": 100000 + i, "is_replay": True} for i in range(9)]]
    got = {tuple(r)[2:] for r in drift.schema_changes(_raw(spark, files)).collect()}
    assert got == {("removed", "timestamp_s", ""), ("removed", "kind", ""), ("added", "", "frame_no"), ("added", "", "is_replay")}


def test_one_table_for_all_shapes(spark):
    files = [[{"observation_id": f"o{i}", "match_id": f"m-{i}", "confidence": 0.5, "evidence_ids": ["ev-1"], "schema_version": 1} for i in range(5)], [{"id": f"o{i}", "match_id": {"v": f"m-{i}", "src": "auto"}, "confidence": "0.5", "evidence_ids": "ev-1;ev-2", "mood": 1} for i in range(5)], ["{cut"]]
    rows = drift.unify_records(_raw(spark, files), "observation").where("file_no = 1").orderBy("line_no").collect()
    assert [(r["observation_id"], r["match_id"], r["confidence"], r["evidence_ids"], r["extra"], r["problem"]) for r in rows[:1]] == [("o0", "m-0", 0.5, '["ev-1", "ev-2"]', '{"mood": 1}', None)]
    assert drift.unify_records(_raw(spark, files), "observation").where("problem = 'unreadable'").count() == 1
    states = [
        [{"state_id": "s0", "phase": "pve", "player": {"hp": 5, "gold": 7}, "board": [{"stars": n, "items": ["A"]} for n in (2, 1, 3)], "confidence": 0.5}] * 6,
        [{"state_id": "s1", "phase": "pve", "me": {"hp": "5", "gold": {"v": 7, "src": "auto"}}, "board": [{"tier": n, "items": ["A"]} for n in (2, 1, 3)], "confidence": 0.5}] * 6,
        [{"state_id": "s2", "me": {"hp": "6", "gold": {"v": 7, "src": "auto"}}, "board": [{"tier": n, "items": ["B"]} for n in (2, 1, 3)], "confidence": 0.5}] * 6,
    ]
    rows = drift.unify_records(_raw(spark, states, kind="game_state"), "game_state").where("line_no = 0").orderBy("file_no").collect()
    assert [r["player"] for r in rows] == ['{"gold": 7, "hp": 5}', '{"gold": 7, "hp": 5.0}', '{"gold": 7, "hp": 6.0}']
    assert json.loads(rows[2]["board"])[0] == {"stars": 2, "items": ["B"]}
    assert [(r["phase"], r["extra"]) for r in rows] == [("pve", None), ("pve", None), ("unknown", None)]
    empty = _raw(spark, files).limit(0)
    assert drift.schema_changes(empty).count() == 0 and drift.unify_records(empty, "game_state").count() == 0


# ---- 5 implausible readings


def _readings(spark, rows):
    schema = "observation_id string, match_id string, timestamp_s double, kind string, value string, confidence double"
    return spark.createDataFrame([(*r, None) for r in rows], schema)


def _course(match, n=60, gain=8):
    gold, rows = 10, []
    for i in range(n):
        gold = gold + gain + i % 3 if i % 4 else max(1, gold - 20)
        rows += [(f"{match}-g{i}a", match, 30.0 * i, "gold", json.dumps({"gold": gold})), (f"{match}-g{i}b", match, 30.0 * i + 10, "gold", json.dumps({"gold": gold})), (f"{match}-r{i}", match, 30.0 * i, "round", json.dumps({"stage": 1 + i // 7, "round": 1 + i % 7}))]
        rows.append((f"{match}-h{i}", match, 30.0 * i + 5, "hp", json.dumps({"hp": 100 - i - i // 5})))
    return rows


def test_spikes_stuck_and_bounds(spark, states):
    rows = _course("m")
    value = {r[0]: json.loads(r[4]) for r in rows}
    change = {"m-g9a": {"gold": 900}, "m-h20": {"hp": 3}, "m-h30": {"hp": 640}, "m-g20a": {"gold": -4}, "m-h40": {"hp": 12.5}, "m-g13b": {"gold": "n/a"}, "m-h50": {}}
    frozen = [f"m-g{i}{x}" for i in range(30, 36) for x in "ab"]
    change |= {k: {"gold": value["m-g30a"]["gold"]} for k in frozen}
    rows = [(*r[:4], json.dumps(change[r[0]])) if r[0] in change else r for r in rows]
    rows += rows[:50] + [("late", None, 1.0, "gold", '{"gold": -1}'), ("untimed", "m", None, "hp", '{"hp": -5}'), ("nan", "m", float("nan"), "hp", '{"hp": 5}'), ("null", "m", 5.0, "gold", None), (None, "m", 6.0, "gold", '{"gold": -1}')]
    got = {(r["record_id"], r["field"], r["reason"]) for r in outliers.implausible_readings(_readings(spark, rows), states.limit(0)).collect()}
    want = {("m-g9a", "gold", "spike"), ("m-h20", "hp", "spike"), ("m-h30", "hp", "spike"), ("m-g20a", "gold", "bounds"), ("m-h40", "hp", "bounds"), ("m-g13b", "gold", "bounds"), ("late", "gold", "bounds"), ("untimed", "hp", "bounds"), (None, "gold", "bounds")}
    assert got == want | {(k, "gold", "stuck") for k in frozen[1:]}


def test_every_wide_spike_is_found(spark, states):
    rng = random.Random(5)
    level, rows, wrong = 500, [], set()
    for i in range(1400):
        level = max(50, level + rng.choice([-9, -6, -3, 4, 7, 9]))
        off = i % 9 in (4, 5) and i < 1350
        rows.append((f"g{i:04d}", "m", 5.0 * i, "gold", json.dumps({"gold": level + (3000 + i if off else 0)})))
        wrong |= {f"g{i:04d}"} if off else set()
    got = {r["record_id"] for r in outliers.implausible_readings(_readings(spark, rows), states.limit(0)).collect()}
    assert len(wrong) == 300 and got == wrong


def test_the_deviation_is_that_of_the_moves_around():
    v = np.r_[np.tile([100.0, 104.0], 80), np.tile([100.0, 180.0], 80)]
    scale = outliers.rolling_scale(v)
    assert np.allclose(scale[:60], 4 * 1.4826) and np.allclose(scale[-60:], 80 * 1.4826)
    spiked = v.copy()
    spiked[[41, 281]] = 230.0  # off by some 130 twice: much among moves of 4, little among moves of 80
    assert outliers._excursions(spiked).tolist() == [41]


def test_lasting_changes_and_other_matches_are_no_spikes(spark, states):
    rows = _course("poor") + _course("rich", gain=40)
    rows += [(f"again-{i}", "poor", 30.0 * 60 + 400 + i * 10, "hp", '{"hp": 100}') for i in range(8)]  # a new game
    assert outliers.implausible_readings(_readings(spark, rows), states.limit(0)).count() == 0
    assert outliers.implausible_readings(_readings(spark, rows).limit(0), states.limit(0)).count() == 0


def test_segments_do_not_change_the_result(spark, states, monkeypatch):
    rng = random.Random(2)
    rows = [(*r[:4], json.dumps({r[3]: rng.choice([700, 4000, 65535])})) if r[3] in ("gold", "hp") and rng.random() < 0.02 else r for r in _course("m", 900) if r[3] != "hp"]
    found = []
    for length in (3_600, 10**9):
        monkeypatch.setattr(outliers, "SEGMENT_S", length)
        found.append({tuple(r) for r in outliers.implausible_readings(_readings(spark, rows), states.limit(0)).collect()})
    assert found[0] == found[1] and len(found[0]) > 20


# ---- 6 imputation


def test_held_out_cells_come_back(spark, sf):
    states = spark.read.parquet(sf.replace("0.001", "0.01") + "/game_states.parquet").dropDuplicates(["state_id"])
    hide = F.pmod(F.xxhash64("state_id"), F.lit(10)) == 0
    player = F.struct("player.hp", F.when(~hide, F.col("player.gold")).alias("gold"), "player.level", "player.xp", "player.schema_version")
    hidden = states.withColumn("stage", F.when(~hide, F.col("stage"))).withColumn("player", F.when(F.col("player").isNotNull(), player))
    filled = impute.fill_states(hidden).withColumnsRenamed({"stage": "s2", "gold": "g2"})
    known = states.where(hide & (F.col("stage") >= 1) & (F.col("player.gold") >= 0)).select("state_id", "stage", F.col("player.gold").alias("gold"))
    rows = known.join(filled, "state_id").collect()
    usual = max({r["stage"] for r in rows}, key=[r["stage"] for r in rows].count)
    assert len(rows) > 100
    assert sum(r["stage"] == r["s2"] for r in rows) / len(rows) > 0.85 > sum(r["stage"] == usual for r in rows) / len(rows)
    middle = sorted(r["gold"] for r in rows)[len(rows) // 2]
    assert sum(abs(r["gold"] - r["g2"]) for r in rows) < 0.8 * sum(abs(r["gold"] - middle) for r in rows)


def test_every_state_is_kept_and_marked(states):
    out = impute.fill_states(states)
    assert out.count() == states.select("state_id").distinct().count()
    assert out.where("stage is null or round is null or gold is null or hp is null").count() == 0
    known = states.select("state_id", F.col("player.hp").alias("h")).where("h >= 0").distinct().join(out, "state_id")
    assert known.where("h <> hp or array_contains(filled, 'hp')").count() == 0
    assert impute.fill_states(states.limit(0)).count() == 0
    bare = states.withColumns({"stage": F.lit(None).cast("bigint"), "player": F.lit(None).cast(states.schema["player"].dataType), "timestamp_s": F.lit(None).cast("double"), "match_id": F.lit(None).cast("string")})
    assert impute.fill_states(bare).where("size(filled) >= 3 and stage = 0").count() == out.count()


# ---- extra columns


def test_further_columns_do_no_harm(spark, states, observations):
    """Columns with names that the operators use themselves."""
    names = ["segment", "field", "t", "v", "src", "own", "bad", "clock", "filled", "level", "k", "s", "e", "w", "chunk", "fields", "path", "names", "m", "u", "x", "raw"]
    extra = {n: F.lit("extra") for n in names}
    few = states.limit(60)
    bare = outliers.implausible_readings(observations.limit(300), few)
    assert outliers.implausible_readings(observations.limit(300).withColumns(extra), few.withColumns(extra)).exceptAll(bare).count() == 0
    assert impute.fill_states(few.withColumns(extra)).count() == impute.fill_states(few).count()
    assert nested.item_occurrences(nested.flatten_boards(few.withColumns(extra))).count() == nested.item_occurrences(nested.flatten_boards(few)).count()
    spans = spark.createDataFrame([("a", 1.0, 2.0)], "match_id string, start_s double, end_s double").withColumns(extra)
    assert periods.periods_and_gaps(spans, "match_id", "start_s", "end_s").count() == 1
    raw = _raw(spark, [[{"a": 1}], [{"b": "x"}]]).withColumns({n: x for n, x in extra.items()})
    assert drift.schema_changes(raw).count() == 2 and drift.unify_records(raw, "observation").count() == 2
