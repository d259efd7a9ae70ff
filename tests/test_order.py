"""Order, scans, as-of and gates against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from matchweft.operators import detect, gates, lineage, order, reduce, trajectory
from matchweft.sources import tables

SCHEMA = "match_id string, timestamp_s double, event_id string, v bigint"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, float(rng.randrange(0, 30_000))] + [float(rng.randrange(0, 30_000))] * 8), f"e{i:04d}", rng.choice([None, 1, 2, 3])) for i in range(400)]
    return out + [("tie", 5.0, f"t{i}", i) for i in range(5)]


def _sorted(rows, backwards=False):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    key = lambda r: (r[1] is not None, r[1] or 0.0, r[2])
    return {k: sorted(v, key=key, reverse=backwards) for k, v in by.items()}


@pytest.mark.parametrize("backwards", [False, True])
def test_scan_equals_plain_python(spark, rows, backwards):
    df = spark.createDataFrame(rows, SCHEMA)
    v = F.col("v")
    got = order.scan(df, ["match_id"], "timestamp_s", "event_id", {"l": ("last", v), "s": ("sum", v), "c": ("count", v), "m": ("min", v), "b": ("before", v)}, backwards=backwards)
    assert got.columns == [*df.columns, "l", "s", "c", "m", "b"]
    found = {r["event_id"]: (r["l"], r["s"], r["c"], r["m"], r["b"] and (r["b"]["v"],)) for r in got.collect()}
    want = {}
    for part in _sorted(rows, backwards).values():
        seen, before = [], None
        for r in part:
            seen += [] if r[3] is None else [r[3]]
            want[r[2]] = (seen[-1] if seen else None, sum(seen) if seen else None, len(seen), min(seen) if seen else None, before)
            before = (r[3],)
    assert found == want
    assert order.scan(df.limit(0), ["match_id"], "timestamp_s", "event_id", {"l": ("last", v)}).count() == 0


def test_asof(spark):
    left = spark.createDataFrame([("a", 5.0, 1), ("a", 4000.0, 2), ("a", 0.5, 3), (None, 5.0, 4), ("a", None, 5), ("b", 9.0, 6)], "k string, t double, i int")
    right = spark.createDataFrame([("a", 1.0, "r1"), ("a", 5.0, "r2"), ("a", 5.0, "r3"), ("a", float("nan"), "r4"), (None, 1.0, "r5")], "k string, t double, id string")
    got = {r["i"]: r["id"] for r in order.asof(left, right, "k", "t", "t", "id", ["id"]).collect()}
    assert got == {1: "r3", 2: "r3", 3: None, 4: None, 5: None, 6: None}


def test_latest_takes_time_then_id(spark, rows):
    got = {r["match_id"]: r["event_id"] for r in order.latest(spark.createDataFrame(rows, SCHEMA), "match_id", "timestamp_s", "event_id").collect()}
    assert got == {k: v[-1][2] for k, v in _sorted(rows).items()}


def test_confirmation_of_more_frames(spark):
    rows = [("m", "gold", float(i * 1500), f"o{i:02d}", v) for i, v in enumerate("aabbbbabbb")] + [("m", "hp", 1.0, "h1", "b")]
    df = spark.createDataFrame(rows, "match_id string, kind string, timestamp_s double, observation_id string, x string")
    for n, want in ((2, {"o01", "o03", "o04", "o05", "o08", "o09"}), (3, {"o04", "o05", "o09"}), (4, {"o05"})):
        assert {r["observation_id"] for r in gates.confirmed(df, "x", n).collect()} == want
    assert {r["observation_id"] for r in gates.first_confirmation(df, "x", 2).collect()} == {"o01", "o03"}


def test_gates_take_nulls_and_bounds(spark):
    df = spark.createDataFrame([(0.7, "a"), (0.69, "b"), (None, "c"), (float("nan"), "d")], "confidence double, value string")
    assert [r["value"] for r in gates.gate_observations(df).collect()] == ["a", "{}", "{}", "{}"]
    assert gates.gate_events(df, 0.7).count() == 1


def test_detection_equals_the_state_it_would_hold(spark, sf):
    """Comparing with the last reading is comparing with a state that keeps last values."""
    o = spark.read.parquet(f"{sf}/observations.parquet").where("kind in ('gold', 'hp')")
    events = {r["event_id"] for r in detect.detect_events(o).collect()}
    held, want = {}, set()
    from matchweft.functions.jsonvalue import canonical_object

    seen = o.where("confidence >= 0.7").withColumn("same", canonical_object(F.col("value"), ["ocr_score"])).dropDuplicates(["observation_id"]).where("same <> ''")
    for r in sorted(seen.collect(), key=lambda r: (r["timestamp_s"], r["observation_id"])):
        key = r["match_id"], r["kind"]
        if held.get(key) != r["same"]:
            want.add("e-" + r["observation_id"])
        held[key] = r["same"]
    assert events == want


def test_folds_do_not_depend_on_row_order(spark, sf):
    from matchweft.plans.reference import _events, _reduced

    events = _events(spark, sf)
    for df in (_reduced(spark, sf), reduce.fold_board(events, "k")):
        again = df.orderBy(F.rand(3))
        assert df.exceptAll(again).count() == 0
    model = trajectory.transition_model(trajectory.phase_links(spark.read.parquet(f"{sf}/transitions.parquet"), spark.read.parquet(f"{sf}/game_states.parquet")), "phase", "action_type", "next_phase")
    assert model.groupBy("phase", "action_type").agg(F.abs(F.sum("probability") - 1).alias("x")).where("x > 1e-9").count() == 0


def test_files_round_trip(spark, sf, tmp_path):
    o = spark.read.parquet(f"{sf}/observations.parquet").drop("ingested_at")
    tables.append_jsonl(o, str(tmp_path / "o"))
    assert tables.read_jsonl(spark, str(tmp_path / "o"), o.schema).exceptAll(o).count() == 0
    d = spark.read.parquet(f"{sf}/decisions.parquet")
    tables.write_by_match(d, str(tmp_path / "d"))
    tables.write_by_match(d.where("match_id = 'm-005085076'").limit(1), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 1 + d.where("match_id <> 'm-005085076'").count()
    assert set(tables.read_merged(spark, str(tmp_path / "d")).columns) == set(d.columns)


def test_stretches_equal_a_plain_walk(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), float(rng.randrange(0, 30_000)), float(rng.randrange(0, 30_000)), 1e17]), f"e{i:04d}", rng.choice([1, 1, 2, None])) for i in range(500)]
    rows += [("calm", float(t), f"c{t}", 7) for t in range(0, 40_000, 1_000)]
    got = {r["event_id"]: (r["stretch_no"], r["stretch_place"]) for r in order.stretches(spark.createDataFrame(rows, SCHEMA), ["match_id"], "timestamp_s", "event_id", F.col("v"), order.differs).collect()}
    want, groups = {}, {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for members in groups.values():
        untimed = [r for r in members if r[1] is None]
        timed = sorted((r for r in members if r[1] is not None and r[1] == r[1]), key=lambda r: (r[1], r[2]))
        nan = sorted((r for r in members if r[1] is not None and r[1] != r[1]), key=lambda r: r[2])
        no, place, before = 0, 0, object()
        for r in [*sorted(untimed, key=lambda r: r[2]), *nan, *timed]:
            no, place = (no, place + 1) if r[3] == before else (no + 1, 1)
            before = r[3]
            want[r[2]] = (no, place)
    assert got == want
    assert order.stretches(spark.createDataFrame(rows[:0], SCHEMA), ["match_id"], "timestamp_s", "event_id", F.col("v"), order.differs).count() == 0


def test_points_within_intervals_equal_brute_force(spark):
    rng = random.Random(4)
    points = [(rng.choice("ab"), float(rng.randrange(0, 40_000)), i) for i in range(400)] + [("a", None, 900), (None, 5.0, 901), ("a", float("nan"), 902)]
    spans = [(rng.choice("ab"), float(s), float(s + rng.choice([0, 5, 60, 3_000, 30_000, 10**9])), i) for i, s in enumerate(rng.choices(range(40_000), k=60))] + [("a", 9.0, 3.0, 70), ("a", None, 3.0, 71), ("b", 0.0, 40_000.0, 72), ("b", 0.0, 40_000.0, 73)]
    got = order.within(spark.createDataFrame(points, "m string, t double, i int"), spark.createDataFrame(spans, "m string, a double, b double, j int"), "m", "t", "a", "b")
    want = {(i, j) for m, t, i in points for n, a, b, j in spans if m == n and None not in (t, a, b) and a <= t <= b}
    rows = [(r["i"], r["j"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_perception_takes_a_recogniser(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"gold")
    evidence = spark.read.format("binaryFile").load(str(tmp_path))
    got = detect.perceive(evidence, lambda path, content: [{"uri": path, "value": content.decode()}], "uri string, value string").collect()
    assert [r["value"] for r in got] == ["gold"]


def test_links_and_dangling_ids(spark):
    df = spark.createDataFrame([("a", ["x", None, "y"]), ("b", None), ("c", [])], "id string, ids array<string>")
    got = {tuple(r) for r in lineage.links(df, "id", "ids", "ref").collect()}
    assert got == {("a", 0, "x"), ("a", 2, "y")}
    assert [r["ref"] for r in lineage.dangling(lineage.links(df, "id", "ids", "ref"), "ref", spark.createDataFrame([("x",)], "t string"), "t").collect()] == ["y"]
