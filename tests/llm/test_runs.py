"""Runs: brute force, exact segmentation on small sequences, awkward inputs."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweft.llm import runs
from matchweft.llm.queries import ORACLES, QUERIES
from tests.parity import difference


def _cost(codes, penalty):
    return sum(len(list(g)) - max(map(list(g).count, g)) for g in codes) + penalty * (len(codes) - 1)


def _best_equal(codes, penalty):
    n = len(codes)
    options = []
    for cuts in itertools.product([0, 1], repeat=n - 1):
        starts = [0, *(i + 1 for i, c in enumerate(cuts) if c)]
        options.append(_cost([codes[a:b] for a, b in zip(starts, [*starts[1:], n])], penalty))
    return min(options)


@pytest.mark.parametrize("penalty", [0.1, 0.25, 0.49, 1.0, 2.5])
def test_dynamic_programming_is_optimal(penalty):
    rng = random.Random(3)
    for _ in range(60):
        codes = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
        starts = runs.segment_equal(codes, [1] * len(codes), penalty)
        got = _cost([codes[a:b] for a, b in zip(starts, [*starts[1:], len(codes)])], penalty)
        assert got == pytest.approx(_best_equal(codes, penalty))
        if penalty < 0.5:
            assert starts == [i for i, c in enumerate(codes) if not i or codes[i - 1] != c]


def test_numeric_segmentation_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(40):
        x = (np.repeat(rng.integers(0, 4, 4), 2) * 5.0 + rng.normal(0, 0.3, 8))[: rng.integers(1, 9)]
        starts = runs.segment_numeric(np.ones(len(x)), x, x * x, 2.0)

        def cost(s):
            return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(s, [*s[1:], len(x)])) + 2.0 * (len(s) - 1)

        every = ([0, *(i + 1 for i, c in enumerate(cuts) if c)] for cuts in itertools.product([0, 1], repeat=len(x) - 1))
        assert cost(starts) == pytest.approx(min(map(cost, every)))


def _events(spark, rows):
    return spark.createDataFrame(rows, "match_id string, kind string, timestamp_s double, observation_id string, value string, chunk int")


def _brute(rows):
    out = set()
    seen = {}
    for m, k, t, i, v, _ in {r for r in rows if None not in r[:3] and np.isfinite(r[2])}:
        seen.setdefault((m, k), []).append((t, i, v))
    for key, x in seen.items():
        x.sort()
        for _, g in itertools.groupby(x, key=lambda r: r[2]):
            g = list(g)
            out.add((*key, g[0][1], g[-1][1], len(g)))
    return out


def test_runs_cross_chunks_and_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b"]), rng.choice(["gold", "hp"]), float(rng.randrange(0, 20_000)), f"o{i:05d}", rng.choice(["x", "y"]) if rng.random() < 0.9 else None, 0) for i in range(3000)]
    rows += [("long", "gold", float(t), f"l{t:06d}", "x", 0) for t in range(0, 40_000, 100)]
    rows += rows[:200]
    rows += [(None, "gold", 1.0, "n1", "x", 0), ("a", None, 1.0, "n2", "x", 0), ("a", "gold", None, "n3", "x", 0), ("a", "gold", float("nan"), "n4", "x", 0)]
    got = runs.collapse_runs(_events(spark, rows), ["match_id", "kind"], "timestamp_s", "observation_id", "value")
    assert {(r["match_id"], r["kind"], r["first_id"], r["last_id"], r["n"]) for r in got.collect()} == _brute(rows)
    assert got.where("match_id = 'long'").first()["duration"] == 39_900.0
    assert runs.collapse_runs(_events(spark, rows).limit(0), ["match_id", "kind"], "timestamp_s", "observation_id", "value").count() == 0


def test_spellings_of_one_value(spark):
    same = ['{"slot": 1, "champion_id": "SET0_X"}', '{"champion_id":"set0_x","slot":1.0}', '{"slot":"1","champion_id":"SET0_X","ocr_score":0.4}', '{ "slot" : 1e0 , "champion_id" : " SET0_X " }']
    other = ["{}", '{"ocr_score": 0.9}', '{"slot": null}', '{"slot": 0}', None, "{cut", "{cut", json.dumps({"slot": "a" * 100_000})]
    rows = [("m", "shop", float(i), f"o{i:02d}", v, 0) for i, v in enumerate(same + other)]
    got = runs.observation_runs(_events(spark, rows)).orderBy("first_t").collect()
    assert [r["n"] for r in got] == [4, 2, 1, 1, 1, 2, 1]


def test_near_identical_numbers(spark):
    rows = [("m", "gold", float(i), f"o{i:03d}", None, 0) for i in range(60)]
    df = _events(spark, rows).withColumn("x", F.when(F.col("timestamp_s") < 30, 10.0).otherwise(50.0) + F.pmod(F.xxhash64("observation_id"), F.lit(3)) / 10)
    got = runs.collapse_runs(df, ["match_id"], "timestamp_s", "observation_id", "value", number="x", penalty=5.0).orderBy("first_t").collect()
    assert [(r["first_id"], r["n"]) for r in got] == [("o000", 30), ("o030", 30)]
    with pytest.raises(ValueError):
        runs.collapse_runs(df, ["match_id"], "timestamp_s", "observation_id", "value", penalty=0.6)


def _numeric(spark, values, step_s):
    rows = [("m", "gold", 10.0 + step_s * i, f"o{i:05d}", str(x), 0) for i, x in enumerate(values)]
    return _events(spark, rows).withColumn("x", F.col("value").cast("double"))


def test_a_boundary_may_move_at_the_border_of_an_hour(spark):
    values = [0.0] * 100 + [3.0] * 101  # the border of the first hour is after the first 3
    df = _numeric(spark, values, 35.6)
    assert df.where("timestamp_s < 3600").count() == 101
    got = runs.collapse_runs(df, ["match_id"], "timestamp_s", "observation_id", "value", number="x", penalty=20.0).collect()
    assert sorted((r["first_id"], r["n"]) for r in got) == [("o00000", 100), ("o00100", 101)]


def test_near_runs_over_hours_stay_within_their_bound(spark):
    rng, exact = np.random.default_rng(6), 0
    for penalty in (2.0, 6.0, 15.0):
        for _ in range(2):
            x = np.repeat(rng.integers(0, 4, 40) * 3.0, rng.integers(1, 12, 40)) + 0.0
            x = np.round(x + rng.normal(0, 0.6, len(x)), 1)
            df = _numeric(spark, x.tolist(), 97.0)
            got = sorted((r["first_id"], r["n"]) for r in runs.collapse_runs(df, ["match_id"], "timestamp_s", "observation_id", "value", number="x", penalty=penalty).collect())
            assert sum(n for _, n in got) == len(x)

            def cost(s):
                return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(s, [*s[1:], len(x)])) + penalty * (len(s) - 1)

            best = cost(runs.segment_numeric(np.ones(len(x)), x, x * x, penalty))
            found = cost([int(i[1:]) for i, _ in got])
            borders = int((10 + 97 * (len(x) - 1)) // 3600)
            assert best - 1e-6 <= found <= best + penalty * borders + 1e-6
            exact += found <= best + 1e-6
    assert exact >= 4


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), ORACLES[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_whole(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
