"""Splits: components, balance, whole components, awkward inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from matchweft.llm import splits

SCHEMA = "match_id string, state_id string, next_state_id string, component string, w int"
SHARES = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def _samples(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def _brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for m, a, b in rows:
        for s in (a, b):
            if m is not None and s is not None and any(c in "123456789" for c in s):
                parent[find(("m", m))] = find(("s", s))
    groups = {}
    for m in {r[0] for r in rows if r[0] is not None}:
        groups.setdefault(find(("m", m)), set()).add(m)
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(f"m{rng.randrange(60)}", f"st-{rng.randrange(1, 900)}", rng.choice([f"st-{rng.randrange(1, 900)}", "", "n/a", "-", "0", "st-0", "unknown", None])) for _ in range(220)]
    rows += [(f"chain{i}", f"c-{i + 1}", f"c-{i + 2}") for i in range(40)] + [(f"hub{i}", "st-7777", None) for i in range(50)]
    rows += rows[:30] + [(None, "st-7777", "c-3"), ("lonely", None, None)]
    got = {tuple(r) for r in splits.linked_pairs(_samples(spark, rows)).collect()}
    assert got == _brute(rows)


def test_components_stay_whole_and_shares_are_met(spark):
    rng = random.Random(7)
    rows = [(f"m{i}", f"st-{i // 3 + 1}", None) for i in range(900) for _ in range(rng.randrange(1, 9))]
    rows += [("hot", "st-99999", None)] * 1500 + [(None, None, None)] * 5
    df, shares = _samples(spark, rows), spark.createDataFrame(SHARES, "split string, share double")
    out = splits.assign_splits(df, shares).collect()
    assert len(out) == 902
    by = {}
    for r in out:
        by.setdefault(r["component"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    assert len(by) == 302
    counts = df.groupBy("match_id").count().collect()
    split = {r["match_id"]: r["split"] for r in out}
    met = {s: sum(c["count"] for c in counts if split[c["match_id"]] == s) / len(rows) for s, _ in SHARES}
    assert all(abs(met[s] - share) < 0.002 for s, share in SHARES), met


def test_one_component_and_no_rows(spark):
    shares = spark.createDataFrame(SHARES, "split string, share double")
    one = _samples(spark, [("a", "s-1", "s-2"), ("b", "s-2", "s-3")])
    assert {r["split"] for r in splits.assign_splits(one, shares).collect()} == {"train"}
    assert splits.assign_splits(one.limit(0), shares).count() == 0
    assert splits.linked_pairs(one.limit(0)).count() == 0


def test_many_groups_are_differenced_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(splits, "GROUP_ROWS", 60)
    monkeypatch.setattr(splits, "GROUPS_AT_ONCE", 3)
    rng = random.Random(11)
    rows = [(f"m{i}", f"st-{i + 1}", None) for i in range(1200) for _ in range(rng.randrange(1, 6))]
    df, shares = _samples(spark, rows), spark.createDataFrame(SHARES, "split string, share double")
    split = {r["match_id"]: r["split"] for r in splits.assign_splits(df, shares, bins=20).collect()}
    assert len(split) == 1200
    for name, share in SHARES:
        assert abs(sum(split[r[0]] == name for r in rows) / len(rows) - share) < 0.01


def test_what_a_stand_in_is(spark):
    ids = ["ab-c00d", "alpha", "m0n", "x_0", "00", "n/a", "st-10"]
    df = spark.createDataFrame([(x,) for x in ids], "s string")
    assert [r["s"] for r in df.where(splits.names_a_state(F.col("s"))).collect()] == ["ab-c00d", "m0n", "st-10"]
    assert df.where(splits.names_a_state(F.col("s"), "^$")).count() == len(ids)


def test_differencing_is_even_and_keeps_every_weight():
    rng = np.random.default_rng(1)
    for n, bins in ((0, 4), (3, 8), (5000, 50)):
        w = rng.integers(1, 100, n)
        at = splits.balance(w, bins)
        loads = np.bincount(at, weights=w, minlength=bins)
        assert len(at) == n and (n < bins or loads.max() - loads.min() <= 2)
    groups = splits.difference_tuples(rng.integers(0, 50, (6, 10)))
    assert all(sorted(g) == list(range(10)) for g in groups.tolist())


def test_exchange_brings_splits_nearer():
    out = splits.allocate_bins(np.array([7, 5, 5, 3, 2, 1, 1]), [0.5, 0.25, 0.25])
    loads = np.bincount(out, weights=[7, 5, 5, 3, 2, 1, 1])
    assert sorted(loads.tolist()) == [6, 6, 12]


def test_stand_ins_name_no_state(spark):
    df = spark.createDataFrame([(x,) for x in ["st-1", "a7", "", " ", "n/a", "0", "st-000", "-", None]], "s string")
    assert [r["s"] for r in df.where(splits.names_a_state(F.col("s"))).collect()] == ["st-1", "a7"]
