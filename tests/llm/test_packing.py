"""Packing: nothing lost, nothing over capacity, as full as a plain best fit."""

import random
from bisect import bisect_left, insort

import pytest
from pyspark.sql import functions as F

from matchweft.llm.packing import pack, plan_bins


def _plain_best_fit(sizes, capacity):
    """Bins of the textbook best fit, largest first."""
    room = []
    n = 0
    for s in sorted(sizes, reverse=True):
        i = bisect_left(room, s)
        left = room.pop(i) if i < len(room) else capacity
        n += left == capacity
        insort(room, left - s)
    return n


@pytest.mark.parametrize("seed", range(8))
def test_histogram_plan_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 600))]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    plan = plan_bins(histogram, [100])
    assert plan.n_bins == _plain_best_fit(sizes, 100)
    for s, n in histogram.items():
        spans = sorted((a, b) for size, a, b, _, _ in plan.segments if size == s)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def _check(items, out, capacities):
    got = {}
    bins = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["size"]
        bins.setdefault(r["bin_id"], []).append(r)
    want = {}
    for i, n in items:
        want[i] = want.get(i, 0) + max(n or 0, 0)
    assert got == want
    for rows in bins.values():
        fill = sum(r["size"] for r in rows)
        assert {r["capacity"] for r in rows} == {min(c for c in capacities if c >= fill)}
    assert all(r["n_pieces"] == 1 for r in out if 0 < want[r["doc_id"]] <= max(capacities) and [i for i, _ in items].count(r["doc_id"]) == 1)


@pytest.mark.parametrize("capacities", [[64], [16, 64], [16, 24, 64]])
def test_packing_is_whole(spark, capacities):
    rng = random.Random(9)
    items = [(i, rng.choice([rng.randrange(0, 20), rng.randrange(0, 64), rng.randrange(60, 400)])) for i in range(700)] + [(None, 5), (900, None), (901, 0), (3, 7), (902, 64), (903, 65)]
    df = spark.createDataFrame([(*x, 1) for x in items], "doc_id bigint, n bigint, bin_id int")
    _check(items, pack(df, "doc_id", "n", capacities).collect(), capacities)


def test_little_room_is_left(spark):
    rng = random.Random(2)
    items = [(i, int(rng.expovariate(1 / 120)) + 1) for i in range(20_000)]
    out = pack(spark.createDataFrame(items, "doc_id bigint, n bigint"), "doc_id", "n", [512, 2048])
    bins = out.groupBy("bin_id").agg(F.max("capacity").alias("c")).agg(F.sum("c")).first()[0]
    assert sum(n for _, n in items) / bins > 0.99


@pytest.mark.parametrize("seed", range(5))
def test_joint_plan_takes_no_more_room_than_any_single_capacity(seed):
    rng = random.Random(seed)
    sizes = [min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(rng.randrange(1, 900))]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    joint = plan_bins(histogram, [25, 60, 100])
    assert sum(sizes) <= joint.room <= plan_bins(histogram, [100]).room
    assert plan_bins(histogram, [100]).room == 100 * plan_bins(histogram, [100]).n_bins


def test_ranks_do_not_depend_on_the_number_of_buckets(spark, monkeypatch):
    from matchweft.llm import packing

    df = spark.range(3000).selectExpr("id AS doc_id", "1 + id % 3 AS n")
    bins = []
    for at_once in (10, 10**6):
        monkeypatch.setattr(packing, "RANKED_AT_ONCE", at_once)
        out = pack(df, "doc_id", "n", [10])
        bins.append(sorted(r["size"] for r in out.groupBy("bin_id").agg(F.sum("size").alias("size")).collect()))
        assert out.count() == 3000
    assert bins[0] == bins[1] == [10] * 600


def test_no_items_and_empty_ones_only(spark):
    df = spark.createDataFrame([(1, None), (2, 0)], "doc_id bigint, n bigint")
    assert {(r["doc_id"], r["size"], r["bin_id"], r["capacity"]) for r in pack(df, "doc_id", "n", [8, 16]).collect()} == {(1, 0, 0, 8), (2, 0, 0, 8)}
    assert pack(df.limit(0), "doc_id", "n", [8]).count() == 0
    for bad in ([], [0], [10**7]):
        with pytest.raises(ValueError):
            pack(df, "doc_id", "n", bad)
