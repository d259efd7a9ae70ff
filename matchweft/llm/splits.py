"""Splits that keep related records together: components of shared states, balanced by largest differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

#: Bins to deal to, components that one task balances, and groups whose bins are differenced together.
BINS, GROUP_ROWS, GROUPS_AT_ONCE = 1000, 200_000, 64
#: Ids that name nothing: without any digit (a word, a sign, nothing at all), or a bare zero, with or without the prefix of an id.
STAND_INS = r"^[^0-9]*$|^([A-Za-z]+[-_:#])?0+$"


def names_a_state(state: Column, stand_ins: str = STAND_INS) -> Column:
    """False for null and for ids that the pattern of stand-ins matches."""
    return F.coalesce(~state.rlike(stand_ins), F.lit(False))


def shared_state_edges(samples: DataFrame, stand_ins: str = STAND_INS) -> DataFrame:
    """Edges (a, b), a > b, that connect all matches of every state without pairing them: each match goes to the least one of the state."""
    seen = samples.select("match_id", F.explode(F.array("state_id", "next_state_id")).alias("s")).where(names_a_state(F.col("s"), stand_ins) & F.col("match_id").isNotNull()).distinct()
    least = seen.groupBy("s").agg(F.min("match_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return seen.join(least, "s").where("match_id > b").select(F.col("match_id").alias("a"), "b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Least member of the component of every vertex that has an edge: (vertex, component).

    Large-star and small-star steps alternate until nothing moves; each step groups by
    vertex and never pairs the members of a component, and the number of rounds grows with
    the logarithm of the longest chain. Each round is written to the checkpoint folder, so a
    lost executor costs no more than a round.
    """
    now, before = cut_lineage(edges), None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
        now = cut_lineage(_small_star(_large_star(now)))
    stars = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("vertex"), F.col("b").alias("component"))).distinct()


def match_components(samples: DataFrame, stand_ins: str = STAND_INS) -> DataFrame:
    """Every match with its component (the least match id in it): match_id, component. A null match is on its own.

    This is the operator's main result: the least match stands for its component, and a row is the
    link of a match to it, so all links are kept in as many rows as there are matches.
    """
    linked = connected_components(shared_state_edges(samples, stand_ins))
    matches = samples.select("match_id").distinct()
    return matches.join(linked.withColumnRenamed("vertex", "match_id"), "match_id", "left").select("match_id", F.coalesce("component", "match_id").alias("component"))


def linked_pairs(samples: DataFrame, stand_ins: str = STAND_INS) -> DataFrame:
    """Each pair of matches of one component, for reports that ask for all of them: match_id_a, match_id_b with a < b. The result itself is of that size; AQE splits a component that is large."""
    linked = connected_components(shared_state_edges(samples, stand_ins))
    a, b = (linked.select("component", F.col("vertex").alias(f"match_id_{x}")) for x in "ab")
    return a.join(b, "component").where("match_id_a < match_id_b").select("match_id_a", "match_id_b")


def difference_tuples(loads: np.ndarray) -> np.ndarray:
    """Largest differencing over rows of bin loads: the bin that each entry of each row goes to.

    Again and again the two rows with the widest spread become one, the largest load of one
    with the least of the other, until one row is left.
    """
    rows, bins = loads.shape
    order = np.argsort(-loads, axis=1, kind="stable")
    members: list = [(i, order[i]) for i in range(rows)]
    sums = [loads[i][order[i]] for i in range(rows)]
    heap = [(-(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        both = sums[i] + sums[j][::-1]
        again = np.argsort(-both, kind="stable")
        members[i] = _Lazy(members[i], members[j], again)
        members[j] = None
        sums[i], sums[j] = both[again], None
        heapq.heappush(heap, (-(sums[i][0] - sums[i][-1]), i))
    out = np.zeros((rows, bins), np.int64)
    stack = [(members[heap[0][1]], np.arange(bins))] if rows else []
    while stack:
        node, place = stack.pop()
        if isinstance(node, _Lazy):
            inner = np.empty(bins, np.int64)
            inner[node.order] = place
            stack += [(node.left, inner), (node.right, inner[::-1])]
        else:
            i, row_order = node
            out[i, row_order] = place
    return out


class _Lazy:
    """Two rows combined: the second reversed onto the first, then put in order."""

    __slots__ = ("left", "order", "right")

    def __init__(self, left, right, order: np.ndarray) -> None:
        self.left, self.right, self.order = left, right, order


def balance(weights: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each weight, in about equal bins. Weights in falling order are cut into rows of one per bin, whose differences are then evened out."""
    if not len(weights):
        return np.zeros(0, np.int64)
    order = np.argsort(-weights, kind="stable")
    rows = -(-len(weights) // bins)
    padded = np.zeros(rows * bins, weights.dtype)
    padded[: len(weights)] = weights[order]
    places = difference_tuples(padded.reshape(rows, bins)).ravel()[: len(weights)]
    out = np.empty(len(weights), np.int64)
    out[order] = places
    return out


def allocate_bins(loads: np.ndarray, shares: list[float]) -> np.ndarray:
    """Split of each bin: heaviest first, to the split that lacks most of its target; then bins are exchanged while that brings two splits nearer to theirs."""
    lack = np.asarray(shares, float) / sum(shares) * loads.sum()
    out = np.zeros(len(loads), np.int64)
    for i in np.argsort(-loads, kind="stable"):
        out[i] = int(lack.argmax())
        lack[out[i]] -= loads[i]
    while len(shares) > 1:  # each exchange brings the sum of what is lacking down
        need, spare = int(lack.argmax()), int(lack.argmin())
        give, take = np.flatnonzero(out == spare), np.r_[np.flatnonzero(out == need), -1]
        gain = loads[give][:, None] - np.r_[loads[take[:-1]], 0][None, :]
        left = np.abs(lack[need] - gain) + np.abs(lack[spare] + gain)
        if not left.size or left.min() >= abs(lack[need]) + abs(lack[spare]) - 1e-9:
            break
        i, j = np.unravel_index(int(left.argmin()), left.shape)
        out[give[i]] = need
        if take[j] >= 0:
            out[take[j]] = spare
        lack[need] -= gain[i, j]
        lack[spare] += gain[i, j]
    return out


def _difference_groups(loads: DataFrame, bins: int) -> DataFrame:
    """Difference the bins of GROUPS_AT_ONCE groups together: (g, bin) of each load, and the larger group and bin it goes to. A task sees at most GROUPS_AT_ONCE x bins numbers."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [df for df in batches if len(df)]
        if not held:
            return
        for above, part in pd.concat(held, ignore_index=True).groupby("above", sort=True):
            groups = np.unique(part["g"].values)
            table = np.zeros((len(groups), bins), np.int64)
            table[np.searchsorted(groups, part["g"].values), part["bin"].values] = part["w"].values
            place = difference_tuples(table)
            g, b = np.repeat(groups, bins), np.tile(np.arange(bins), len(groups))
            yield pd.DataFrame({"g": g, "bin": b, "above": above, "place": place.ravel(), "w": table.ravel()})

    spread = loads.withColumn("above", F.floor(F.col("g") / GROUPS_AT_ONCE).cast("bigint"))
    return spread.repartition("above").mapInPandas(deal, "g bigint, bin int, above bigint, place int, w bigint")


def assign_splits(samples: DataFrame, shares: DataFrame, bins: int = BINS, stand_ins: str = STAND_INS) -> DataFrame:
    """A split for each match, whole components together: match_id, component, split.

    ``shares`` (split, share) is a table of settings. Components are dealt by hash to groups of
    some hundred thousand, as many as it takes; each group balances its own into ``bins`` bins by largest
    differencing. The bins of 64 groups at a time are differenced again, level by level, until one
    level is left of at most 64 groups, whose bins (64 x bins numbers at most, whatever the
    rows) go to the splits by target on the driver. A component larger
    than a bin makes its bin heavy and is placed first. Shares are met to about 1/bins of all
    rows where the components allow it. Null matches are one match. Rows with ids that name no
    state are linked by their match only. An empty table gives no rows.
    """
    setting = shares.where("share > 0").groupBy("split").agg(F.sum("share").alias("share")).orderBy("split").limit(1001).collect()
    if not 0 < len(setting) <= 1000:
        raise ValueError("between 1 and 1000 splits with a positive share are needed")
    members = match_components(samples, stand_ins)
    sizes = samples.groupBy("match_id").agg(F.count(F.lit(1)).alias("w"))
    members = cut_lineage(members.join(sizes, members["match_id"].eqNullSafe(sizes["match_id"])).select(members["match_id"], "component", "w"))
    weights = members.groupBy("component").agg(F.sum("w").alias("w"))
    groups = 1 + weights.count() // GROUP_ROWS

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [df for df in batches if len(df)]
        if not held:
            return
        df = pd.concat(held, ignore_index=True)
        for g, part in df.groupby("g", sort=True):
            part = part.sort_values(["w", "component"], ascending=[False, True], kind="stable", na_position="last")
            yield pd.DataFrame({"component": part["component"], "g": g, "bin": balance(part["w"].values, bins), "w": part["w"]})

    placed = weights.withColumn("g", F.pmod(F.xxhash64("component"), F.lit(groups)).cast("bigint")).repartition(groups, "g")
    local = cut_lineage(placed.mapInPandas(deal, "component string, g bigint, bin int, w bigint"))
    loads, levels = local.groupBy("g", "bin").agg(F.sum("w").alias("w")), []
    while groups > GROUPS_AT_ONCE:
        levels.append(cut_lineage(_difference_groups(loads, bins)))
        loads = levels[-1].groupBy(F.col("above").alias("g"), F.col("place").alias("bin")).agg(F.sum("w").alias("w"))
        groups = -(-groups // GROUPS_AT_ONCE)
    table = np.zeros((groups, bins), np.int64)
    for row in loads.collect():
        table[row["g"], row["bin"]] = row["w"]
    place = difference_tuples(table)
    total = np.zeros(bins, np.int64)
    np.add.at(total, place.ravel(), table.ravel())
    split = allocate_bins(total, [r["share"] for r in setting])
    names = [r["split"] for r in setting]
    chosen = pd.DataFrame({"g": np.repeat(np.arange(groups), bins).astype(np.int64), "bin": np.tile(np.arange(bins), groups).astype(np.int32), "split": [names[s] for s in split[place.ravel()]]})
    chosen = samples.sparkSession.createDataFrame(chosen, "g bigint, bin int, split string")
    for level in reversed(levels):
        above = chosen.select(F.col("g").alias("above"), F.col("bin").alias("place"), "split")
        chosen = level.join(above, ["above", "place"]).select("g", "bin", "split")
    of_component = local.join(chosen, ["g", "bin"]).select("component", "split")
    return members.join(of_component, members["component"].eqNullSafe(of_component["component"])).select("match_id", members["component"], "split")
