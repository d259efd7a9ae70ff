"""Missing cells filled from a Chow-Liu tree over the fields of the same state and of its neighbours."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

BINS, SMOOTHING, SEGMENT_S = 32, 0.5, 14_400
#: Rounds of a stage (its first one may be shorter).
ROUNDS = 7
#: The fields to fill, with the contract's lower bound.
TARGETS = {"stage": 1, "round": 1, "gold": 0, "hp": 0}


@dataclass(frozen=True)
class TreeModel:
    """Variables, the borders and medians of their bins, and the tree with its tables of joint counts."""

    variables: list[str]
    borders: list[np.ndarray]
    medians: list[np.ndarray]
    edges: list[tuple[int, int]]
    single: list[np.ndarray]
    joint: dict[tuple[int, int], np.ndarray]


def _cells(states: DataFrame) -> dict[str, Column]:
    raw = {"stage": F.col("stage"), "round": F.col("round"), "gold": F.col("player.gold"), "hp": F.col("player.hp")}
    return {k: F.when(c >= TARGETS[k], c).cast("double") for k, c in raw.items()}


def state_cells(states: DataFrame) -> DataFrame:
    """One row for each state: the four cells (null where missing or under the contract's bound), helper fields, the nearest known cells before and after it in its match, and what these suggest.

    Neighbours are looked up within four hours of a match, so a match that never ends is
    spread over many tasks. A re-sent state is one row.
    """
    t = F.col("timestamp_s")
    helpers = {"level": F.when(F.col("player.level") >= 1, F.col("player.level")).cast("double"), "minute": F.when(t.between(0, 1e12), F.floor(t / 60)).cast("double"), "phase_no": F.pmod(F.xxhash64("phase"), F.lit(1021)).cast("double")}
    rows = states.select("state_id", "match_id", "timestamp_s", F.floor(t / SEGMENT_S).alias("segment"), *[c.alias(k) for k, c in (_cells(states) | helpers).items()])
    rows = rows.dropDuplicates(["match_id", "segment", "timestamp_s", "state_id"])
    before = Window.partitionBy("match_id", "segment").orderBy("timestamp_s", "state_id").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("match_id", "segment").orderBy(F.desc("timestamp_s"), F.desc("state_id")).rowsBetween(Window.unboundedPreceding, -1)
    clock = F.col("stage") * ROUNDS + F.col("round")
    rows = rows.withColumn("clock", F.when(clock.isNotNull(), F.struct(t.alias("t"), clock.alias("c"))))
    rows = rows.select("*", *[F.last(k, ignorenulls=True).over(before).alias(f"{k}_before") for k in (*TARGETS, "clock")])
    rows = rows.select("*", *[F.last(k, ignorenulls=True).over(after).alias(f"{k}_after") for k in (*TARGETS, "clock")])
    return _with_hints(rows, t).drop("clock", "clock_before", "clock_after")


def _with_hints(rows: DataFrame, t: Column) -> DataFrame:
    """What the neighbours together suggest: the round by the clock between them, and the middle of their gold and hp."""
    b, a = F.col("clock_before"), F.col("clock_after")
    share = F.when(a["t"] > b["t"], (t - b["t"]) / (a["t"] - b["t"])).otherwise(F.lit(0.5))
    at = F.coalesce(b["c"] + (a["c"] - b["c"]) * share, b["c"] + 1, a["c"] - 1)
    whole = F.round(at)
    stage = F.coalesce(F.round((at - F.col("round")) / ROUNDS), F.floor((whole - 1) / ROUNDS))
    in_stage = F.coalesce(F.least(F.greatest(whole - F.col("stage") * ROUNDS, F.lit(1.0)), F.lit(float(ROUNDS))), F.pmod(whole - 1, F.lit(float(ROUNDS))) + 1)
    middle = lambda k: F.coalesce((F.col(f"{k}_before") + F.col(f"{k}_after")) / 2, f"{k}_before", f"{k}_after")
    hints = {"stage_hint": stage.cast("double"), "round_hint": in_stage.cast("double"), "gold_hint": middle("gold"), "hp_hint": middle("hp")}
    return rows.select("*", *[c.alias(k) for k, c in hints.items()])


def _variables() -> list[str]:
    return [*TARGETS, "level", "minute", "phase_no", *[f"{k}_{x}" for x in ("before", "after", "hint") for k in TARGETS]]


def _binned(df: pd.DataFrame, variables: list[str], borders: list[np.ndarray]) -> np.ndarray:
    """Bin of each cell; -1 for a missing one."""
    out = np.full((len(df), len(variables)), -1, np.int64)
    for j, name in enumerate(variables):
        x = df[name].values.astype(float)
        known = np.isfinite(x)
        out[known, j] = np.searchsorted(borders[j], x[known], "left")
    return out


def fit_tree(cells: DataFrame) -> TreeModel:
    """Fit the tree on all rows.

    Bins are quantiles over all rows (a field of few values gets one bin for each). Pair
    counts are summed up within each partition as arrays of fixed size, then over partitions;
    what reaches the driver is bounded by variables and bins (190 tables of 32 x 32 cells).
    The maximum spanning tree of mutual information is the Chow-Liu tree.
    """
    variables = _variables()
    probs = [i / BINS for i in range(1, BINS + 1)]
    quantiles = cells.select(*[F.percentile_approx(c, probs, 10_000).alias(c) for c in variables]).first()
    borders = [np.unique(quantiles[c] or [])[:-1] if quantiles[c] else np.array([]) for c in variables]
    sizes = [len(b) + 1 for b in borders]
    bin_of = lambda j: sum([(F.col(variables[j]) > float(b)).cast("int") for b in borders[j]], F.lit(0))
    medians = [np.zeros(s) for s in sizes]
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), bin_of(j).alias("bin"), F.col(variables[j]).alias("x")) for j in range(len(TARGETS))])).alias("e")
    for row in cells.select(each).where("e.x is not null").groupBy("e.j", "e.bin").agg(F.percentile_approx("e.x", 0.5, 10_000).alias("m")).collect():
        medians[row["j"]][row["bin"]] = row["m"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {(i, j): np.zeros(sizes[i] * sizes[j], np.int64) for i in range(len(sizes)) for j in range(i + 1)}
        for df in batches:
            b = _binned(df, variables, borders)
            for (i, j), sums in total.items():
                both = (b[:, i] >= 0) & (b[:, j] >= 0)
                sums += np.bincount(b[both, i] * sizes[j] + b[both, j], minlength=len(sums))
        rows = [(i, j, int(c), int(sums[c])) for (i, j), sums in total.items() for c in np.flatnonzero(sums)]
        yield pd.DataFrame(rows, columns=["i", "j", "cell", "n"])

    counted = cells.select(*variables).mapInPandas(count, "i int, j int, cell int, n bigint").groupBy("i", "j", "cell").agg(F.sum("n").alias("n"))
    joint = {(i, j): np.zeros((sizes[i], sizes[j])) for i in range(len(sizes)) for j in range(i + 1)}
    for row in counted.collect():
        joint[row["i"], row["j"]][divmod(row["cell"], sizes[row["j"]])] = row["n"]
    single = [joint[i, i].diagonal() + SMOOTHING for i in range(len(sizes))]
    pairs = {k: v for k, v in joint.items() if k[0] != k[1]}

    def information(n: np.ndarray) -> float:
        p = n / max(n.sum(), 1)
        q = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
        some = p > 0
        return float((p[some] * np.log(p[some] / q[some])).sum())

    group = list(range(len(sizes)))
    edges = []
    for (i, j) in sorted(pairs, key=lambda k: (-information(pairs[k]), k)):
        if group[i] != group[j]:
            edges.append((i, j))
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
    return TreeModel(variables, borders, medians, edges, single, {e: pairs[e] + SMOOTHING / pairs[e].size for e in edges})


def _posterior(model: TreeModel, target: int, bins: np.ndarray) -> np.ndarray:
    """P(bin of the target | known cells) for each row, by messages from the leaves of the tree to the target."""

    def message(node: int, parent: int | None) -> np.ndarray:
        known = bins[:, node] >= 0
        belief = np.ones((len(bins), len(model.single[node])))
        if node != target:
            belief[known] = np.eye(belief.shape[1])[bins[known, node]]
        for a, b in model.edges:
            child = b if a == node else a if b == node else None
            if child is None or child == parent:
                continue
            counts = model.joint[a, b] if a == node else model.joint[a, b].T
            belief *= message(child, node) @ (counts / counts.sum(1, keepdims=True)).T
        return belief / np.maximum(belief.sum(1, keepdims=True), 1e-300)

    out = message(target, None) * (model.single[target] / model.single[target].sum())
    return out / np.maximum(out.sum(1, keepdims=True), 1e-300)


def apply_tree(cells: DataFrame, model: TreeModel) -> DataFrame:
    """Fill the missing cells of ``state_cells`` rows: state_id, match_id, timestamp_s, the four fields, ``filled`` (names of the filled ones)."""
    targets = list(TARGETS)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            bins = _binned(df, model.variables, model.borders)
            values = df[targets].values.astype(float)
            missing = ~np.isfinite(values)
            for j in range(len(targets)):
                rows = np.flatnonzero(missing[:, j])
                if len(rows):
                    values[rows, j] = model.medians[j][_posterior(model, j, bins[rows]).argmax(1)]
            out = df[["state_id", "match_id", "timestamp_s"]].copy()
            for j, name in enumerate(targets):
                out[name] = np.rint(values[:, j]).astype(np.int64)
            marks = np.array(targets, object)
            out["filled"] = [list(marks[m]) for m in missing]
            yield out

    return cells.select("state_id", "match_id", "timestamp_s", *model.variables).mapInPandas(fill, "state_id string, match_id string, timestamp_s double, stage bigint, round bigint, gold bigint, hp bigint, filled array<string>")


def fill_states(states: DataFrame) -> DataFrame:
    """All states with stage, round, gold and hp filled in: state_id, match_id, timestamp_s, the four fields, ``filled``.

    A cell is missing if it is null (a null player has neither gold nor hp) or below the
    contract's lower bound. Known cells stay as they are. ``filled`` names the filled cells.
    Stage and round get the most likely value, gold and hp the median of the most likely
    bin. A field that no state has is filled with 0. Re-sent states are one row; states of
    one id that differ in match or time stay apart. An empty table gives no rows.
    """
    cells = cut_lineage(state_cells(states))
    return apply_tree(cells, fit_tree(cells))


def model_summary(model: TreeModel) -> str:
    """The tree as JSON, for reports."""
    return json.dumps([[model.variables[i], model.variables[j]] for i, j in model.edges])
