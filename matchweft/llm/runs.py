"""Runs of identical or near-identical events, by optimal segmentation.

The events of an entity are cut into runs so that the dissimilarity within the runs plus a
penalty for each boundary is least. Dynamic programming finds the optimum; starts that can
no longer win are pruned, so the work stays about linear. Events that are simply equal are the
case of a dissimilarity of 0 or 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.jsonvalue import canonical_object, json_fields

CHUNK_S = 3_600
#: With the 0/1 dissimilarity every penalty under 1/2 gives exactly the maximal runs of equal events:
#: a run with k boundaries inside holds at least k/2 events unlike its commonest, so cutting it is cheaper.
EQUAL_PENALTY = 0.25
_RUN = "value string, first_id string, last_id string, first_t double, last_t double, n bigint, total double, squares double"


def segment_equal(codes: list[int], weights: list[int], penalty: float) -> list[int]:
    """First indices of the runs that minimise (events unlike their run's commonest one) + penalty x boundaries. Ties go to the longer run."""
    before, back = -penalty, []  # cost of the best cut before the event, less the coming boundary
    starts: list[list] = []  # first index, cost before it, counts by code, largest count, events
    for j, (code, weight) in enumerate(zip(codes, weights)):
        starts.append([j, before, {}, 0, 0])
        low, at = float("inf"), j
        for s in starts:
            counts = s[2]
            n = counts.get(code, 0) + weight
            counts[code] = n
            if n > s[3]:
                s[3] = n
            s[4] += weight
            cost = s[1] + s[4] - s[3]
            if cost < low:
                low, at = cost, s[0]
        before = low + penalty
        back.append(at)
        if len(starts) > 1:
            starts = [s for s in starts if s[1] + s[4] - s[3] < before]
    return _walk(back)


def segment_numeric(n: np.ndarray, total: np.ndarray, squares: np.ndarray, penalty: float) -> list[int]:
    """First indices of the runs that minimise the squared deviations from the runs' means + penalty x boundaries."""
    return _numeric(n, total, squares, penalty)[0]


def _numeric(n: np.ndarray, total: np.ndarray, squares: np.ndarray, penalty: float) -> tuple[list[int], np.ndarray]:
    """``segment_numeric``, and the starts that pruning leaves for a run that goes on after the end."""
    cn, ct, cs = (np.r_[0.0, np.cumsum(x)] for x in (n, total, squares))
    best, back = np.empty(len(n) + 1), []
    best[0] = -penalty
    starts = np.array([0])
    for j in range(1, len(n) + 1):
        m = np.maximum(cn[j] - cn[starts], 1e-300)
        cost = best[starts] + (cs[j] - cs[starts]) - (ct[j] - ct[starts]) ** 2 / m
        i = int(cost.argmin())
        best[j] = cost[i] + penalty
        back.append(int(starts[i]))
        starts = np.r_[starts[cost < best[j]], j]
    return _walk(back), starts


def _walk(back: list[int]) -> list[int]:
    out, j = [], len(back)
    while j > 0:
        j = back[j - 1]
        out.append(j)
    return out[::-1]


def _changes(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where a row differs from the row before it in one of the columns; the first row does."""
    out = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        changed = np.zeros(table.num_rows - 1, bool)
        for name in names:
            column = table[name].combine_chunks()
            a, b = column.slice(0, len(column) - 1), column.slice(1)
            differ = pc.fill_null(pc.not_equal(a, b), True)
            both_null = pc.and_(pc.is_null(a), pc.is_null(b))
            changed |= pc.and_not(differ, both_null).to_numpy(zero_copy_only=False)
        out[1:] = changed
    return out


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from a stream sorted by the keys; only the last group waits for the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        last = int(np.flatnonzero(_changes(table, keys))[-1])
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def _find(values: pa.Array, groups: np.ndarray, n: np.ndarray, total: np.ndarray, squares: np.ndarray, penalty: float, numeric: bool) -> np.ndarray:
    """First rows of all runs; groups has the first rows of all groups."""
    out = []
    codes = None if numeric else pc.dictionary_encode(values, null_encoding="encode").indices.to_numpy()
    for a, b in zip(groups, np.r_[groups[1:], len(n)]):
        if b - a == 1:
            out.append(a)
        elif numeric:
            out.extend(a + s for s in segment_numeric(n[a:b], total[a:b], squares[a:b], penalty))
        else:
            out.extend(a + s for s in segment_equal(codes[a:b].tolist(), n[a:b].tolist(), penalty))
    return np.array(out, np.int64)


def _border_cuts(groups: np.ndarray, n: np.ndarray, total: np.ndarray, squares: np.ndarray, penalty: float) -> np.ndarray:
    """Where a run that crosses the beginning or the end of a group may yet begin or end: what pruning leaves in either direction."""
    out = [np.zeros(0, np.int64)]
    for a, b in zip(groups, np.r_[groups[1:], len(n)]):
        forward = _numeric(n[a:b], total[a:b], squares[a:b], penalty)[1]
        backward = (b - a) - _numeric(n[a:b][::-1], total[a:b][::-1], squares[a:b][::-1], penalty)[1]
        at = np.r_[forward, backward]
        out.append(a + at[at < b - a])
    return np.concatenate(out)


def _emit(table: pa.Table, keys: list[str], first: np.ndarray, n: np.ndarray, total: np.ndarray, squares: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
    last = np.r_[first[1:], table.num_rows] - 1
    take = lambda c, at: table[c].combine_chunks().take(pa.array(at))
    columns = {k: take(k, first) for k in keys} | {
        "value": take("value", first),
        "first_id": take("first_id", first),
        "last_id": take("last_id", last),
        "first_t": take("first_t", first),
        "last_t": take("last_t", last),
        "n": pa.array(np.add.reduceat(n, first)),
        "total": pa.array(np.add.reduceat(total, first)),
        "squares": pa.array(np.add.reduceat(squares, first)),
        "role": pa.array(role),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


#: Roles of what the first pass sends on: a run inside its chunk, which is final; a piece that may go on what came before; a piece that begins a chunk's last run.
INNER, JOINS, OPENS = 0, 1, 2


def _first_pass(keys: list[str], penalty: float, numeric: bool):
    """Runs within each (entity, chunk). Of numbers, the runs at both ends of a chunk are sent on in the pieces that pruning leaves open, so that the second pass may cut them anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, [*keys, "chunk"]):
            new_group = _changes(table, [*keys, "chunk"])
            keep = new_group | _changes(table, ["t", "id"]) | table["id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
            table, new_group = table.filter(pa.array(keep)), new_group[keep]
            at = np.flatnonzero(new_group | _changes(table, ["number"])) if numeric else np.arange(table.num_rows)
            last = np.r_[at[1:], table.num_rows] - 1
            n = (last - at + 1).astype(np.int64)
            x = pc.fill_null(table["number"].combine_chunks(), 0.0).to_numpy() if numeric else np.zeros(table.num_rows)
            total, squares = np.add.reduceat(x, at), np.add.reduceat(x * x, at)
            take = lambda c, i: table[c].combine_chunks().take(pa.array(i))
            atoms = pa.table({k: take(k, at) for k in [*keys, "chunk"]} | {"value": take("value", at), "first_id": take("id", at), "last_id": take("id", last), "first_t": take("t", at), "last_t": take("t", last)})
            groups = np.searchsorted(at, np.flatnonzero(new_group))
            first = _find(atoms["value"].combine_chunks(), groups, n, total, squares, penalty, numeric)
            starts = np.isin(first, groups)
            ends = np.r_[starts[1:], True]
            role = np.where(starts, JOINS, np.where(ends, OPENS, INNER)).astype(np.int32)
            if numeric:
                pieces = np.union1d(first, _border_cuts(groups, n, total, squares, penalty))
                of = np.searchsorted(first, pieces, "right") - 1
                inner = role[of] == INNER
                role = np.where(np.isin(pieces, first), role[of], JOINS).astype(np.int32)
                keep = np.isin(pieces, first) | ~inner
                first, role = pieces[keep], role[keep]
            yield _emit(atoms, [*keys, "chunk"], first, n, total, squares, role)

    return run


def _second_pass(keys: list[str], penalty: float, numeric: bool):
    """Runs over the borders of chunks, from the pieces on either side; runs inside a chunk go through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, [*keys, "place"]):
            groups = np.flatnonzero(_changes(table, [*keys, "place"]) | (table["role"].to_numpy() != JOINS))
            n, total, squares = (table[c].to_numpy() for c in ("n", "total", "squares"))
            first = _find(table["value"].combine_chunks(), groups, n, total, squares, penalty, numeric)
            yield _emit(table, keys, first, n, total, squares, np.zeros(len(first), np.int32))

    return run


def collapse_runs(events: DataFrame, keys: list[str], time: str, id_: str, value: str, *, number: str | None = None, penalty: float = EQUAL_PENALTY) -> DataFrame:
    """Collapse the events of each entity, in order of time and id, into runs.

    Result: keys, value (of the first event), first_id, last_id, first_t, last_t, n, duration.
    Without ``number`` two events are alike if their ``value`` texts are equal; any penalty
    under 1/2 then gives exactly the maximal runs. With ``number`` the squared deviation from
    the run's mean counts, and events with a null number count as 0. Null values are alike.
    Events whose key or time is null, or whose time is not finite, have no place in an order and
    take no part. An event delivered twice (same time and id) counts once. Empty tables give
    no rows.

    The first pass works on (entity, hour), so a hot entity is spread over many tasks. The second
    one cuts anew what lies at the borders of hours: it gets the last run before a border and the
    first one after it (for numbers in the few pieces at whose ends it may yet be cut), while runs inside
    an hour only pass through it, spread by hour. For equal events the result is exact. For
    numbers it is the optimum among the segmentations that keep each hour's inner boundaries:
    cutting the optimum at every border never adds dissimilarity, so its cost is over the
    optimum's by at most one penalty for each border between hours.
    """
    if not (penalty > 0 and (number or penalty < 0.5)):
        raise ValueError("the penalty must be positive, and under 1/2 without numbers")
    t = F.col(time)
    rows = events.where(t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    named = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
    chunk = F.floor(F.least(F.greatest(t / CHUNK_S, F.lit(-1e15)), F.lit(1e15)))  # whatever lies farther shares the last chunk
    rows = rows.select(*named, chunk.cast("bigint").alias("chunk"), t.cast("double").alias("t"), F.col(id_).cast("string").alias("id"), F.col(value).cast("string").alias("value"), *([F.col(number).cast("double").alias("number")] if number else []))
    k = [f"k{i}" for i in range(len(keys))]
    head = ", ".join(f"{x} string" for x in k)
    placed = rows.repartition(*k, "chunk").sortWithinPartitions(*k, "chunk", "t", "id")
    first = placed.mapInArrow(_first_pass(k, penalty, number is not None), f"{head}, chunk bigint, {_RUN}, role int")
    again = first.withColumn("place", F.when(F.col("role") == INNER, F.col("chunk"))).repartition(*k, "place").sortWithinPartitions(*k, "place", "first_t", "first_id", "chunk")
    runs = again.drop("chunk").mapInArrow(_second_pass(k, penalty, number is not None), f"{head}, {_RUN}, role int")
    return runs.select(*[F.col(f"k{i}").alias(x) for i, x in enumerate(keys)], "value", "first_id", "last_id", "first_t", "last_t", "n", (F.col("last_t") - F.col("first_t")).alias("duration"))


def near_runs(observations: DataFrame, kind: str, penalty: float) -> DataFrame:
    """Runs of near-identical readings of one number: those of a match are cut where that lowers the squared deviations by more than the penalty. Readings without the number take no part."""
    fields = json_fields(F.col("value"))
    rows = observations.where(F.col("kind") == kind).withColumn("number", F.trim(F.element_at(fields, F.lit(kind))).try_cast("double"))
    rows = rows.where(F.col("number").isNotNull() & (F.abs("number") < 1e100))
    return collapse_runs(rows, ["match_id"], "timestamp_s", "observation_id", "value", number="number", penalty=penalty)


def observation_runs(observations: DataFrame) -> DataFrame:
    """Runs of readings of one match and kind that hold the same value, whatever its spelling and ``ocr_score``."""
    rows = observations.withColumn("same", canonical_object(F.col("value"), ignore=["ocr_score"]))
    return collapse_runs(rows, ["match_id", "kind"], "timestamp_s", "observation_id", "same")
