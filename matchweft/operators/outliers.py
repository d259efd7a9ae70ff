"""Implausible readings: Hampel filter, stuck values and physical bounds, by source.

The readings of one source (a match and a field) are put in time order from all tables
that carry them. The filter works on the moves between readings, since the levels drift: a
reading's distance from the rolling median is held against the rolling median absolute
deviation of the source's own moves, so a rich match and a poor one each have a measure
of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsonvalue import json_fields

SEGMENT_S, HALO_S = 14_400, 1_800
#: The segment of readings without a usable time.
UNTIMED = -(2**62)
#: Hampel filter: deviations a reading may be off, moves on either side that the deviation is taken over, widest excursion, least deviation.
DEVIATIONS, AROUND, WIDEST, LEAST_SCALE = 1.5, 50, 3, 1.0
#: Moves that a source must have made before it can be said how it moves.
LEAST_MOVES = 3
STUCK_ROUNDS, STUCK_READINGS = 3, 4
_OUT = "record_type string, record_id string, field string, reason string"


def _segment(t: Column) -> Column:
    """Segments lie around the beginning of a match, so that no border and no doubled readings fall on it."""
    return F.when(t.between(-1e15, 1e15), F.floor(t / SEGMENT_S + 0.5)).otherwise(F.lit(UNTIMED)).cast("bigint")


def _segments(t: Column) -> Column:
    """The time segments that need a reading: its own and, near a border, the neighbour's."""
    return F.when(t.between(-1e15, 1e15), F.array_distinct(F.array(_segment(t - HALO_S), _segment(t), _segment(t + HALO_S)))).otherwise(F.array(_segment(t)))


def readings(observations: DataFrame, states: DataFrame, fields: tuple[str, ...] = ("gold", "hp")) -> DataFrame:
    """One row for each reading of a field in either table, and for each reading of the round.

    Columns: match_id, field, t, src (o, s or r), id, v, bad, round_no. ``bad`` marks what the
    field (a whole number of 0 or more) cannot hold. An observation without the field has
    read nothing; a state's null or value under the bound is no reading here.
    """
    o = observations.where(F.col("kind").isin(*fields, "round")).select("match_id", "kind", F.col("timestamp_s").alias("t"), F.col("observation_id").alias("id"), json_fields(F.col("value")).alias("m"))
    raw = F.trim(F.element_at("m", F.col("kind")))
    v = raw.try_cast("double")
    bad = v.isNull() | F.isnan(v) | (v < 0) | (v > 9.2e18) | (v != F.floor(v))
    number = lambda c: F.element_at("m", F.lit(c)).try_cast("double").try_cast("bigint")
    round_no = lambda stage, at: F.when((stage >= 1) & (at >= 1), stage * 100 + at)
    clock = F.col("kind") == "round"
    from_o = o.select(
        "match_id", F.when(clock, "gold").otherwise(F.col("kind")).alias("field"), "t", F.when(clock, "r").otherwise("o").alias("src"), "id",
        F.when(~clock, v).alias("v"), (~clock & bad).alias("bad"), F.when(clock, round_no(number("stage"), number("round"))).alias("round_no"), raw.alias("raw"),
    ).where("case when src = 'r' then round_no is not null else raw is not null end").drop("raw")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"player.{f}").cast("double").alias("v")) for f in fields]))
    from_s = states.select("match_id", F.col("timestamp_s").alias("t"), F.col("state_id").alias("id"), round_no(F.col("stage"), F.col("round")).alias("round_no"), each.alias("x"))
    from_s = from_s.where("x.v >= 0 or (x.field = 'gold' and round_no is not null)").select("match_id", "x.field", "t", F.lit("s").alias("src"), "id", F.when(F.col("x.v") >= 0, F.col("x.v")).alias("v"), F.lit(False).alias("bad"), "round_no")
    return from_o.unionByName(from_s)


def rolling_scale(v: np.ndarray) -> np.ndarray:
    """For each reading the scaled median absolute deviation (about none) of the source's AROUND moves before it and AROUND after it; infinite where a source has hardly moved. Repeated readings are no moves."""
    moves = np.diff(v)
    at = np.flatnonzero(moves)
    sizes = np.abs(moves[at])
    if len(sizes) < LEAST_MOVES:
        return np.full(len(v), np.inf)
    width = 2 * AROUND
    if len(sizes) <= width:
        rolled = np.array([np.median(sizes)])
    else:
        rolled = np.median(np.lib.stride_tricks.sliding_window_view(sizes, width), axis=1)
    # At the ends of a source the window is the first or the last one that is whole.
    window = np.clip(np.searchsorted(at, np.arange(len(v))) - AROUND, 0, len(rolled) - 1)
    return np.maximum(1.4826 * rolled[window], LEAST_SCALE)


def _excursions(v: np.ndarray) -> np.ndarray:
    """Indices of readings that leave the course for up to WIDEST readings and come back, by more than the source's own moves allow.

    The median of a block and its two neighbours clamps the block between them; its distance from
    that median is how far it left and came back. In each pass all blocks that are the farthest
    among those they overlap are taken out together, until none is left, so that a neighbour
    of a spike is judged once the spike is out.
    """
    limits = DEVIATIONS * rolling_scale(v)
    idx = np.arange(len(v))
    for width in range(1, WIDEST + 1):
        while len(idx) > width + 1:
            w, limit = v[idx], limits[idx][1:-1]
            n = len(w) - width - 1
            block = np.lib.stride_tricks.sliding_window_view(w[1:-1], width)
            top, low = block.max(1), block.min(1)
            limit = np.lib.stride_tricks.sliding_window_view(limit, width).max(1)
            a, b = w[:n], w[width + 1 :]
            dip = np.where(b - a <= limit, np.minimum(a, b) - top, 0)  # a field that starts anew does not come back, it goes higher
            e = np.maximum(np.maximum(low - np.maximum(a, b), dip), 0)
            far = np.where(e > limit, e, 0)
            if not far.any():
                break
            reach = max(width - 1, 1)
            side = np.lib.stride_tricks.sliding_window_view(np.r_[np.zeros(reach), far, np.zeros(reach)], reach)
            before, after = side[:n].max(1), side[reach + 1 :].max(1)
            hit = (far > 0) & (far >= after) & ((far > before) if width > 1 else (far >= before))
            idx = np.delete(idx, np.unique(np.flatnonzero(hit)[:, None] + 1 + np.arange(width)))
    return np.setdiff1d(np.arange(len(v)), idx, assume_unique=True)


def _stuck(t: np.ndarray, v: np.ndarray, rounds_t: np.ndarray, rounds: np.ndarray, round_s: float) -> np.ndarray:
    """Indices of all but the first of equal readings over which several rounds pass."""
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    last = np.r_[first[1:], len(v)] - 1
    out = []
    for a, b in zip(first, last):
        if b - a + 1 < STUCK_READINGS:
            continue
        seen = rounds[max(0, np.searchsorted(rounds_t, t[a], "right") - 1) : np.searchsorted(rounds_t, t[b], "right")]
        passed = max(len(np.unique(seen)) - 1, int((t[b] - t[a]) / round_s))
        if passed >= STUCK_ROUNDS:
            out.append(np.arange(a + 1, b + 1))
    return np.concatenate(out) if out else first[:0]


def _judge(field: str, t: np.ndarray, v: np.ndarray, src: np.ndarray, round_no: np.ndarray) -> np.ndarray:
    """0 none, 1 spike, 2 stuck, for the ordered readings of one source and segment; v is NaN where nothing can be judged."""
    verdict = np.zeros(len(v), np.int8)
    good = np.isfinite(v)
    timed = np.isfinite(round_no)
    rt, rn = t[timed], round_no[timed]
    changes = int((rn[1:] != rn[:-1]).sum()) if len(rn) > 1 else 0
    round_s = (rt[-1] - rt[0]) / changes if changes and rt[-1] > rt[0] else np.inf

    def stuck(among: np.ndarray) -> np.ndarray:
        found = [np.flatnonzero(among & (src == s)) for s in ("o", "s")]
        return np.concatenate([ix[_stuck(t[ix], v[ix], rt, rn, round_s)] for ix in found if len(ix)] or [np.array([], int)])

    frozen = stuck(good) if field == "gold" else np.array([], int)
    live = good.copy()
    live[frozen] = False
    ix = np.flatnonzero(live)
    spikes = ix[_excursions(v[ix])]
    if field == "gold" and len(spikes):
        rest = good.copy()
        rest[spikes] = False
        frozen = np.union1d(frozen, stuck(rest))
    verdict[frozen] = 2
    verdict[spikes] = 1
    return verdict


_REASONS = np.array(["", "spike", "stuck", "bounds"], object)
_TYPES = {"o": "observation", "s": "game_state"}


def _judge_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rest: pd.DataFrame | None = None
    keys = ["match_id", "field", "segment"]

    def judged(df: pd.DataFrame) -> pd.DataFrame:
        same = (df["src"].values[1:] == df["src"].values[:-1]) & (df["id"].values[1:] == df["id"].values[:-1]) & (df["t"].values[1:] == df["t"].values[:-1])
        codes = [pd.factorize(df[k], use_na_sentinel=False)[0] for k in keys]
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)]
        df = df[np.r_[True, ~same | new[1:]]]
        codes = [pd.factorize(df[k], use_na_sentinel=False)[0] for k in keys]
        starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)])
        t, bad, src, field, seg = (df[c].values for c in ("t", "bad", "src", "field", "segment"))
        v = np.where(bad, np.nan, df["v"].values.astype(float))
        rn = df["round_no"].values.astype(float)
        code = np.zeros(len(df), np.int8)
        for a, b in zip(starts, np.r_[starts[1:], len(df)]):
            if seg[a] != UNTIMED:
                code[a:b] = _judge(field[a], t[a:b].astype(float), v[a:b], src[a:b], rn[a:b])
        code[bad.astype(bool)] = 3
        hit = (code > 0) & df["own"].values
        out = df[hit]
        return pd.DataFrame({"record_type": out["src"].map(_TYPES), "record_id": out["id"], "field": out["field"], "reason": _REASONS[code[hit]]})

    for batch in batches:
        df = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if df.empty:
            continue
        tail = df.iloc[-1]
        in_last = np.ones(len(df), bool)
        for k in keys:
            in_last &= (df[k].isna() if pd.isna(tail[k]) else df[k] == tail[k]).values
        whole, rest = df[~in_last], df[in_last]
        if len(whole):
            yield judged(whole)
    if rest is not None and len(rest):
        yield judged(rest)


def implausible_readings(observations: DataFrame, states: DataFrame) -> DataFrame:
    """Readings of gold and hp that are wrong: record_type, record_id, field, reason (bounds, spike, stuck).

    bounds: the field cannot hold the value. spike: the reading leaves its source's course
    for at most three readings and comes back, by more than 1.5 deviations of the moves the
    source makes around it; changes that last are none. stuck (gold): at least four equal readings of one reader
    over which at least three rounds pass, all but the first. A re-sent record gives one
    row. A reading without a usable time is only held against the bounds; a null match is a
    source of its own. A source that has moved less than three times has no usual behaviour and
    no spikes. Empty tables give no rows.

    A source is judged in segments of four hours, each with half an hour more on either
    side, so a recorder that never stops is spread over many tasks.
    """
    rows = readings(observations, states)
    spread = rows.select("*", F.explode(_segments(F.col("t"))).alias("segment")).withColumn("own", F.col("segment") == _segment(F.col("t")))
    placed = spread.repartition("match_id", "field", "segment").sortWithinPartitions("match_id", "field", "segment", "t", "src", "id")
    return placed.select("match_id", "field", "segment", "t", "src", "id", "v", "bad", F.col("round_no").cast("double").alias("round_no"), "own").mapInPandas(_judge_partition, _OUT)
