"""Containers of fixed capacity filled by variable-capacity best fit.

What best fit does with an item depends on its size only, so the packing is found on the
histogram of sizes: all items of a size, largest size first, go to the fullest bins that
still take them, many equal bins at a time. The histogram has at most as many rows as the
capacity; items then find their bin by their rank among the items of their size.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

#: Items that one task ranks at a time, and empty items for each bin where there are no others.
RANKED_AT_ONCE, EMPTY_PER_BIN = 100_000, 100_000
MAX_CAPACITY = 1_000_000


@dataclass
class Plan:
    """segments: (size, first rank, end rank, first bin, items of this size per bin)."""

    segments: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    n_bins: int = 0
    #: Capacity of all bins together once each is as small as its contents allow.
    room: int = 0


def _cheapest(size: int, capacities: list[int]) -> int:
    """The permitted capacity that costs least for each token of such items in it; the larger one among equals."""
    return min((c for c in capacities if c >= size), key=lambda c: (c / (c // size * size), -c))


def plan_bins(histogram: dict[int, int], capacities: list[int]) -> Plan:
    """Best fit over a histogram of sizes from 1 to the largest capacity.

    The permitted capacities are tried jointly (each bin opened at what costs least for its first
    item) and one by one (each bin opened at this one, or at the next that holds the item); all bins are
    then downsized to their contents, and the plan that takes the least room is kept.
    """
    capacities = sorted(set(capacities))
    tried = [_best_fit(histogram, capacities, lambda size: _cheapest(size, capacities))]
    if len(capacities) > 1:
        tried += [_best_fit(histogram, capacities, lambda size, c=c: next(x for x in capacities if x >= max(size, c))) for c in capacities]
    return min(tried, key=lambda p: (p.room, p.n_bins))


def _best_fit(histogram: dict[int, int], capacities: list[int], opening: Callable[[int], int]) -> Plan:
    plan, n_bins = Plan(), 0
    room: list[int] = []
    open_: dict[int, list[tuple[int, int, int]]] = {}

    def put(left: int, first: int, end: int, capacity: int) -> None:
        if first < end:
            if left not in open_:
                open_[left] = []
                insort(room, left)
            heapq.heappush(open_[left], (first, end, capacity))

    for size in sorted(histogram, reverse=True):
        n, rank = histogram[size], 0
        while rank < n:
            at = bisect_left(room, size)
            if at < len(room):
                left = room[at]
                first, end, capacity = heapq.heappop(open_[left])
                if not open_[left]:
                    del open_[left], room[at]
            else:
                left = capacity = opening(size)
                first = n_bins
                end = n_bins = first + -(-(n - rank) // (capacity // size))
            per = left // size
            whole = min(end - first, (n - rank) // per)
            if whole:
                plan.segments.append((size, rank, rank + whole * per, first, per))
                put(left - per * size, first, first + whole, capacity)
                rank += whole * per
            if first + whole < end:
                rest = min(n - rank, per - 1) if rank < n else 0
                if rest:
                    plan.segments.append((size, rank, rank + rest, first + whole, per))
                    put(left - rest * size, first + whole, first + whole + 1, capacity)
                    rank += rest
                put(left, first + whole + bool(rest), end, capacity)
    plan.n_bins = n_bins
    for left, bins in open_.items():
        for first, end, capacity in bins:
            plan.room += (end - first) * capacities[bisect_left(capacities, capacity - left)]
    return plan


def pack(items: DataFrame, id_: str, size: str, capacities: list[int]) -> DataFrame:
    """Pack items into bins of the permitted capacities: id, piece, n_pieces, size, bin_id, capacity.

    An item larger than the largest capacity is split into pieces of that capacity and a
    rest; no other item is split. The permitted capacities are optimised jointly (``plan_bins``),
    and bins end as the smallest permitted one that holds their contents. Items of size 0 (null
    or empty) take no room and are dealt to the bins by hash, to bins of their own only where
    there is no other item. A null size counts as 0. Null and repeated ids are items like others. An
    empty table gives no rows.

    The sizes' histogram and the plan (bounded by the capacity, at most a million) are all that
    the driver sees. Ranks are counted within (size, bucket), with as many buckets as the items
    need, and shifted by the counts of the buckets before, so no size is collected into one task.
    """
    limits = sorted({int(c) for c in capacities})
    if not limits or limits[0] < 1 or limits[-1] > MAX_CAPACITY:
        raise ValueError("capacities must lie between 1 and a million")
    top = limits[-1]
    sized = items.select(F.col(id_).alias("id"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("whole"))
    n_pieces = F.greatest(F.ceil(F.col("whole") / top), F.lit(1)).cast("bigint")
    n_all = sized.agg(F.sum(n_pieces)).first()[0] or 0
    buckets = max(64, n_all // RANKED_AT_ONCE)
    pieces = sized.withColumn("n_pieces", n_pieces).select("id", "n_pieces", "whole", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_pieces") - 1)).alias("piece"))
    pieces = pieces.select("id", "piece", "n_pieces", F.least(F.col("whole") - F.col("piece") * top, F.lit(top)).alias("size"), F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).alias("bucket"))
    counts = pieces.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    n_empty = histogram.pop(0, 0)
    plan = plan_bins(histogram, limits)

    by_size: dict[int, list] = {s: [] for s in (*histogram, 0)}
    for s, a, b, first, per in plan.segments:
        by_size[s].append((a, b, first, per))
    segments = items.sparkSession.createDataFrame(list(by_size.items()), "size bigint, segments array<struct<a:bigint,b:bigint,first:bigint,per:bigint>>")
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id", "piece")))
    # Segments have a row for each size up to the capacity; whether they are broadcast is decided by their size.
    placed = ranked.join(offsets, ["size", "bucket"]).join(segments, "size").withColumn("rank", F.col("rank") + F.col("offset") - 1)
    placed = placed.withColumn("s", F.get(F.filter("segments", lambda s: (F.col("rank") >= s["a"]) & (F.col("rank") < s["b"])), F.lit(0)))
    empty_at = F.pmod(F.xxhash64("id"), F.lit(plan.n_bins or 1 + n_empty // EMPTY_PER_BIN))
    bin_id = F.when(F.col("size") == 0, empty_at).otherwise(F.col("s.first") + F.floor((F.col("rank") - F.col("s.a")) / F.col("s.per")))
    placed = placed.select(F.col("id").alias(id_), "piece", "n_pieces", "size", bin_id.cast("bigint").alias("bin_id"))
    # A bin has no more items than its capacity, but for empty ones, which are dealt evenly.
    fill = F.sum("size").over(Window.partitionBy("bin_id"))
    least = F.lit(top)
    for c in reversed(limits):
        least = F.when(fill <= c, F.lit(c)).otherwise(least)
    return placed.withColumn("capacity", least.cast("bigint"))
