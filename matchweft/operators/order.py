"""Order within a match, and helpers that keep it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..session import cut_lineage

#: Seconds of a match that one task scans at a time.
CHUNK_S = 3_600


def in_match(time: str = "timestamp_s", id_: str = "event_id", *more: str) -> WindowSpec:
    """The canonical order of a match's records: by time, ties by id."""
    return Window.partitionBy("match_id", *more).orderBy(time, id_)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, for logs in which a record may be delivered twice with the same content."""
    return df.dropDuplicates(list(keys))


def differs(c: Column, before: Column) -> Column:
    """True if the values differ, a null counting as a value."""
    return ~c.eqNullSafe(before)


def latest(df: DataFrame, key: str, time: str, id_: str) -> DataFrame:
    """The last row of each key by time and id, by one partial aggregate, so a hot key is never sorted. Rows without a time come first."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.coalesce(F.nanvl(F.col(time), F.lit(float("-inf"))), F.lit(float("-inf"))), F.coalesce(F.col(id_), F.lit(""))))
    return df.groupBy(key).agg(best.alias("r")).select("r.*")


#: Chunk of rows whose time is null or not finite; it sorts before all others.
NO_CHUNK = -(2**62)


def _chunked(df: DataFrame, keys: list[str], time: str, chunk_s: float) -> tuple[DataFrame, list[str]]:
    """The rows with their keys and chunk as columns that are never null, so that windows, aggregates and joins on them share one partitioning."""
    t = F.col(time)
    finite = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    chunk = F.when(finite, F.floor(F.least(F.greatest(t / chunk_s, F.lit(-1e15)), F.lit(1e15)))).cast("bigint")  # whatever lies farther shares the last chunk
    at = [f"__k{i}" for i in range(len(keys))]
    named = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")).alias(n) for k, n in zip(keys, at)]
    return df.select("*", *named, F.coalesce(chunk, F.lit(NO_CHUNK)).alias("__c")), at


def scan(df: DataFrame, keys: list[str], time: str, id_: str, running: dict[str, tuple[str, Column]], backwards: bool = False, chunk_s: float = CHUNK_S) -> DataFrame:
    """Running values along each key's order (time, then id), with no key in one task.

    ``running`` names new columns, each a kind and an expression: ``last`` (the last value so far
    that is not null), ``sum``, ``count`` (of values that are not null), ``min``, ``before``
    (a struct ``v`` of the row before, null for the first row) or ``most_before`` (the greatest
    value of all rows before). ``backwards`` runs from the end.

    Rows are scanned within (key, hour); what the hours before bring in comes from one row for
    each (key, hour), made by a partial aggregate, and is joined to the hour. Rows whose time is
    null or not finite are an hour of their own, in front.
    """
    rows, at = _chunked(df, keys, time, chunk_s)
    rows = rows.select("*", *[x.alias(f"__x_{n}") for n, (_, x) in running.items()])
    ways = [F.desc_nulls_last(c) for c in (time, id_)] if backwards else [F.asc_nulls_first(c) for c in (time, id_)]
    w = Window.partitionBy(*at, "__c").orderBy(*ways)
    upto, ahead = so_far(w), w.rowsBetween(Window.unboundedPreceding, -1)
    far = F.max_by if not backwards else F.min_by
    order = F.struct(time, id_)
    hours = Window.partitionBy(*at).orderBy(F.desc("__c") if backwards else F.asc("__c"))
    earlier = hours.rowsBetween(Window.unboundedPreceding, -1)
    here, totals, carried, joined = [], [], [], []
    for n, (kind, _) in running.items():
        x, h, b = F.col(f"__x_{n}"), F.col(f"__h_{n}"), F.col(f"__b_{n}")
        if kind == "before":
            here.append(F.lag(F.struct(x.alias("v"))).over(w))
            totals.append(far(F.struct(x.alias("v")), order))
            carried.append(F.lag(f"__t_{n}").over(hours))
            joined.append(F.coalesce(h, b))
        elif kind == "last":
            here.append(F.last(x, ignorenulls=True).over(upto))
            totals.append(far(x, F.when(x.isNotNull(), order)))
            carried.append(F.last(f"__t_{n}", ignorenulls=True).over(earlier))
            joined.append(F.coalesce(h, b))
        elif kind == "most_before":
            here.append(F.max(x).over(ahead))
            totals.append(F.max(x))
            carried.append(F.max(f"__t_{n}").over(earlier))
            joined.append(F.greatest(h, b))
        else:
            made = {"sum": F.sum, "count": F.count, "min": F.min}[kind]
            here.append(made(x).over(upto))
            totals.append(made(x))
            carried.append((F.min if kind == "min" else F.sum)(f"__t_{n}").over(earlier))
            joined.append(F.least(h, b) if kind == "min" else h + F.coalesce(b, F.lit(0)) if kind == "count" else F.coalesce(h + b, h, b))
    names = list(running)
    inside = rows.select("*", *[c.alias(f"__h_{n}") for n, c in zip(names, here)])
    hourly = rows.groupBy(*at, "__c").agg(*[c.alias(f"__t_{n}") for n, c in zip(names, totals)])
    brought = hourly.select(*at, "__c", *[c.alias(f"__b_{n}") for n, c in zip(names, carried)])
    return inside.join(brought, [*at, "__c"], "left").select(*df.columns, *[c.alias(n) for n, c in zip(names, joined)])


def stretches(df: DataFrame, keys: list[str], time: str, id_: str, value: Column, breaks: Callable[[Column, Column], Column], chunk_s: float = CHUNK_S) -> DataFrame:
    """Stretches of rows along each key's order: all columns, ``stretch_no`` (from 1 in each key) and ``stretch_place`` (from 1 in each stretch).

    A stretch begins with the first row of a key and wherever ``breaks(value, value before)`` holds.
    Stretches are counted within (key, hour) in one pass, which is kept in the checkpoint folder;
    one row for each (key, hour) then says what the hours before bring in, whether the hour's
    first row goes on their last stretch included.
    """
    rows, at = _chunked(df, keys, time, chunk_s)
    w = Window.partitionBy(*at, "__c").orderBy(F.asc_nulls_first(time), F.asc_nulls_first(id_))
    rows = rows.withColumn("__v", F.struct(value.alias("v")))
    rows = rows.select("*", F.lag("__v").over(w).alias("__p"), F.row_number().over(w).cast("bigint").alias("__r"))
    rows = rows.withColumn("__n", F.when(F.col("__p").isNotNull() & breaks(F.col("__v.v"), F.col("__p.v")), F.col("__r")))
    inside = cut_lineage(rows.select(*df.columns, *at, "__c", "__v", "__r", F.count("__n").over(so_far(w)).alias("__i"), F.max("__n").over(so_far(w)).alias("__s")))
    hourly = inside.groupBy(*at, "__c").agg(F.max("__i").alias("i"), F.max("__r").alias("r"), F.max("__s").alias("s"), F.min_by("__v", "__r").alias("first"), F.max_by("__v", "__r").alias("last"))
    hours = Window.partitionBy(*at).orderBy("__c")
    earlier = hours.rowsBetween(Window.unboundedPreceding, -1)
    before = F.lag("last").over(hours)
    hourly = hourly.withColumn("opens", F.coalesce(before.isNull() | breaks(F.col("first.v"), before["v"]), F.lit(False)))
    hourly = hourly.withColumn("at", F.coalesce(F.sum("r").over(earlier), F.lit(0)))
    begun = F.when(F.col("s").isNotNull(), F.col("at") + F.col("s")).when(F.col("opens"), F.col("at") + 1)  # where the hour's last stretch began
    brought = hourly.select(
        *at, "__c", "at", (F.coalesce(F.sum(F.col("i") + F.col("opens").cast("bigint")).over(earlier), F.lit(0)) + F.col("opens").cast("bigint")).alias("no"),
        F.when(F.col("opens"), F.col("at") + 1).otherwise(F.max(begun).over(earlier)).alias("start"),
    )
    place = F.col("at") + F.col("__r") - F.coalesce(F.col("at") + F.col("__s"), "start") + 1
    return inside.join(brought, [*at, "__c"]).select(*df.columns, (F.col("no") + F.col("__i")).alias("stretch_no"), place.alias("stretch_place"))


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_id: str, take: list[str]) -> DataFrame:
    """Left rows with columns of the last right row at or before their time; null where there is none.

    Both sides are put in one order and the last right row is carried forward by ``scan``, so
    there is no range join and no key in one task. A right row at the same time counts. Left
    rows without a key or a finite time get nulls.
    """
    l_side = left.select(F.col(key).alias("__k"), F.col(left_time).alias("__t"), F.lit("1").alias("__id"), F.struct(*left.columns).alias("__left"))
    usable = F.col(key).isNotNull() & F.col(right_time).between(-1e15, 1e15)
    r_side = right.where(usable).select(F.col(key).alias("__k"), F.col(right_time).alias("__t"), F.concat(F.lit("0"), F.col(right_id).cast("string")).alias("__id"), F.struct(*take).alias("__right"))
    both = l_side.unionByName(r_side, allowMissingColumns=True)
    carried = scan(both, ["__k"], "__t", "__id", {"__found": ("last", F.col("__right"))}).where("__left is not null")
    fine = F.col("__k").isNotNull() & F.col("__t").between(-1e15, 1e15)
    return carried.select("__left.*", *[F.when(fine, F.col(f"__found.{c}")).alias(c) for c in take])


def within(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, bucket_s: float = 60.0, most: int = 64) -> DataFrame:
    """Points joined with the intervals of their key that hold them, bounds included; the columns of both, the key once.

    An interval is dealt to the buckets of time that it touches and meets only the points of those,
    so the join is on equal (key, bucket). Intervals over more than ``most`` buckets are dealt to
    buckets ``most`` times as wide, and so on in three widths; each point is in one bucket of
    each width. Rows without a key or finite times take no part. Other columns must differ in name.
    """
    t, a, b = F.col(time), F.col(start), F.col(end)
    finite = lambda c: c.between(-1e15, 1e15)
    spans = intervals.where(F.col(key).isNotNull() & finite(a) & finite(b) & (a <= b))
    widths = [bucket_s * float(most) ** i for i in range(3)]
    bucket = lambda c, w: F.floor(c / w).cast("bigint")
    level = F.lit(2)
    for i in (1, 0):
        level = F.when(b - a <= widths[i] * (most - 1), i).otherwise(level)
    at = lambda c: F.when(F.col("__level") == 0, bucket(c, widths[0])).when(F.col("__level") == 1, bucket(c, widths[1])).otherwise(bucket(c, widths[2]))
    dealt = spans.withColumn("__level", level).withColumn("__bucket", F.explode(F.sequence(at(a), at(b))))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("__level"), bucket(t, w).alias("__bucket")) for i, w in enumerate(widths)]))
    placed = points.where(finite(t)).select("*", each.alias("__p")).select(*points.columns, "__p.*")
    return placed.join(dealt, [key, "__level", "__bucket"]).where((t >= a) & (t <= b)).drop("__level", "__bucket")
