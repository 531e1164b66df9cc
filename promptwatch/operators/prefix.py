"""Ordered running totals that stay parallel when one key holds most of the rows.

A plain ``sum() OVER (PARTITION BY key ORDER BY t)`` puts a whole key into one task.
Here a key's timeline is cut into fixed slices: each slice is summed where it lies, the
slice totals (whose number is bounded by time, not by rows) are accumulated, and every
row adds its slice's offset to the running sum inside its slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(
    df: DataFrame, keys: list[str], ts: str, values: list[str], slice_us: int,
    order: list[str] | None = None, totals_of: DataFrame | None = None,
) -> DataFrame:
    """Replace each column of ``values`` by its running total within ``keys``.

    Without ``order``, rows with equal ``ts`` see each other; with it, ties are broken by
    those columns. NULL values count as zero. ``totals_of`` has the same keys, times and
    values as ``df`` where those can be read more cheaply.
    """
    sl = "_slice"
    position = F.floor(F.col(ts) / slice_us).alias(sl)
    df = df.select("*", position)
    light = df if totals_of is None else totals_of.select("*", position)
    totals = light.groupBy(*keys, sl).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy(sl).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, sl, *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    if order is None:
        inside = Window.partitionBy(*keys, sl).orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    else:
        inside = Window.partitionBy(*keys, sl).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({v: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    # NULL keys are a group of their own, so the join compares them as equal
    named = offsets.withColumnsRenamed({c: f"_k_{c}" for c in [*keys, sl]})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, sl]])
    joined = local.join(named, same).drop(*[f"_k_{c}" for c in [*keys, sl]])
    return joined.withColumns({v: F.col(v) + F.col(f"_o_{v}") for v in values}).drop(
        sl, *[f"_o_{v}" for v in values]
    )


def previous_in_key(df: DataFrame, keys: list[str], ts: str, order: str, slice_us: int) -> DataFrame:
    """Add ``previous_us``: the time of the row before, as ``lag`` would, slice by slice."""
    df = df.withColumn("_slice", F.floor(F.col(ts) / slice_us))
    ends = df.groupBy(*keys, "_slice").agg(F.max(ts).alias("_last"))
    earlier = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice"))
    ends = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_k__slice"), earlier.alias("_earlier"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, "_slice"]])
    inside = F.lag(ts).over(Window.partitionBy(*keys, "_slice").orderBy(ts, order))
    placed = df.withColumn("_inside", inside).join(ends, same)
    return placed.withColumn("previous_us", F.coalesce("_inside", "_earlier")).drop(
        "_slice", "_inside", "_earlier", *[f"_k_{c}" for c in [*keys, "_slice"]]
    )


def latest_mark(
    df: DataFrame, marks: DataFrame, key: str, ts: str, rank: str, payload: list[str], out: str, slice_us: int
) -> DataFrame:
    """Add ``out``: the newest of ``marks`` of the same key at or before each row (an as-of join).

    ``marks`` has columns ``key, ts, rank`` (breaks ties of ``ts``) and ``payload``; the
    result is the struct ``(ts, rank, *payload)`` or NULL. Nothing is paired up: the two
    sides are merged in time, slice by slice, so a key may be frequent on both.
    """
    mark = F.struct(F.col(ts).alias("ts"), F.col(rank).alias("rank"), *payload).alias("_mark")
    marked = marks.select(key, ts, mark)
    rows = df.select("*", F.lit(None).cast(marked.schema["_mark"].dataType).alias("_mark"), F.lit(True).alias("_row"))
    position = F.floor(F.col(ts) / slice_us).alias("_slice")
    ends = (
        df.select(key, ts).unionByName(marked, allowMissingColumns=True).select("*", position)
        .groupBy(key, "_slice").agg(F.max("_mark").alias("_last"))
    )
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        F.col(key).alias("_k_key"), F.col("_slice").alias("_k_slice"), F.max("_last").over(before).alias("_earlier")
    )
    inside = Window.partitionBy(key, "_slice").orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    merged = rows.unionByName(marked, allowMissingColumns=True).select("*", position)
    placed = merged.withColumn("_here", F.max("_mark").over(inside)).filter("_row")
    same = F.col(key).eqNullSafe(F.col("_k_key")) & (F.col("_slice") == F.col("_k_slice"))
    return placed.join(ends, same).withColumn(out, F.coalesce("_here", "_earlier")).drop(
        "_mark", "_row", "_slice", "_here", "_k_key", "_k_slice", "_earlier"
    )


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, or None when there are none.

    There are at most ``rows / hot_rows`` of them, which bounds what callers broadcast.
    Only the key columns are read.
    """
    hot = df.groupBy(*keys).count().filter(F.col("count") > hot_rows).drop("count")
    return hot if not hot.isEmpty() else None
