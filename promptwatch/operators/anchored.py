"""Windows anchored at the first event of a key.

A window opens at a key's first event and lasts ``length``; the next one opens at the
first event after it has ended. Neither epoch-aligned nor gap-extended windows express
this, because each start depends on the one before it.

Ordinary keys are solved batch by batch: a row points to the row that would open the next window, found by one sort
of times and window ends, and the chain from each key's first row is marked by doubling the pointers; no step is taken
row by row. A key with more rows than ``hot_rows`` is solved
without ever being gathered in one task: every event points to the event that would open
the next window, and the chain that begins at the first event is marked by pointer
doubling, which needs log2(number of windows) joins on evenly spread (key, time) pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptwatch.operators.fold import sorted_batches
from promptwatch.operators.prefix import hot_keys, running_sum
from promptwatch.params import SECOND_US, Params
from promptwatch.sources.workspace import checkpoint, materialize


def anchored_window(
    df: DataFrame, keys: list[str], ts: str, length_us: int, order: str, hot_rows: int = Params.hot_rows
) -> DataFrame:
    """Add ``window_start`` (same unit as ``ts``) and ``window_index`` (1 for the opener).

    ``order`` breaks ties of ``ts``. Carry only narrow columns through this operator.
    """
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return _folded(df, keys, ts, length_us, order)
    cold_part = df.join(hot, keys, "left_anti")
    hot_part = df.join(hot, keys, "left_semi")
    return _folded(cold_part, keys, ts, length_us, order).unionByName(
        doubled_windows(hot_part, keys, ts, length_us, order)
    )


def window_openers(t: np.ndarray, new: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Whether each row opens a window; rows are sorted by key and time ``t``.

    ``new`` marks a key's first row, ``first`` the rows where the chains begin.
    """
    n, key = len(t), np.cumsum(new)
    # the first row of the same key at or after t + length, by sorting rows and window ends together
    times, keys = np.concatenate([t, t + length]), np.concatenate([key, key])
    probe = np.repeat([1, 0], n)  # an end stands before the rows of its time
    order = np.lexsort((probe, times, keys))
    row = np.where(order < n, order, n)
    later = np.minimum.accumulate(row[::-1])[::-1]
    jump = np.full(n + 1, n)
    ends = order >= n
    jump[order[ends] - n] = later[ends]
    jump[:n][(jump[:n] < n) & (key[np.minimum(jump[:n], n - 1)] != key)] = n
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    while (jump[:n] < n).any():  # as often as the longest chain has binary digits
        opens[jump[opens]] = True
        jump = jump[jump]
    return opens[:n]


def _folded(df: DataFrame, keys: list[str], ts: str, length_us: int, order: str) -> DataFrame:
    def solve(batch: pa.RecordBatch, new: np.ndarray, goes_on: bool, state: tuple | None) -> tuple[list[pa.Array], tuple]:
        t = batch.column(ts).to_numpy()
        first = np.flatnonzero(new)
        start, held, inside = 0, 0, 0  # rows that still belong to the window of the batch before
        if goes_on:
            start, held = state
            end = int(first[0]) if len(first) else len(t)
            inside = int(np.searchsorted(t[:end], start + length_us))
            if inside < end:
                first = np.concatenate([[inside], first])
        opens = window_openers(t, new, first, length_us)
        at = np.arange(len(t))
        opener = np.maximum.accumulate(np.where(opens, at, -1))
        began = np.where(opener >= 0, t[np.maximum(opener, 0)], start)
        index = np.where(opener >= 0, at - opener + 1, at + held + 1)
        return [pa.array(began, pa.int64()), pa.array(index, pa.int64())], (int(began[-1]), int(index[-1]))

    return sorted_batches(df, keys, [ts, order], solve, {"window_start": "bigint", "window_index": "bigint"})


def doubled_windows(df: DataFrame, keys: list[str], ts: str, length_us: int, order: str) -> DataFrame:
    """The same result for keys too large for one task."""
    points = checkpoint(df.select(*keys, F.col(ts).alias("_t")).distinct())
    starts = checkpoint(_chain_starts(points, keys, length_us))
    # two starts are at least one length apart, so an aligned bucket of that length holds
    # at most one, and an event's window opened in its own bucket or the one before
    bucket = F.floor(F.col("window_start") / length_us)
    own = starts.withColumn("_b", bucket).withColumnRenamed("window_start", "_own")
    earlier = starts.withColumn("_b", bucket + 1).withColumnRenamed("window_start", "_earlier")
    placed = (
        df.withColumn("_b", F.floor(F.col(ts) / length_us))
        .join(own, [*keys, "_b"], "left").join(earlier, [*keys, "_b"], "left")
        .withColumn("window_start", F.when(F.col("_own") <= F.col(ts), F.col("_own")).otherwise(F.col("_earlier")))
        .drop("_b", "_own", "_earlier")
    )
    numbered = placed.withColumn("window_index", F.lit(1).cast("long"))
    return running_sum(
        numbered, [*keys, "window_start"], ts, ["window_index"], max(length_us // 1000, 1), [order]
    )


def _next_start(points: DataFrame, keys: list[str], length_us: int) -> DataFrame:
    """``keys, _t, _next``: the first event at or after ``_t + length`` (NULL at the end)."""
    slice_us = max(length_us // 1000, 1)
    probes = points.select(*keys, (F.col("_t") + length_us).alias("_at"), F.col("_t").alias("_from"))
    events = points.select(*keys, F.col("_t").alias("_at"), F.lit(None).cast("long").alias("_from"))
    both = events.unionByName(probes).withColumn("_s", F.floor(F.col("_at") / slice_us))
    event_at = F.when(F.col("_from").isNull(), F.col("_at"))
    per_slice = both.groupBy(*keys, "_s").agg(F.min(event_at).alias("_first"))
    # frames run backwards in time: growing frames cost one step per row, shrinking ones do not
    later = Window.partitionBy(*keys).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.select(*keys, "_s", F.min("_first").over(later).alias("_later"))
    inside = Window.partitionBy(*keys, "_s").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    located = both.withColumn("_here", F.min(event_at).over(inside)).filter(F.col("_from").isNotNull())
    return located.join(per_slice, [*keys, "_s"]).select(
        *keys, F.col("_from").alias("_t"), F.coalesce("_here", "_later").alias("_next")
    )


def _chain_starts(points: DataFrame, keys: list[str], length_us: int) -> DataFrame:
    jump = checkpoint(_next_start(points, keys, length_us).filter(F.col("_next").isNotNull()))
    reached = points.groupBy(*keys).agg(F.min("_t").alias("_t"))
    while True:
        # everything reached so far jumps once with a jump of doubled width
        gained = reached.join(jump, [*keys, "_t"]).select(*keys, F.col("_next").alias("_t"))
        grown = checkpoint(reached.unionByName(gained))
        if jump.isEmpty():
            return reached.select(*keys, F.col("_t").alias("window_start"))
        reached = grown
        onward = jump.select(*keys, F.col("_t").alias("_next"), F.col("_next").alias("_far"))
        jump = checkpoint(
            jump.join(onward, [*keys, "_next"]).select(*keys, "_t", F.col("_far").alias("_next"))
        )


def quota_check(
    df: DataFrame, user: str = "user_id", ts: str = "ts_us", order: str = "request_id", params: Params = Params()
) -> DataFrame:
    """Add ``quota_used, quota_allowed``: the first ``quota_limit`` requests of a window pass.

    Rows denied for another reason must be filtered out first; they consume no quota.
    """
    numbered = anchored_window(df, [user], ts, params.quota_window_s * SECOND_US, order, params.hot_rows)
    used = F.least(F.col("window_index"), F.lit(params.quota_limit))
    return numbered.withColumns({
        "quota_used": used.cast("int"),
        "quota_allowed": F.col("window_index") <= params.quota_limit,
    }).drop("window_start", "window_index")


def campaign_log(
    detected: DataFrame, ts: str = "ts_us", order: str = "request_id", params: Params = Params()
) -> DataFrame:
    """One row per campaign and hour: the first detection opens it (``campaign_id, prompt_hash, detected_at``)."""
    narrow = materialize(detected.filter("campaign_detected").select("campaign_id", "prompt_hash", ts, order))
    opened = anchored_window(narrow, ["prompt_hash"], ts, params.campaign_ttl_s * SECOND_US, order, params.hot_rows)
    return opened.filter("window_index = 1").select("campaign_id", "prompt_hash", F.col(ts).alias("detected_at"))


def active_campaigns(log: DataFrame, params: Params = Params()) -> DataFrame:
    """The newest campaigns of the log that a viewer is shown."""
    return log.orderBy(F.desc("detected_at"), "campaign_id").limit(min(params.campaigns_shown, params.campaigns_kept))
