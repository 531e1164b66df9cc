"""Campaign detection: how many distinct senders used this prompt in the last minutes?

A sliding distinct count is turned into interval arithmetic. A sender is *present* at t
if one of its events lies in [t - window, t], so its events open intervals that merge
when they are closer than the window. The number of senders at t is the number of open
intervals: +1 where one starts, -1 where it ends, summed up to t. Events are first
reduced to one row per key, sender and slice (a slice is shorter than the window, so all
events in it share one interval), which makes repeats from a hot sender collapse before
any shuffle; no task ever holds all rows of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptwatch.functions.fingerprints import campaign_id
from promptwatch.operators.prefix import running_sum
from promptwatch.params import SECOND_US, Params


def _presence_edges(df: DataFrame, key: str, member: list[str], ts: str, window_us: int, out: str) -> DataFrame:
    """Rows ``key, ts, out`` with +1 / -1 where a member's presence starts / has ended."""
    slices = (
        df.groupBy(key, *member, F.floor(F.col(ts) / window_us).alias("_s"))
        .agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    )
    w = Window.partitionBy(key, *member).orderBy("_s")
    prev, nxt = F.lag("_hi").over(w), F.lead("_lo").over(w)
    marked = slices.select(
        key,
        F.when(prev.isNull() | (F.col("_lo") - prev > window_us), F.col("_lo")).alias("_start"),
        F.when(nxt.isNull() | (nxt - F.col("_hi") > window_us), F.col("_hi") + window_us + 1).alias("_end"),
    )
    edges = F.array(
        F.struct(F.col("_start").alias(ts), F.lit(1).cast("long").alias(out)),
        F.struct(F.col("_end").alias(ts), F.lit(-1).cast("long").alias(out)),
    )
    return marked.select(key, F.inline(edges)).filter(F.col(ts).isNotNull())


def distinct_in_window(
    df: DataFrame, key: str, members: dict[str, list[str]], ts: str, window_us: int,
    slice_us: int | None = None, events: DataFrame | None = None,
) -> DataFrame:
    """Add, per entry of ``members``, the number of distinct members of ``key`` in
    ``[t - window, t]`` at each row. Rows with equal ``ts`` see each other.

    ``events`` are the rows that count, when they are cheaper to read than ``df`` itself.
    """
    events = df if events is None else events
    names = list(members)
    edges = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [_presence_edges(events, key, members[n], ts, window_us, n) for n in names],
    )
    empty = [F.lit(None).cast("long").alias(n) for n in names]
    rows = df.select("*", *empty, F.lit(True).alias("_row"))
    stream = rows.unionByName(edges, allowMissingColumns=True)
    points = events.select(key, ts, *empty).unionByName(edges)
    counted = running_sum(stream, [key], ts, names, slice_us or max(window_us // 60, 1), totals_of=points)
    return counted.filter("_row").drop("_row")


def exact_confidence(n: Column) -> Column:
    return F.bround(F.least(F.lit(0.95), 0.5 + n * 0.1), 2)


def fuzzy_confidence(n: Column) -> Column:
    return F.bround(F.least(F.lit(0.85), 0.4 + n * 0.08), 2)


SENDER = ["user_id", "client_ip"]


def campaign_exact(df: DataFrame, key: str = "prompt_hash", ts: str = "ts_us", params: Params = Params()) -> DataFrame:
    """Add ``exact_count, ip_count`` over the exact fingerprint."""
    return distinct_in_window(
        df, key, {"exact_count": SENDER, "ip_count": ["client_ip"]}, ts, params.correlation_window_s * SECOND_US
    )


def campaign_fuzzy(
    df: DataFrame, key: str = "prompt_pattern", ts: str = "ts_us", params: Params = Params(),
    events: DataFrame | None = None,
) -> DataFrame:
    """Add ``fuzzy_count`` over the first-words fingerprint."""
    return distinct_in_window(
        df, key, {"fuzzy_count": SENDER}, ts, params.correlation_window_s * SECOND_US, events=events
    )


def correlation_check(df: DataFrame, ts: str = "ts_us", params: Params = Params()) -> DataFrame:
    """Needs ``prompt_hash, prompt_pattern, user_id, client_ip``; adds the campaign verdict.

    The exact fingerprint is asked first, the fuzzy one (which needs one sender more)
    only where it is silent. Three addresses on one exact fingerprint are a distributed
    attack whatever the sender counts say.
    """
    return campaign_verdict(campaign_fuzzy(campaign_exact(df, ts=ts, params=params), ts=ts, params=params, events=df), params)


def campaign_verdict(df: DataFrame, params: Params = Params()) -> DataFrame:
    """The verdict of counted requests (``exact_count, fuzzy_count, ip_count, prompt_hash``)."""
    exact = F.col("exact_count") >= params.campaign_threshold
    fuzzy = F.col("fuzzy_count") >= params.campaign_threshold + 1
    df = df.withColumn("distributed", F.col("ip_count") >= 3)
    detected = exact | fuzzy | F.col("distributed")
    return df.withColumns({
        "campaign_detected": detected,
        "campaign_id": F.when(detected, campaign_id(F.col("prompt_hash"))),
        "confidence": F.when(exact, exact_confidence(F.col("exact_count")))
        .when(fuzzy, fuzzy_confidence(F.col("fuzzy_count"))).otherwise(0.0),
    })
