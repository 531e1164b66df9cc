"""The reputation fold for users with too many events for one task.

A user's timeline is cut into chunks of bounded size. Everything that does not depend on
the score itself (expiry, idle time, counters) comes from two-level window sums. The
score does depend on its past, but every read rounds it to one of 1001 values, so what a
chunk does to the score is a table with 1001 entries, worked out for all entries at once
without knowing which one applies. The tables of a user are then chained (one small row
per chunk), which gives every chunk its true starting score, and a last parallel pass
produces the rows. The running average is rounded to one of 10001 values and is treated
the same way; it cannot move any more once it covers some twenty thousand requests.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptwatch.operators.fold import ordered_fold
from promptwatch.operators.reputation import OUTPUTS, Trust, reputation_step
from promptwatch.params import HOUR_US, SECOND_US, Params
from promptwatch.sources.workspace import materialize

#: With this many requests behind it, one more moves the average by less than half a cent.
SETTLED = 20_001
GRID = np.arange(1001) / 1000.0
AVG_GRID = np.arange(10_001) / 100.0


def assign_chunks(df: DataFrame, key: str, ts: str, chunk_rows: int, slice_us: int = 60 * SECOND_US) -> DataFrame:
    """Add ``_chunk``, rising with time within ``key``; about ``chunk_rows`` rows each."""
    df = df.withColumn("_slice", F.floor(F.col(ts) / slice_us))
    sizes = df.groupBy(key, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        key, "_slice", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / chunk_rows).alias("_chunk")
    )
    return df.join(sizes, [key, "_slice"]).drop("_slice")


def running(df: DataFrame, key: str, order: list[str], values: dict[str, tuple[str, Column]], inclusive: bool = False) -> DataFrame:
    """Add running ``max`` / ``sum`` columns over ``key``, chunk by chunk then across chunks."""
    agg = {"max": F.max, "sum": F.sum}
    join2 = {"max": lambda a, b: F.greatest(a, b), "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
    df = df.withColumns({f"_in_{n}": e for n, (_, e) in values.items()})
    totals = df.groupBy(key, "_chunk").agg(*[agg[how](f"_in_{n}").alias(f"_t_{n}") for n, (how, _) in values.items()])
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "_chunk", *[agg[how](f"_t_{n}").over(before).alias(f"_o_{n}") for n, (how, _) in values.items()])
    inside = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    df = df.withColumns({f"_l_{n}": agg[how](f"_in_{n}").over(inside) for n, (how, _) in values.items()})
    df = df.join(totals, [key, "_chunk"])
    df = df.withColumns({n: join2[how](F.col(f"_l_{n}"), F.col(f"_o_{n}")) for n, (how, _) in values.items()})
    return df.drop(*[f"{p}{n}" for n in values for p in ("_in_", "_l_", "_o_")])


def round_many(values: np.ndarray, places: int, mode: str) -> np.ndarray:
    scale = 10.0**places
    if mode != "python":
        return np.floor(values * scale + 0.5) / scale
    scaled = values * scale
    out = np.rint(scaled) / scale
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = round(float(values[i]), places)
    return out


def decay_many(values: np.ndarray, gap_us: int, params: Params) -> np.ndarray:
    hours = gap_us / HOUR_US
    if hours > params.decay_after_h:
        lowered = np.maximum(params.decay_floor, values - params.trust_decay * (hours / 24))
        values = np.minimum(values, lowered) if params.floor_only_lowers else lowered
    return round_many(values, 3, params.rounding)


def change_many(values: np.ndarray, kind: str, cost: float, params: Params) -> np.ndarray:
    if kind == "success":
        return np.minimum(1.0, values + params.trust_boost * (1 - cost / 200))
    if kind in ("abuse", "block"):
        return np.maximum(0.0, values - params.abuse_penalty)
    if kind == "challenge_fail":
        return np.maximum(0.0, values - params.challenge_fail_penalty)
    return values


class Transfer:
    """What one chunk does to the score and the average it starts with."""

    def __init__(self, params: Params) -> None:
        self.params = params
        self.blocks = 0  # abuses before the first read; the score is not yet on the grid
        self.first_gap: int | None = None
        self.values: np.ndarray | None = None  # distinct scores still possible
        self.index: np.ndarray | None = None  # grid entry -> position in values
        self.averages: np.ndarray | None = None  # None: unchanged
        self.since_compacted = 0

    def add(self, fresh: bool, kind: str, cost: float, gap_us: int, total_before: int) -> None:
        if kind == "reset":
            return  # the next row is a fresh one
        p = self.params
        if fresh:
            self.values, self.index = np.array([p.trust_init]), np.zeros(len(GRID), dtype=np.int64)
            self.averages = np.zeros(1)
        if kind != "block":
            if self.values is None:
                self.first_gap, self.values, self.index = gap_us, GRID.copy(), np.arange(len(GRID))
            else:
                self.values = decay_many(self.values, gap_us, p)
        if self.values is None:
            self.blocks = min(self.blocks + 1, int(1 / p.abuse_penalty) + 3)
        else:
            self.values = change_many(self.values, kind, cost, p)
            self.compact()
        if kind == "success" and total_before < SETTLED:
            a = AVG_GRID.copy() if self.averages is None else self.averages
            self.averages = round_many((a * total_before + cost) / (total_before + 1), 2, p.rounding)

    def compact(self) -> None:
        self.since_compacted += 1
        if len(self.values) > 1 and self.since_compacted >= 16:
            self.values, inverse = np.unique(self.values, return_inverse=True)
            self.index, self.since_compacted = inverse[self.index], 0

    def table(self) -> bytes:
        index = None if self.index is None else self.index.astype(np.int16)
        return pickle.dumps((self.blocks, self.first_gap, self.values, index, self.averages))


def apply_table(table: bytes, score: float, average: float, params: Params) -> tuple[float, float]:
    """Score and average after a chunk that was entered with these."""
    blocks, first_gap, values, index, averages = pickle.loads(table)
    if values is not None and len(values) == 1:
        score = float(values[0])
    else:
        for _ in range(blocks):
            score = max(0.0, score - params.abuse_penalty)
        if values is not None:
            seen = decay_many(np.array([score]), first_gap, params)[0]
            score = float(values[index[int(round(seen * 1000))]])
    if averages is not None:
        average = float(averages[0 if len(averages) == 1 else int(round(average * 100))])
    return score, average


def _transfers(df: DataFrame, user: str, order: list[str], params: Params) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, transfer = None, None

        def done() -> pd.DataFrame:
            return pd.DataFrame({user: [current[0]], "_chunk": [current[1]], "_table": [transfer.table()]})

        for pdf in batches:
            columns = [pdf[c].tolist() for c in (user, "_chunk", "_fresh", "kind", "cost", "_gap", "_total")]
            for u, chunk, fresh, kind, cost, gap, total in zip(*columns):
                if current != (u, chunk):
                    if current is not None:
                        yield done()
                    current, transfer = (u, chunk), Transfer(params)
                transfer.add(fresh, kind, cost, gap, total)
        if current is not None:
            yield done()

    narrow = df.select(user, "_chunk", *order, "_fresh", "kind", "cost", "_gap", "_total")
    placed = narrow.repartition(user, "_chunk").sortWithinPartitions(user, "_chunk", *order)
    return placed.mapInPandas(run, f"`{user}` string, _chunk bigint, _table binary")


def chunked_fold(events: DataFrame, user: str, ts: str, order: str, params: Params) -> DataFrame:
    """Same rows and columns as the plain fold."""
    by = [ts, order]
    carried = events.columns
    df = assign_chunks(events, user, ts, params.chunk_rows)
    df = running(df, user, by, {"_prev": ("max", F.struct(ts, order, "kind"))})
    prev = F.col("_prev")
    df = df.withColumn("_fresh", (F.col("kind") != "reset") & (
        prev.isNull() | (prev["kind"] == "reset")
        | (F.col(ts) - prev[ts] >= params.reputation_ttl_s * SECOND_US)
    )).drop("_prev")
    ok, bad = F.col("kind") == "success", F.col("kind").isin("abuse", "block")
    df = running(df, user, by, {
        "_succ": ("sum", ok.cast("long")), "_bad": ("sum", bad.cast("long")),
        "_seen": ("max", F.when(F.col("_fresh") | ok, F.col(ts))), "_abused": ("max", F.when(bad, F.col(ts))),
    })
    df = running(df, user, by, {
        "_succ0": ("max", F.when(F.col("_fresh"), F.col("_succ"))),
        "_bad0": ("max", F.when(F.col("_fresh"), F.col("_bad"))),
    }, inclusive=True)
    seen = F.when(F.col("_fresh"), F.col(ts)).otherwise(F.col("_seen"))
    reset = F.col("kind") == "reset"
    df = df.withColumns({
        "_gap": F.coalesce(F.col(ts) - seen, F.lit(0)),
        "_total": F.coalesce(F.col("_succ") - F.col("_succ0"), F.lit(0)),
        "_abuses": F.coalesce(F.col("_bad") - F.col("_bad0"), F.lit(0)),
    })
    df = df.withColumns({
        "total_requests": F.when(reset, 0).otherwise(F.col("_total") + ok.cast("long")),
        "abuse_count": F.when(reset, 0).otherwise(F.col("_abuses") + bad.cast("long")),
        "last_seen_us": F.when(reset, None).when(ok, F.col(ts)).otherwise(seen),
        "last_abuse_us": F.when(reset, None).when(bad, F.col(ts)).when(F.col("_abuses") > 0, F.col("_abused")),
    }).select(*carried, "_chunk", "_fresh", "_gap", "_total", "total_requests", "abuse_count", "last_seen_us", "last_abuse_us")
    df = materialize(df)

    def chain(state: tuple[float, float], row: tuple) -> tuple[tuple[float, float], tuple]:
        return apply_table(row[0], *state, params), state

    entries = ordered_fold(
        _transfers(df, user, by, params), [user], ["_chunk"], lambda row: (params.trust_init, 0.0), chain,
        ["_table"], {"_score0": "double", "_avg0": "double"},
    ).drop("_table")

    def step(state: tuple[float, float], row: tuple) -> tuple[tuple[float, float], tuple]:
        fresh, kind, cost, gap, total, _, _ = row
        if kind == "reset":
            return state, (None, None, False, 0.0)
        # the shared step, with time measured from the last visit
        score, average = (params.trust_init, 0.0) if fresh else state
        before = Trust(score, total, 0, average, 0, None, 0, gap)
        after, out = reputation_step(before, (gap, kind, cost), params)
        return (after.score, after.avg_cost), (out[0], out[1], out[2], out[5])

    rows = df.join(entries, [user, "_chunk"])
    folded = ordered_fold(
        rows, [user, "_chunk"], by, lambda row: (row[5], row[6]), step,
        ["_fresh", "kind", "cost", "_gap", "_total", "_score0", "_avg0"],
        {"trust_read": "double", "trust_score": "double", "candidate": "boolean", "avg_cost_score": "double"},
    )
    return folded.select(*carried, *OUTPUTS)
