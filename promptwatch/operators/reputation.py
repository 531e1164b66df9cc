"""Trust per user: the step functions shared by batch and stream, and the ordered fold.

Kinds of event: ``success``, ``abuse`` and ``challenge_fail`` first read the score (idle
decay, rounding to three places, saved), then change it; ``read`` only reads; ``block``
is an abuse recorded before the score was read; ``reset`` forgets the user.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptwatch.functions.policy import round3, trust_tier
from promptwatch.operators.fold import ordered_fold
from promptwatch.operators.ranking import global_rank
from promptwatch.params import HOUR_US, SECOND_US, Params
from promptwatch.sources.workspace import materialize


class Trust(NamedTuple):
    score: float
    total: int
    abuses: int
    avg_cost: float
    last_seen: int
    last_abuse: int | None
    created: int
    saved: int


def rounded(x: float, places: int, mode: str) -> float:
    if mode == "python":
        return round(x, places)
    scale = 10.0**places
    return math.floor(x * scale + 0.5) / scale


def load(state: Trust | None, now: int, params: Params) -> Trust:
    """The saved state, or a new user's when there is none or it has expired."""
    if state is None or now - state.saved >= params.reputation_ttl_s * SECOND_US:
        return Trust(params.trust_init, 0, 0, 0.0, now, None, now, now)
    return state


def decayed(state: Trust, now: int, params: Params) -> float:
    score, hours = state.score, (now - state.last_seen) / HOUR_US
    if hours > params.decay_after_h:
        lowered = max(params.decay_floor, score - params.trust_decay * (hours / 24))
        score = min(score, lowered) if params.floor_only_lowers else lowered
    return rounded(score, 3, params.rounding)


def read_score(state: Trust, now: int, params: Params) -> Trust:
    return state._replace(score=decayed(state, now, params), saved=now)


def success(state: Trust, now: int, cost: float, params: Params) -> Trust:
    total = state.total + 1
    return state._replace(
        score=min(1.0, state.score + params.trust_boost * (1 - cost / 200)),
        total=total,
        avg_cost=rounded((state.avg_cost * (total - 1) + cost) / total, 2, params.rounding),
        last_seen=now,
        saved=now,
    )


def abuse(state: Trust, now: int, params: Params) -> Trust:
    return state._replace(
        score=max(0.0, state.score - params.abuse_penalty), abuses=state.abuses + 1, last_abuse=now, saved=now
    )


def challenge_fail(state: Trust, now: int, params: Params) -> Trust:
    return state._replace(score=max(0.0, state.score - params.challenge_fail_penalty), saved=now)


def reputation_step(state: Trust | None, row: tuple, params: Params) -> tuple[Trust | None, tuple]:
    """One event ``(ts, kind, cost)`` -> next state and the output values."""
    now, kind, cost = row
    if kind == "reset":
        return None, (None, None, False, 0, 0, 0.0, None, None)
    s = load(state, now, params)
    seen = None
    if kind != "block":
        s = read_score(s, now, params)
        seen = s.score
    if kind == "success":
        s = success(s, now, cost, params)
    elif kind in ("abuse", "block"):
        s = abuse(s, now, params)
    elif kind == "challenge_fail":
        s = challenge_fail(s, now, params)
    candidate = kind in ("abuse", "block") and s.score <= params.candidate_trust
    return s, (seen, s.score, candidate, s.total, s.abuses, s.avg_cost, s.last_seen, s.last_abuse)


OUTPUTS = {
    "trust_read": "double", "trust_score": "double", "candidate": "boolean", "total_requests": "bigint",
    "abuse_count": "bigint", "avg_cost_score": "double", "last_seen_us": "bigint", "last_abuse_us": "bigint",
}


def reputation_fold(
    events: DataFrame, user: str = "user_id", ts: str = "ts_us", order: str = "request_id", params: Params = Params()
) -> DataFrame:
    """Add the reputation after every event (columns of :data:`OUTPUTS`).

    ``events`` carries ``kind`` and ``cost``. Users with more than ``hot_rows`` events are folded in
    parallel pieces, see :mod:`reputation_chunks`; its tables hold for costs of 0..100, so a hot user with
    any other cost is folded in one piece like everyone else.
    """
    from promptwatch.operators.prefix import hot_keys
    from promptwatch.operators.reputation_chunks import chunked_fold

    hot = hot_keys(events, [user], params.hot_rows)
    if hot is not None:
        odd = events.filter((F.col("kind") == "success") & ~F.coalesce(F.col("cost").between(0, 100), F.lit(False)))
        hot = materialize(hot.join(odd.select(user).distinct(), user, "left_anti"))
    if hot is None or hot.isEmpty():
        return _folded(events, user, ts, order, params)
    cold = _folded(events.join(hot, user, "left_anti"), user, ts, order, params)
    return cold.unionByName(chunked_fold(events.join(hot, user, "left_semi"), user, ts, order, params))


def _folded(events: DataFrame, user: str, ts: str, order: str, params: Params) -> DataFrame:
    return ordered_fold(
        events, [user], [ts, order], lambda row: None, lambda s, row: reputation_step(s, row, params),
        [ts, "kind", "cost"], OUTPUTS,
    )


def latest_state(folded: DataFrame, user: str = "user_id", ts: str = "ts_us", order: str = "request_id") -> DataFrame:
    """The state each user was left in: one row per known user, reset users included."""
    cols = ["trust_score", "total_requests", "abuse_count", "avg_cost_score", "last_seen_us", "last_abuse_us"]
    last = folded.groupBy(user).agg(F.max_by(F.struct(ts, *cols), F.struct(ts, order)).alias("s"))
    return last.select(user, F.col(f"s.{ts}").alias("saved_us"), *[f"s.{c}" for c in cols])


def blacklist_candidates(folded: DataFrame, user: str = "user_id") -> DataFrame:
    """Users whose trust fell to the candidate level after an abuse, at any time."""
    return folded.filter("candidate").select(user).distinct()


def reputation_board(
    states: DataFrame, blacklist: DataFrame, now_us: object, user: str = "user_id", params: Params = Params()
) -> DataFrame:
    """Every known user with live state, tier and blacklist reason.

    A state older than its TTL (or deleted) shows as ``expired`` with zeroes. ``now_us``
    is a Column or a number. No decay is applied.
    """
    now = now_us if not isinstance(now_us, int) else F.lit(now_us)
    alive = F.col("trust_score").isNotNull() & (now - F.col("saved_us") < params.reputation_ttl_s * SECOND_US)
    banned = blacklist.filter("kind = 'user'").select(
        F.col("key").alias(user), F.lit(True).alias("_bl"), F.col("reason").alias("blacklist_reason"),
        "triggered_by", F.col("ts_us").alias("blacklisted_us"),
    )
    df = states.withColumn("_alive", alive).join(banned, user, "left")
    listed = F.coalesce(F.col("_bl"), F.lit(False))

    def live(c: str, default: object) -> object:
        return F.when(F.col("_alive"), F.col(c)).otherwise(F.lit(default))

    return df.select(
        user,
        F.when(F.col("_alive"), round3(F.col("trust_score"), params.rounding)).otherwise(0.0).alias("trust_score"),
        F.when(listed, "blacklisted").when(~F.col("_alive"), "expired").otherwise(trust_tier(F.col("trust_score"))).alias("tier"),
        live("abuse_count", 0).alias("abuse_count"),
        live("total_requests", 0).alias("total_requests"),
        live("avg_cost_score", 0.0).alias("avg_cost_score"),
        live("last_seen_us", 0).alias("last_seen_us"),
        listed.alias("is_blacklisted"),
        "blacklist_reason", "triggered_by", "blacklisted_us",
    )


def board_sort(board: DataFrame, user: str = "user_id") -> DataFrame:
    """The board with each user's ``position``: blacklisted users first, then by trust, lowest first."""
    return global_rank(board, [F.desc("is_blacklisted"), F.asc("trust_score"), F.asc(user)])
