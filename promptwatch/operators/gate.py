"""The request gate: quota, reputation and the cascade of exits as one ordered fold.

Whether a challenge is asked depends on trust, and trust depends on earlier outcomes, so
the decisions of one user are sequential. They are also few: the quota admits at most
``quota_limit`` requests per window, and everything it turns away changes no state. Users
with very many requests therefore get their quota from the parallel operator first, and
only the admitted rows (bounded by time, not by traffic) are folded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptwatch.operators import reputation as rep
from promptwatch.operators.anchored import quota_check
from promptwatch.operators.fold import ordered_fold
from promptwatch.operators.prefix import hot_keys
from promptwatch.params import SECOND_US, Params
from promptwatch.sources.workspace import materialize

#: ``proof`` input: no submission, a wrong one, a right one.
NO_PROOF, BAD_PROOF, GOOD_PROOF = -1, 0, 1

INPUTS = ["ts_us", "risk_block", "recursive_detected", "cost_score", "proof", "defender_risk", "admitted"]
OUTPUTS = {
    "exit": "string", "auth_tier": "string", "quota_used": "int", "trust_read": "double",
    "trust_after": "double", "abuse_count": "bigint", "total_requests": "bigint",
    "avg_cost_score": "double", "candidate": "boolean",
}


def tier_of(score: float) -> str:
    return "trusted" if score >= 0.75 else "authenticated" if score >= 0.45 else "anonymous"


def take_quota(quota: tuple | None, now: int, params: Params) -> tuple[tuple, bool]:
    """Next ``(window start, used)`` and whether the request is admitted."""
    if quota is None or now >= quota[0] + params.quota_window_s * SECOND_US:
        return (now, 1), True
    if quota[1] >= params.quota_limit:
        return quota, False
    return (quota[0], quota[1] + 1), True


def decide(trust: rep.Trust | None, row: tuple, params: Params) -> tuple[rep.Trust, str, float | None, str]:
    """Exit of one admitted request, the trust it read (if it got so far) and its tier."""
    now, risk_block, recursive, cost, proof, defender = row
    s = rep.load(trust, now, params)
    tier = tier_of(rep.decayed(s, now, params))
    if risk_block:
        return rep.abuse(s, now, params), "risk", None, tier
    if recursive:
        return rep.abuse(s, now, params), "amplification", None, tier
    s = rep.read_score(s, now, params)
    seen = s.score
    if seen < params.challenge_trust and cost > params.challenge_cost:
        if proof == NO_PROOF:
            return s, "challenge", seen, tier
        if proof == BAD_PROOF:
            return rep.abuse(s, now, params), "proof", seen, tier
    if defender >= params.defender_block:
        return rep.abuse(s, now, params), "defender", seen, tier
    return rep.success(s, now, cost, params), "allowed", seen, tier


ABUSE_EXITS = ("risk", "amplification", "proof", "defender")


def gate_step(state: tuple, row: tuple, params: Params) -> tuple[tuple, tuple]:
    """``row`` is INPUTS; ``admitted`` > 0 is a quota already decided elsewhere."""
    quota, trust = state
    *signals, admitted = row
    if admitted > 0:
        used = admitted
    else:
        quota, ok = take_quota(quota, signals[0], params)
        if not ok:
            return (quota, trust), ("auth", "blocked", None, None, None, None, None, None, False)
        used = quota[1]
    trust, exit_, seen, tier = decide(trust, tuple(signals), params)
    candidate = exit_ in ABUSE_EXITS and trust.score <= params.candidate_trust
    return (quota, trust), (
        exit_, tier, used, seen, trust.score, trust.abuses, trust.total, trust.avg_cost, candidate
    )


def request_gate(df: DataFrame, params: Params = Params(), key: str = "request_id") -> DataFrame:
    """Add OUTPUTS to requests carrying INPUTS (without ``admitted``), ``deny_reason`` and the ids.

    ``deny_reason`` (blacklist) rows leave first; ``exit`` is one of auth, risk,
    amplification, challenge, proof, defender, allowed. Only the columns named here are
    moved: the result is ``request_id, user_id`` and OUTPUTS plus ``deny_reason``, and ``key`` where rows are told
    apart by another column than ``request_id`` (ids may repeat).
    """
    narrow = df.select(*_ids(key), *INPUTS[:-1], "deny_reason")
    open_rows = narrow.filter(F.col("deny_reason").isNull())
    denied = _auth_exit(narrow.filter(F.col("deny_reason").isNotNull()), key)
    hot = hot_keys(open_rows, ["user_id"], params.hot_rows)
    if hot is None:
        return _decided(open_rows, params, key).unionByName(denied)
    cold = _decided(open_rows.join(hot, "user_id", "left_anti"), params, key)
    metered = materialize(quota_check(open_rows.join(hot, "user_id", "left_semi"), params=params))
    admitted = metered.filter("quota_allowed").drop("quota_allowed").withColumnRenamed("quota_used", "admitted")
    over = _auth_exit(metered.filter("NOT quota_allowed").drop("quota_used", "quota_allowed"), key)
    return cold.unionByName(_fold(admitted, params, key)).unionByName(over).unionByName(denied)


def _ids(key: str) -> list[str]:
    return list(dict.fromkeys([key, "request_id", "user_id"]))


def _decided(df: DataFrame, params: Params, key: str) -> DataFrame:
    return _fold(df.withColumn("admitted", F.lit(0)), params, key)


def _fold(df: DataFrame, params: Params, key: str) -> DataFrame:
    folded = ordered_fold(
        df, ["user_id"], list(dict.fromkeys(["ts_us", "request_id", key])), lambda row: (None, None),
        lambda s, row: gate_step(s, row, params), INPUTS, OUTPUTS,
    )
    return folded.select(*_ids(key), "deny_reason", *OUTPUTS)


def _auth_exit(df: DataFrame, key: str) -> DataFrame:
    fixed = {"exit": "auth", "auth_tier": "blocked", "candidate": False}
    return df.select(
        *_ids(key), "deny_reason",
        *[F.lit(fixed.get(n)).cast(t).alias(n) for n, t in OUTPUTS.items()],
    )
