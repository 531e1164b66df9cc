"""Tiers, budgets, challenges and proofs: the small decision tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptwatch.params import HOUR_US, Params


def trust_tier(score: Column) -> Column:
    return F.when(score >= 0.75, "trusted").when(score >= 0.45, "authenticated").otherwise("anonymous")


def round3(x: Column, rounding: str = "half_up") -> Column:
    if rounding == "half_up":
        return F.floor(x * 1000 + 0.5) / 1000
    return F.bround(x, 3)


def trust_decay(score: Column, last_seen_us: Column, now_us: Column, params: Params = Params()) -> Column:
    """Trust after idleness: loses ``decay`` per day once the gap exceeds a day."""
    hours = (now_us - last_seen_us) / HOUR_US
    lowered = F.greatest(F.lit(params.decay_floor), score - F.lit(params.trust_decay) * (hours / 24))
    if params.floor_only_lowers:
        lowered = F.least(score, lowered)
    return round3(F.when(hours > params.decay_after_h, lowered).otherwise(score), params.rounding)


def risk_tier(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score >= 30, "medium").otherwise("low")


def trust_multiplier(trust: Column) -> Column:
    return F.when(trust >= 0.75, 1.0).when(trust >= 0.45, 0.75).otherwise(0.5)


def token_budget(risk_score: Column, trust: Column, params: Params = Params()) -> Column:
    base = (
        F.when(risk_score >= 60, params.budget_high).when(risk_score >= 30, params.budget_medium)
        .otherwise(params.budget_low)
    )
    granted = F.floor(base * trust_multiplier(trust)).cast("int")
    return F.greatest(F.lit(params.budget_min), F.least(granted, F.lit(params.budget_max)))


def challenge_required(trust: Column, cost: Column, params: Params = Params()) -> Column:
    return (trust < params.challenge_trust) & (cost > params.challenge_cost)


def proof_audit(challenge: Column, nonce: Column, age_s: Column, params: Params = Params()) -> Column:
    """Struct ``verified, reason`` for one decoded submission."""
    digest = F.sha2(F.concat(challenge, nonce), 256)
    reason = (
        F.when(age_s > params.proof_freshness_s, "challenge too old")
        .when(~digest.startswith(params.proof_prefix), f"invalid nonce — hash does not start with {params.proof_prefix}")
    )
    return F.struct(reason.isNull().alias("verified"), reason.alias("reason"))
