"""Thresholds shared by every operator; the defaults are fixed values of the specification."""

from __future__ import annotations

from dataclasses import dataclass

SECOND_US = 1_000_000
HOUR_US = 3600 * SECOND_US
DAY_US = 24 * HOUR_US


@dataclass(frozen=True)
class Params:
    # quota
    quota_limit: int = 5
    quota_window_s: int = 3600
    # similarity
    similarity_threshold: float = 0.80
    # amplification
    amplification_limit: float = 5.0
    bare_numbers: bool = True
    # risk gate
    risk_gate: int = 18
    # challenge
    challenge_trust: float = 0.4
    challenge_cost: int = 70
    proof_freshness_s: int = 300
    proof_prefix: str = "0000"
    # token budget
    budget_low: int = 5000
    budget_medium: int = 2000
    budget_high: int = 500
    budget_min: int = 100
    budget_max: int = 8000
    # correlation
    correlation_window_s: int = 300
    campaign_threshold: int = 3
    campaign_ttl_s: int = 3600
    campaigns_kept: int = 100
    campaigns_shown: int = 20
    # reputation
    trust_init: float = 0.7
    trust_decay: float = 0.02
    trust_boost: float = 0.05
    abuse_penalty: float = 0.20
    challenge_fail_penalty: float = 0.15
    decay_after_h: float = 24.0
    decay_floor: float = 0.3
    floor_only_lowers: bool = False
    candidate_trust: float = 0.05
    reputation_ttl_s: int = 86400 * 30
    rounding: str = "python"  # or "half_up", the variant SQL can express
    # defender
    defender_block: float = 0.5
    # request log
    log_kept: int = 200
    history_default: int = 50
    # execution: keys with more rows than this are split over time instead of
    # being folded by one task
    hot_rows: int = 2_000_000
    chunk_rows: int = 500_000
