"""The whole protection pipeline: requests in, one report row per request out.

signals (stateless) -> written once -> gate fold by user -> campaigns by fingerprint
-> report. Request ids may repeat, so every row gets a key of its own when the signals are
written, and all joins are on that key. The signals are written before they fan out, so
the prompt text is scanned exactly once however many branches read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptwatch.functions import verdicts as V
from promptwatch.functions.amplification import with_amplification
from promptwatch.functions.cost import TEXT_FORMS, cost_band, with_cost_signals, with_text_forms
from promptwatch.functions.fingerprints import prompt_hash, prompt_pattern
from promptwatch.functions.policy import token_budget, trust_tier
from promptwatch.functions.rules import with_rule_flags
from promptwatch.operators.correlation import correlation_check
from promptwatch.operators.gate import NO_PROOF, request_gate
from promptwatch.operators.proof import with_proofs
from promptwatch.params import Params
from promptwatch.plans import training
from promptwatch.sources.control import blacklist_gate
from promptwatch.sources.workspace import materialize

# Block reasons as operators and dashboards know them.
REASON_AUTH = "blacklisted or quota exceeded"
REASON_RISK = "rule-based detection: "
REASON_AMPLIFICATION = "recursive amplification detected (multiplier: %.1fx)"
REASON_PROOF = "proof-of-compute failed"
REASON_DEFENDER = "Twin AI Defender blocked: "

#: Column that tells rows apart, made once in a written table.
ROW_KEY = "_row_key"

_EMPTY_FLAGS = "array<string>"
_MATCHES = "array<struct<category:string,similarity:double>>"


def with_signals(requests: DataFrame, params: Params = Params(), model: training.CostModel | None = None) -> DataFrame:
    """Every stateless signal of a request; the cost score is the model's where one is given.

    Optional input columns: ``ext_json`` and ``defender_text`` (verdicts),
    ``semantic_flags, semantic_matches, max_similarity`` (from :func:`semantic_match`),
    ``proof`` (see :mod:`promptwatch.operators.gate`).
    """
    defaults = {
        "ext_json": "string", "defender_text": "string", "semantic_flags": _EMPTY_FLAGS,
        "semantic_matches": _MATCHES, "max_similarity": "double", "proof": "int",
    }
    df = requests
    for name, type_ in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(type_))
    df = with_amplification(with_rule_flags(with_cost_signals(with_text_forms(df))), params).drop(*TEXT_FORMS)
    if model is None:
        df = df.withColumn("scoring_method", F.lit("fallback_average"))
    else:
        df = training.score(model, training.with_model_features(df)).drop("expansion_normalized", "prediction")
    df = V.with_defender(V.with_ext_signals(df)).drop("ext_json", "defender_text")
    df = df.withColumns({
        "semantic_flags": F.coalesce("semantic_flags", F.array().cast(_EMPTY_FLAGS)),
        "semantic_matches": F.coalesce("semantic_matches", F.array().cast(_MATCHES)),
        "max_similarity": F.coalesce("max_similarity", F.lit(0.0)),
        "proof": F.coalesce("proof", F.lit(NO_PROOF)),
        "prompt_hash": prompt_hash(F.col("prompt")),
        "prompt_pattern": prompt_pattern(F.col("prompt")),
    })
    df = df.withColumn("semantic_score", V.semantic_score(F.col("semantic_flags"), F.col("max_similarity")))
    flags, score, suspicious = V.risk_merge(
        [F.col(c) for c in ("rule_flags", "semantic_flags", "ext_flags")],
        [F.col(c) for c in ("rule_score", "semantic_score", "ext_score")],
    )
    return df.withColumns({
        "risk_flags": flags,
        "risk_score": score,
        "is_suspicious": suspicious,
        "risk_block": (score >= params.risk_gate) & suspicious,
    })


def protect(
    requests: DataFrame, control: DataFrame, params: Params = Params(), scope: str = "post_risk",
    model: training.CostModel | None = None, challenges: DataFrame | None = None,
) -> DataFrame:
    """One report per request.

    ``scope='post_risk'`` looks for campaigns only among requests that passed the risk
    gate; ``'all'`` looks among every admitted request, so a repeated attack that is
    always blocked is recognised as a campaign too. ``model`` is a fitted cost model; with
    ``challenges`` (see :func:`with_proofs`) the requests' ``challenge_response`` is audited.
    """
    if challenges is not None:
        requests = with_proofs(requests, challenges, params).drop("proof_reason")
    signals = materialize(with_signals(requests, params, model).withColumn(ROW_KEY, F.monotonically_increasing_id()))
    gated = materialize(request_gate(blacklist_gate(signals, control), params, ROW_KEY))
    decided = signals.join(gated.drop("user_id", "request_id"), ROW_KEY)
    eligible = F.col("exit") != "auth"
    if scope == "post_risk":
        eligible = eligible & (F.col("exit") != "risk")
    sighted = decided.filter(eligible).select(
        ROW_KEY, "ts_us", "user_id", "client_ip", "prompt_hash", "prompt_pattern"
    )
    campaigns = correlation_check(materialize(sighted), params=params).select(
        ROW_KEY, "campaign_detected", "campaign_id", "confidence", "distributed"
    )
    return build_report(decided.join(campaigns, ROW_KEY, "left"), params)


def block_reason() -> Column:
    exit_ = F.col("exit")
    return (
        F.when(exit_ == "auth", REASON_AUTH)
        .when(exit_ == "risk", F.concat(F.lit(REASON_RISK), F.array_join("risk_flags", ", ")))
        .when(exit_ == "amplification", F.format_string(REASON_AMPLIFICATION, "multiplier"))
        .when(exit_ == "proof", REASON_PROOF)
        .when(exit_ == "defender", F.concat(F.lit(REASON_DEFENDER), "defender_reason"))
    )


def build_report(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Report columns; whatever a request did not reach keeps its default."""
    exit_ = F.col("exit")
    past_auth = exit_ != "auth"
    past_risk = past_auth & (exit_ != "risk")
    reached_trust = F.col("trust_read").isNotNull()
    reached_budget = exit_.isin("defender", "allowed")
    blocked = exit_.isin("auth", "risk", "amplification", "proof", "defender")
    no_flags = F.array().cast(_EMPTY_FLAGS)

    def reached(cond: Column, value: Column, default: object) -> Column:
        return F.when(cond, value).otherwise(default if isinstance(default, Column) else F.lit(default))

    return df.select(
        "request_id", "ts_us", "user_id", "client_ip", "prompt",
        reached(past_auth, F.col("cost_score"), 0).alias("cost_score"),
        "scoring_method",
        reached(past_auth, F.col("risk_flags"), no_flags).alias("risk_flags"),
        reached(past_auth, F.col("risk_score"), 0).alias("risk_score"),
        reached(reached_trust, F.round("trust_read", 3), 1.0).alias("trust_score"),
        reached(reached_budget, token_budget(F.col("risk_score"), F.col("trust_read"), params), params.budget_low).alias("tokens_allocated"),
        F.coalesce("campaign_detected", F.lit(False)).alias("campaign_detected"),
        "campaign_id",
        reached(past_risk, F.col("recursive_detected"), False).alias("recursive_detected"),
        (exit_ == "challenge").alias("challenge_triggered"),
        reached(reached_budget, F.col("defender_risk"), 0.0).alias("defender_risk"),
        blocked.alias("blocked"),
        block_reason().alias("block_reason"),
        F.struct(
            reached(past_auth, cost_band(F.col("cost_score")), "pending").alias("entropy"),
            reached(past_auth, V.risk_band(F.col("risk_score"), F.col("is_suspicious")), "pending").alias("risk"),
            reached(reached_trust, trust_tier(F.col("trust_read")), "pending").alias("reputation"),
            reached(reached_budget, V.defender_band(F.col("defender_risk")), "pending").alias("defender"),
        ).alias("detection_breakdown"),
        F.when(past_auth, F.struct(
            "rule_flags", "semantic_flags", "semantic_matches", "ext_flags", "ext_categories", "ext_status",
        )).alias("layer3_sources"),
        exit_.alias("exit"),
        F.when(blocked, "blocked").when(exit_ == "challenge", "challenged").otherwise("allowed").alias("status"),
        "auth_tier", "quota_used", "deny_reason", "prompt_hash",
    )
