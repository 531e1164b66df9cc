"""Fleet-level views of the report table: counters, rates, boards, layers, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptwatch.params import Params

ATTACK_EXITS = ["risk", "amplification", "defender"]


def metrics_counters(report: DataFrame) -> DataFrame:
    """total / successful / blocked / attacks; a challenged request is in none but the total."""
    return report.agg(
        F.count("*").alias("total_requests"),
        F.count_if(F.col("exit") == "allowed").alias("successful_requests"),
        F.count_if("blocked").alias("blocked_requests"),
        F.count_if(F.col("exit").isin(ATTACK_EXITS)).alias("attacks_detected"),
    )


def block_rate(metrics: DataFrame) -> DataFrame:
    rate = F.coalesce(F.try_divide(F.col("blocked_requests") * 100.0, F.col("total_requests")), F.lit(0.0))
    return metrics.withColumn("block_rate", F.round(rate, 1))


def threat_level_band(rate: Column) -> Column:
    return F.when(rate < 30, "green").when(rate < 60, "orange").otherwise("red")


def threat_level(metrics: DataFrame, alarm_at: float = 80.0, reference: float = 20.0) -> DataFrame:
    """Block rate with its band, its distance from the reference and whether it alarms."""
    return block_rate(metrics).withColumns({
        "band": threat_level_band(F.col("block_rate")),
        "delta": F.round(F.col("block_rate") - reference, 1),
        "alarm": F.col("block_rate") >= alarm_at,
    })


def metrics_long(metrics: DataFrame) -> DataFrame:
    """The four counters as (category, count) rows."""
    named = metrics.select(
        F.col("total_requests").alias("Total"), F.col("successful_requests").alias("Successful"),
        F.col("blocked_requests").alias("Blocked"), F.col("attacks_detected").alias("Attacks"),
    )
    return named.unpivot([], named.columns, "category", "count")


def history_kpis(report: DataFrame) -> DataFrame:
    blocked = F.count_if("blocked")
    return report.agg(
        blocked.alias("blocked"),
        F.greatest(F.count("*") - blocked, F.lit(0)).alias("allowed"),
        F.count_if(F.col("challenge_triggered") | (F.col("defender_risk") > 0.4)).alias("escalations"),
    )


def reputation_kpis(board: DataFrame) -> DataFrame:
    return board.agg(
        F.count("*").alias("users"),
        F.count_if(F.col("tier") == "trusted").alias("trusted"),
        F.count_if("is_blacklisted").alias("blacklisted"),
        F.coalesce(F.round(F.avg("trust_score"), 3), F.lit(0.0)).alias("avg_trust"),
    )


def detector_comparison(report: DataFrame) -> DataFrame:
    """How often each detector caught what, alone and together (a cube over the three)."""
    src = F.col("layer3_sources")
    hits = report.filter(src.isNotNull()).select(
        (F.size(src["rule_flags"]) > 0).alias("rule_hit"),
        (F.size(src["semantic_flags"]) > 0).alias("semantic_hit"),
        (F.size(src["ext_flags"]) > 0).alias("ext_hit"),
    )
    return hits.cube("rule_hit", "semantic_hit", "ext_hit").agg(F.count("*").alias("n"))


def flag_counts(report: DataFrame) -> DataFrame:
    """Requests per (flag, source)."""
    src = F.col("layer3_sources")
    tagged = F.array(*[
        F.struct(F.lit(name).alias("source"), src[field].alias("flags"))
        for name, field in (("rule", "rule_flags"), ("semantic", "semantic_flags"), ("ext", "ext_flags"))
    ])
    rows = report.filter(src.isNotNull()).select(F.inline(tagged))
    return rows.select("source", F.explode("flags").alias("flag")).groupBy("flag", "source").agg(F.count("*").alias("n"))


# Layer titles in pipeline order.
LAYERS = [
    "Auth & Input Validation", "Entropy Engine", "Risk Analysis Engine", "Correlation Engine",
    "Amplification Detector", "Reputation Engine", "Challenge Generator", "Proof of Compute",
    "Token Budget Allocator", "Twin AI Defender", "LLM Adapter", "Monitoring & Logging",
]


def layer_state(report: DataFrame) -> DataFrame:
    """A (request, layer) table: ``state`` complete/warn/blocked/pending and ``detail``."""
    c = F.col
    why = F.coalesce("block_reason", F.lit("blocked"))
    seen = c("detection_breakdown")

    def says(*words: str) -> Column:
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(F.lower(why), F.lit(w))
        return c("blocked") & cond

    def layer(blocked: Column | None, warn: Column | None, detail: Column, blocked_detail: Column | None = None):
        state = F.when(F.lit(False) if blocked is None else blocked, "blocked")
        if warn is not None:
            state = state.when(warn, "warn")
        shown = detail if blocked is None else F.when(blocked, why if blocked_detail is None else blocked_detail).otherwise(detail)
        return state.otherwise("complete"), shown

    flags = F.array_join("risk_flags", ", ")
    rows = [
        layer(says("blacklisted"), None, F.lit("client accepted")),
        layer(None, c("cost_score") > 40, F.format_string("cost %d · %s", "cost_score", seen["entropy"])),
        layer(says("prompt injection", "rule-based"), c("risk_score") >= 18,
              F.format_string("risk %d · %s", "risk_score", seen["risk"]),
              F.when(flags != "", flags).otherwise(why)),
        layer(None, c("campaign_detected"), F.concat(F.lit("campaign "), F.coalesce("campaign_id", F.lit("none")))),
        layer(c("blocked") & c("recursive_detected"), c("recursive_detected"),
              F.when(c("recursive_detected"), "recursive detected").otherwise("no recursion")),
        layer(None, c("trust_score") < 0.4, F.format_string("trust %.3f · %s", "trust_score", seen["reputation"])),
        layer(None, c("challenge_triggered"),
              F.when(c("challenge_triggered"), "challenge issued").otherwise("challenge not required")),
        layer(says("proof-of-compute"), None, F.lit("verification bypassed or passed")),
        layer(None, None, F.format_string("%d tokens allocated", "tokens_allocated")),
        layer(says("defender"), c("defender_risk") > 0.4,
              F.format_string("defender risk %.3f · %s", "defender_risk", seen["defender"])),
        (F.when(c("blocked") | c("challenge_triggered"), "pending").otherwise("complete"),
         F.when(c("blocked") | c("challenge_triggered"), "not sent to target model").otherwise("target model called")),
        layer(None, None, F.concat(F.lit("trace "), c("request_id").cast("string"))),
    ]
    structs = [
        F.struct(F.lit(i).alias("layer"), F.lit(title).alias("title"), state.alias("state"), detail.alias("detail"))
        for i, (title, (state, detail)) in enumerate(zip(LAYERS, rows), start=1)
    ]
    return report.select("request_id", F.inline(F.array(*structs)))


def status_label(report: DataFrame) -> DataFrame:
    return report.select(
        "request_id", F.when(F.col("blocked"), "BLOCK").otherwise("ALLOW").alias("label"),
        F.substring("prompt", 1, 120).alias("prompt"), "risk_score",
    )


def python_number(x: Column) -> Column:
    """A double as it is written without trailing zeroes (0.7, 1.0, 0.675)."""
    return x.cast("double").cast("string")


def request_label(report: DataFrame) -> DataFrame:
    """Status, user, risk, trust and cost of a request in one line."""
    icon = F.when(F.col("blocked"), "\U0001f534 BLOCKED").otherwise("\U0001f7e2 ALLOWED")
    return report.select("request_id", F.concat(
        icon, F.lit(" | User: "), F.coalesce("user_id", F.lit("unknown")),
        F.lit(" | Risk: "), F.col("risk_score").cast("string"),
        F.lit(" | Trust: "), python_number(F.col("trust_score")),
        F.lit(" | Cost: "), F.col("cost_score").cast("string"),
    ).alias("label"))


def last_seen_format(last_seen_us: Column) -> Column:
    """Epoch microseconds as ``YYYY-MM-DD HH:MM``; a dash when never seen."""
    return F.when(F.coalesce(last_seen_us, F.lit(0)) == 0, "—").otherwise(
        F.date_format(F.timestamp_micros(last_seen_us), "yyyy-MM-dd HH:mm")
    )


def user_filter(df: DataFrame, query: str, user: str = "user_id") -> DataFrame:
    return df.filter(F.contains(F.lower(user), F.lit(query.lower()))) if query else df


def request_history(report: DataFrame, limit: int = Params.history_default, params: Params = Params()) -> DataFrame:
    """The newest ``limit`` requests, never more than the log keeps."""
    return report.orderBy(F.desc("ts_us"), F.desc("request_id")).limit(min(limit, params.log_kept))


def flatten_history(history: DataFrame) -> DataFrame:
    """Log entries with a nested ``report`` as flat rows."""
    return history.select(
        "prompt", F.coalesce("report.user_id", F.lit("unknown")).alias("user_id"), "response", "report"
    )


def blocked_filter(report: DataFrame, newest: int = 20, shown: int = 10) -> DataFrame:
    """Blocked requests among the newest ones."""
    recent = request_history(report, newest)
    return recent.filter("blocked").orderBy(F.desc("ts_us"), F.desc("request_id")).limit(shown)
