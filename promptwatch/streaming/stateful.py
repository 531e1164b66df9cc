"""Streaming twins of the keyed operators.

Each twin folds a key's rows in order of event time, with the step function of the batch fold; see
:mod:`promptwatch.streaming.ordered`. Rows behind the watermark are dropped (and counted by the engine), and state goes
when the watermark has passed its lifetime.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptwatch.functions.amplification import with_amplification
from promptwatch.functions.cost import TEXT_FORMS, with_cost_signals, with_text_forms
from promptwatch.functions.fingerprints import campaign_id
from promptwatch.functions.rules import with_rule_flags
from promptwatch.operators.correlation import campaign_verdict
from promptwatch.operators.gate import INPUTS as GATE_INPUTS
from promptwatch.operators.gate import OUTPUTS as GATE_OUTPUTS
from promptwatch.operators.gate import gate_step, take_quota
from promptwatch.operators.reputation import OUTPUTS as REPUTATION_OUTPUTS
from promptwatch.operators.reputation import Trust, reputation_step
from promptwatch.params import SECOND_US, Params
from promptwatch.streaming.ordered import Lifetime, members_in_window, ordered_fold

TRUST = "score double, total bigint, abuses bigint, avg_cost double, last_seen bigint, last_abuse bigint, created bigint, saved bigint"


def with_event_time(stream: DataFrame, delay: str, ts: str = "ts_us") -> DataFrame:
    return stream.withColumn("event_time", F.timestamp_micros(ts)).withWatermark("event_time", delay)


def before(stream: DataFrame, until_us: int) -> DataFrame:
    """Without the heartbeat rows at or after ``until_us``; they have moved the watermark by then."""
    return stream.filter(F.col("event_time") < F.timestamp_micros(F.lit(until_us)))


def stream_signals(stream: DataFrame, params: Params = Params()) -> DataFrame:
    """Stateless signals of a request stream: the very expressions the batch uses."""
    df = with_amplification(with_rule_flags(with_cost_signals(with_text_forms(stream))), params)
    return df.drop(*TEXT_FORMS)


def _quota_life(params: Params) -> Lifetime:
    return Lifetime("start bigint, used bigint", lambda v: v[0] + params.quota_window_s * SECOND_US)


def _trust_life(params: Params) -> Lifetime:
    return Lifetime(TRUST, lambda v: v[7] + params.reputation_ttl_s * SECOND_US)


def stream_quota(stream: DataFrame, params: Params = Params()) -> DataFrame:
    """``quota_used, quota_allowed`` per request; state per user: window start and count."""

    def step(values: tuple, row: tuple) -> tuple[tuple, tuple]:
        quota, allowed = take_quota(values[0], row[0], params)
        return (quota,), (quota[1], allowed)

    return ordered_fold(
        stream, ["user_id"], ["request_id", "ts_us"], ["ts_us"], step, {"quota": _quota_life(params)},
        {"quota_used": "int", "quota_allowed": "boolean"},
    )


def stream_correlation(stream: DataFrame, params: Params = Params()) -> DataFrame:
    """Senders and addresses per request and track (``exact`` / ``fuzzy`` fingerprint).

    Counts are whole: the state of a fingerprint holds one entry for each distinct sender and
    address that was seen within the window. The event time is carried on.
    """
    tracks = F.array(
        F.struct(F.lit("exact").alias("track"), F.col("prompt_hash").alias("fingerprint")),
        F.struct(F.lit("fuzzy").alias("track"), F.col("prompt_pattern").alias("fingerprint")),
    )
    rows = stream.select("request_id", "ts_us", "event_time", "user_id", "client_ip", F.inline(tracks))
    return members_in_window(
        rows, ["track", "fingerprint"], ["request_id", "ts_us", "user_id", "client_ip"],
        {"senders": ["user_id", "client_ip"], "addresses": ["client_ip"]}, params.correlation_window_s * SECOND_US,
    )


def stream_campaigns(stream: DataFrame, params: Params = Params()) -> DataFrame:
    """The batch verdict per request, from two chained stateful operators.

    The counts of a request's two tracks come from two keys; they meet again in an aggregate by request, which is
    put out when the watermark has passed the request. Requests are told apart by id, time, sender and address; equal
    ones have equal verdicts and are one row.
    """
    counts = stream_correlation(stream, params)

    def of(track: str, column: str) -> Column:
        return F.max(F.when(F.col("track") == track, F.col(column)))

    met = counts.groupBy("event_time", "request_id", "ts_us", "user_id", "client_ip").agg(
        of("exact", "senders").alias("exact_count"), of("exact", "addresses").alias("ip_count"), of("fuzzy", "senders").alias("fuzzy_count"),
        F.max(F.when(F.col("track") == "exact", F.col("fingerprint"))).alias("prompt_hash"),
    )
    return campaign_verdict(met, params).drop("event_time")


def stream_campaign_log(detected: DataFrame, params: Params = Params()) -> DataFrame:
    """First detection per campaign and hour; state per fingerprint: when its id was made."""
    ttl_us = params.campaign_ttl_s * SECOND_US

    def step(values: tuple, row: tuple) -> tuple[tuple, tuple]:
        opens = values[0] is None or row[0] >= values[0][0] + ttl_us
        return ((row[0],) if opens else values[0],), (opens,)

    folded = ordered_fold(
        detected, ["prompt_hash"], ["request_id", "ts_us"], ["ts_us"], step,
        {"opened": Lifetime("start bigint", lambda v: v[0] + ttl_us)}, {"opens": "boolean"},
    )
    return folded.filter("opens").select(
        campaign_id(F.col("prompt_hash")).alias("campaign_id"), "prompt_hash", F.col("ts_us").alias("detected_at")
    )


def trust_state(states: DataFrame) -> DataFrame:
    """Saved reputation states, one row per user, as the first state of a stream."""
    names = {
        "score": "trust_score", "total": "total_requests", "abuses": "abuse_count", "avg_cost": "avg_cost_score",
        "last_seen": "last_seen_us", "last_abuse": "last_abuse_us", "created": "saved_us", "saved": "saved_us",
    }
    types = dict(c.split() for c in TRUST.split(", "))
    return states.filter("trust_score is not null").select("user_id", *[F.col(column).cast(types[n]).alias(n) for n, column in names.items()])


def stream_reputation(stream: DataFrame, params: Params = Params(), snapshot: DataFrame | None = None) -> DataFrame:
    """Reputation after every event (``kind, cost``), with the batch fold's own step.

    ``snapshot`` (:func:`trust_state`) is where known users begin.
    """

    def step(values: tuple, row: tuple) -> tuple[tuple, tuple]:
        trust, out = reputation_step(None if values[0] is None else Trust(*values[0]), row, params)
        return (trust,), out

    return ordered_fold(
        stream, ["user_id"], ["request_id", "ts_us"], ["ts_us", "kind", "cost"], step, {"trust": _trust_life(params)},
        REPUTATION_OUTPUTS, initial=snapshot,
    )


def stream_gate(stream: DataFrame, params: Params = Params()) -> DataFrame:
    """The whole cascade as requests come: quota, trust, challenge, proof, defender.

    ``stream`` carries the gate's inputs (without ``admitted``) and ``deny_reason``; denied rows leave at once and take
    no part in the state. A user's quota and trust are state variables with lifetimes of their own.
    """
    narrow = stream.select("request_id", "user_id", "deny_reason", "event_time", *GATE_INPUTS[:-1]).withColumn("admitted", F.lit(0))

    def step(values: tuple, row: tuple) -> tuple[tuple, tuple]:
        *signals, admitted, denied = row
        if denied is not None:
            return values, ("auth", "blocked", None, None, None, None, None, None, False)
        trust = None if values[1] is None else Trust(*values[1])
        return gate_step((values[0], trust), (*signals, admitted), params)

    return ordered_fold(
        narrow, ["user_id"], ["request_id", "deny_reason"], [*GATE_INPUTS, "deny_reason"], step,
        {"quota": _quota_life(params), "trust": _trust_life(params)}, GATE_OUTPUTS,
    )


def stream_metrics(report: DataFrame) -> DataFrame:
    """Live counters (complete mode); the checkpoint carries them over restarts."""
    return report.groupBy().agg(
        F.count("*").alias("total_requests"),
        F.count_if(F.col("exit") == "allowed").alias("successful_requests"),
        F.count_if("blocked").alias("blocked_requests"),
        F.count_if(F.col("exit").isin("risk", "amplification", "defender")).alias("attacks_detected"),
    )
