"""Streams give what the batch gives, whatever the split into triggers, and survive restarts."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptwatch import Params
from promptwatch.operators import anchored, correlation, gate, reputation
from promptwatch.sources.requests import load_snapshot, save_snapshot
from promptwatch.streaming import stateful as ST
from promptwatch.streaming.ordered import MemberProcessor
from promptwatch.streaming.run import keep_newest, late_rows, newest, run_available, split_late, start
from tests.test_reputation import random_events

HOUR = 3_600_000_000
SCHEMA = "request_id long, user_id string, ts_us long, kind string, cost double"


END = 4_000_000_000_000_000


def write_arrivals(spark, path, parts):
    """One file for each part, in order, and a heartbeat at the end of time."""
    for n, part in enumerate([*parts, [(-1, None, END, None, None)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/part{n}")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events in six files; they arrive up to two hours late, with ties in time and a null user."""
    path = str(tmp_path_factory.mktemp("events"))
    rng = random.Random(3)
    rows = [(i, u if i % 40 else None, t - t % 60_000_000 if i % 3 == 0 else t, k, c) for i, u, t, k, c in random_events(21, 400)]
    rows.sort(key=lambda r: r[2] + rng.randrange(2 * HOUR))
    write_arrivals(spark, path, [rows[n * 67:(n + 1) * 67] for n in range(6)])
    return path


def stream(spark, folder, delay="2 hours"):
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    return ST.before(ST.with_event_time(df, delay), END)


def batch(spark, folder):
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(folder).filter("request_id >= 0")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_quota_and_reputation(spark, folder):
    params = replace(Params(), quota_limit=2)
    cols = ("request_id", "quota_used", "quota_allowed")
    assert rows(run_available(ST.stream_quota(stream(spark, folder), params)), *cols) == rows(
        anchored.quota_check(batch(spark, folder), params=params), *cols)
    cols = ("request_id", *reputation.OUTPUTS)
    key = lambda r: r[0]
    got = sorted((tuple(r[c] for c in cols) for r in run_available(ST.stream_reputation(stream(spark, folder))).collect()), key=key)
    want = sorted((tuple(r[c] for c in cols) for r in reputation.reputation_fold(batch(spark, folder)).collect()), key=key)
    assert got == want


def test_correlation_and_campaign_log(spark, folder):
    def sightings(df):
        return df.withColumns({"client_ip": F.concat(F.lit("i"), (F.col("request_id") % 3).cast("string")),
                               "prompt_hash": F.col("kind"), "prompt_pattern": F.substring("kind", 1, 1)})

    params = replace(Params(), correlation_window_s=6 * 3600)
    got = {(r.request_id, r.track): (r.senders, r.addresses) for r in run_available(ST.stream_correlation(sightings(stream(spark, folder)), params)).collect()}
    base = correlation.campaign_fuzzy(correlation.campaign_exact(sightings(batch(spark, folder)), params=params), params=params)
    for r in base.collect():
        assert got[(r.request_id, "exact")] == (r.exact_count, r.ip_count)
        assert got[(r.request_id, "fuzzy")][0] == r.fuzzy_count
    cols = ("prompt_hash", "detected_at")
    every = sightings(batch(spark, folder)).withColumns({"campaign_detected": F.lit(True), "campaign_id": F.lit("c")})
    assert rows(run_available(ST.stream_campaign_log(sightings(stream(spark, folder)))), *cols) == rows(anchored.campaign_log(every), *cols)


def test_campaign_verdicts_of_two_operators(spark, folder):
    def sightings(df):
        return df.withColumns({"client_ip": F.concat(F.lit("i"), (F.col("request_id") % 5).cast("string")),
                               "prompt_hash": F.concat("kind", (F.col("request_id") % 2).cast("string")), "prompt_pattern": F.col("kind")})

    params = replace(Params(), correlation_window_s=6 * 3600)
    cols = ("request_id", "exact_count", "fuzzy_count", "ip_count", "campaign_detected", "campaign_id", "confidence", "distributed")
    got = rows(run_available(ST.stream_campaigns(sightings(stream(spark, folder)), params)), *cols)
    assert got == rows(correlation.correlation_check(sightings(batch(spark, folder)), params=params), *cols)
    assert len({r[4:] for r in got}) > 4


def gate_inputs(df):
    i = F.col("request_id")
    return df.withColumns({
        "risk_block": F.col("kind") == "abuse", "recursive_detected": i % 17 == 0, "cost_score": (i % 101).cast("int"),
        "proof": (i % 3 - 1).cast("int"), "defender_risk": F.when(i % 11 == 0, 0.7).otherwise(0.1),
        "deny_reason": F.when(i % 13 == 0, "user blacklisted"),
    })


def test_the_gate_as_requests_come(spark, folder):
    params = replace(Params(), quota_limit=3, quota_window_s=6 * 3600, reputation_ttl_s=86400)
    cols = ("request_id", "user_id", *gate.OUTPUTS)
    got = rows(run_available(ST.stream_gate(gate_inputs(stream(spark, folder)), params)), *cols)
    assert got == rows(gate.request_gate(gate_inputs(batch(spark, folder)), params), *cols)
    assert {r[2] for r in got} >= {"auth", "risk", "amplification", "defender", "allowed"}


def test_a_stream_starts_from_a_snapshot(spark, folder, tmp_path):
    params = replace(Params(), reputation_ttl_s=5 * 86400)
    times = sorted(r.ts_us for r in batch(spark, folder).collect())
    middle = times[200]
    earlier = batch(spark, folder).filter(F.col("ts_us") < middle)
    save_snapshot(reputation.latest_state(reputation.reputation_fold(earlier, params=params)), f"{tmp_path}/s")
    known = ST.trust_state(load_snapshot(spark, f"{tmp_path}/s", middle, params.reputation_ttl_s * 1_000_000))
    later = stream(spark, folder).filter(F.col("event_time") >= F.timestamp_micros(F.lit(middle)))
    cols = ("request_id", *reputation.OUTPUTS)
    got = rows(run_available(ST.stream_reputation(later, params, known)), *cols)
    every = reputation.reputation_fold(batch(spark, folder), params=params).filter(F.col("ts_us") >= middle)
    assert got == rows(every, *cols) and len(got) > 150


def test_restart_continues_from_checkpoint(spark, folder, tmp_path):
    first, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    halves = [tuple(r) for r in batch(spark, folder).collect()]
    halves.sort(key=lambda r: r[2])
    for part in (halves[:200], halves[200:], [(-1, None, END, None, None)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(first)
        s = ST.before(ST.with_event_time(spark.readStream.schema(SCHEMA).parquet(first), "1 hour"), END)
        start(ST.stream_quota(s), out, cp).awaitTermination()
    cols = ("request_id", "quota_used", "quota_allowed")
    assert rows(spark.read.parquet(out), *cols) == rows(anchored.quota_check(batch(spark, folder)), *cols)


def test_late_rows_are_dropped_and_counted_and_kept_aside(spark, tmp_path):
    base = f"{tmp_path}/late"
    parts = [[(0, "u", 10 * HOUR, "read", 0.0)], [(10, "u", 10 * HOUR + 1, "read", 0.0)], [(20, "u", 1, "read", 0.0), (21, "u", 11 * HOUR, "read", 0.0), (22, "v", 9 * HOUR, "read", 0.0)]]
    for n, part in enumerate([*parts, [(-1, None, END, None, None)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(base)
        s = ST.before(ST.with_event_time(spark.readStream.schema(SCHEMA).parquet(base), "1 hour"), END)
        q = start(ST.stream_quota(s), f"{base}-out", f"{base}-cp")
        q.awaitTermination()
        if n == 2:
            assert late_rows(q) == 2
    assert sorted(r.request_id for r in spark.read.parquet(f"{base}-out").collect()) == [0, 10, 21]
    write_arrivals(spark, f"{base}-files", parts)
    for _ in range(2):  # a second run finds nothing new
        files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{base}-files")
        split_late(files, f"{base}-split", HOUR)
    late = spark.read.parquet(f"{base}-split/late")
    assert sorted((r.request_id, r.trigger, r.watermark_us) for r in late.collect()) == [(20, 2, 9 * HOUR), (22, 2, 9 * HOUR)]
    assert sorted(r.request_id for r in spark.read.parquet(f"{base}-split/on_time").collect()) == [-1, 0, 10, 21]


def test_the_newest_rows_of_a_log_and_a_repeated_trigger(spark, folder, tmp_path):
    def run(path):
        df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
        keep_newest(df.filter("request_id >= 0"), path, 30, ["ts_us", "request_id"])
        return rows(newest(spark, path), "request_id", "ts_us"), spark.read.parquet(f"{path}/log").count()

    want = sorted([(r.ts_us, r.request_id) for r in batch(spark, folder).collect()])[-30:]
    got, logged = run(f"{tmp_path}/a")
    assert sorted((t, i) for i, t in got) == want and logged == 400
    commits = sorted((tmp_path / "a/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].rename(tmp_path / "undone")  # as if the last trigger had died before it was noted
    (tmp_path / "a/checkpoint/commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run(f"{tmp_path}/a") == (got, logged)


def test_state_is_a_few_tables_for_many_users(spark, tmp_path):
    first = [(i, f"u{i}", HOUR + i, "read", 0.0) for i in range(20_000)]
    write_arrivals(spark, f"{tmp_path}/in", [first, [(20_000, "u0", 3 * HOUR, "read", 0.0)]])
    query = start(ST.stream_quota(stream(spark, f"{tmp_path}/in", "1 hour")), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) < 20_000
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20_001


def test_presence_as_intervals_equals_a_count_by_row(spark):
    rng = random.Random(8)
    rows = sorted((rng.randrange(3), rng.randrange(60), rng.randrange(4)) for _ in range(200))
    key, t, member = (np.array(c) for c in zip(*rows))
    processor = MemberProcessor(None, [], "t", "i", [], {}, {}, 7)
    got = processor.counted(t, key, key * 10 + member, 0).tolist()
    assert got == [len({m for k, u, m in rows if k == a and b - 7 <= u <= b}) for a, b, _ in rows]
