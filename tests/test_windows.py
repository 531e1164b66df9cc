"""Keyed windows against brute force, with one key holding most of the rows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promptwatch import Params
from promptwatch.operators import anchored, correlation
from promptwatch.operators.prefix import previous_in_key, running_sum

random.seed(11)
ROWS = [
    (i, random.choice(["hot"] * 6 + ["b", "c", None]), random.randint(0, 5000), f"u{random.randint(0, 5)}", f"i{random.randint(0, 3)}")
    for i in range(1500)
]
KEYS = {r[1] for r in ROWS}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "request_id long, k string, ts_us long, user_id string, client_ip string")


@pytest.mark.parametrize("window, slice_us, parts", [(7, 3, 8), (50, 1, 3), (400, 1000, 1)])
def test_distinct_members(rows, window, slice_us, parts):
    members = {"senders": ["user_id", "client_ip"], "ips": ["client_ip"]}
    out = correlation.distinct_in_window(rows.repartition(parts), "k", members, "ts_us", window, slice_us)
    got = {r.request_id: (r.senders, r.ips) for r in out.collect()}
    want = {}
    for i, k, t, _, _ in ROWS:
        seen = [r for r in ROWS if r[1] == k and t - window <= r[2] <= t]
        want[i] = (len({r[3:] for r in seen}), len({r[4] for r in seen}))
    assert got == want


def walked(length):
    want = {}
    for k in KEYS:
        start, n = None, 0
        for r in sorted((r for r in ROWS if r[1] == k), key=lambda r: (r[2], r[0])):
            if start is None or r[2] >= start + length:
                start, n = r[2], 0
            n += 1
            want[r[0]] = (start, n)
    return want


@pytest.mark.parametrize("length", [13, 1001])
@pytest.mark.parametrize("hot_rows", [10**9, 500])
def test_anchored_window(rows, length, hot_rows):
    out = anchored.anchored_window(rows, ["k"], "ts_us", length, "request_id", hot_rows)
    assert {r.request_id: (r.window_start, r.window_index) for r in out.collect()} == walked(length)


@pytest.mark.parametrize("batch", [1, 7, 100])
def test_windows_go_on_over_batches(spark, rows, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = anchored.anchored_window(rows, ["k"], "ts_us", 13, "request_id")
        assert {r.request_id: (r.window_start, r.window_index) for r in out.collect()} == walked(13)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=12), min_size=1, max_size=6), st.integers(1, 12))
def test_openers_of_a_batch(keys, length):
    keys = [sorted(k) for k in keys]
    t, new = np.array(sum(keys, [])), np.concatenate([[True] + [False] * (len(k) - 1) for k in keys])
    got = anchored.window_openers(t, new, np.flatnonzero(new), length)
    want = []
    for times in keys:
        start = None
        for x in times:
            want.append(start is None or x >= start + length)
            start = x if want[-1] else start
    assert got.tolist() == want


@pytest.mark.parametrize("order", [None, ["request_id"]])
def test_running_sum(rows, order):
    out = running_sum(rows.selectExpr("*", "request_id % 5 AS v"), ["k"], "ts_us", ["v"], 97, order)
    got = {r.request_id: r.v for r in out.collect()}
    for i, k, t, _, _ in ROWS:
        before = [r[0] % 5 for r in ROWS if r[1] == k and (r[2] <= t if order is None else (r[2], r[0]) <= (t, i))]
        assert got[i] == sum(before)


def test_previous(rows):
    got = {r.request_id: r.previous_us for r in previous_in_key(rows, ["k"], "ts_us", "request_id", 50).collect()}
    for k in KEYS:
        last = None
        for r in sorted((r for r in ROWS if r[1] == k), key=lambda r: (r[2], r[0])):
            assert got[r[0]] == last
            last = r[2]


def test_confidence_saturates_and_exact_is_asked_first(spark):
    second = 1_000_000
    data = [(i, i * second, f"u{i}", f"10.0.0.{i}", "h", "p") for i in range(7)]
    data += [(10 + i, i * second, f"u{i}", "10.0.0.1", f"x{i}", "q") for i in range(7)]
    df = spark.createDataFrame(data, "request_id long, ts_us long, user_id string, client_ip string, prompt_hash string, prompt_pattern string")
    got = {r.request_id: r for r in correlation.correlation_check(df).collect()}
    assert [got[i].confidence for i in range(7)] == [0.0, 0.0, 0.8, 0.9, 0.95, 0.95, 0.95]
    assert [got[10 + i].confidence for i in range(7)] == [0.0, 0.0, 0.0, 0.72, 0.8, 0.85, 0.85]
    assert got[2].campaign_id == "CAMP-H" and got[2].distributed and not got[13].distributed


@pytest.mark.parametrize("hot_rows", [10**9, 0])
def test_quota_and_campaign_log(spark, hot_rows):
    hour = 3600 * 1_000_000
    times = [0, 1, 2, 3, 4, 5, hour - 1, hour, hour + 1]
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(times)], "request_id long, user_id string, ts_us long")
    params = Params(hot_rows=hot_rows)
    got = [(r.quota_used, r.quota_allowed) for r in anchored.quota_check(df, params=params).orderBy("request_id").collect()]
    assert got == [(1, True), (2, True), (3, True), (4, True), (5, True), (5, False), (5, False), (1, True), (2, True)]
    seen = df.selectExpr("*", "'h' AS prompt_hash", "'CAMP-H' AS campaign_id", "request_id > 0 AS campaign_detected")
    log = [r.detected_at for r in anchored.campaign_log(seen, params=params).orderBy("detected_at").collect()]
    assert log == [1, hour + 1]


def test_global_rank(spark, rows):
    from pyspark.sql import functions as F

    from promptwatch.operators.ranking import global_rank

    got = global_rank(rows, [F.desc_nulls_last("k"), F.asc("ts_us"), F.asc("request_id")])
    want = sorted(ROWS, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""], r[2], r[0]))
    assert [r.request_id for r in got.orderBy("position").collect()] == [r[0] for r in want]
    assert global_rank(rows.limit(0), [F.asc("k")]).collect() == []
