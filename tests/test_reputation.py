"""Reputation and the gate against their step functions and hand-made sequences."""

import random
from dataclasses import replace

import pytest

from promptwatch import Params
from promptwatch.operators import gate as G
from promptwatch.operators import reputation as R
from promptwatch.params import DAY_US, HOUR_US

EVENTS = "request_id long, user_id string, ts_us long, kind string, cost double"


def fold(spark, kinds, params=Params(), gap=1, cost=5.0):
    df = spark.createDataFrame([(i, "u", i * gap, k, cost) for i, k in enumerate(kinds)], EVENTS)
    return R.reputation_fold(df, params=params).orderBy("request_id").collect()


def test_new_user_and_boost(spark):
    rows = fold(spark, ["read", "success"])
    assert rows[0].trust_score == 0.7
    assert rows[1].trust_score == 0.7 + 0.05 * (1 - 5 / 200)


def test_clamps_and_tiers(spark):
    up = fold(spark, ["success"] * 20)
    assert max(r.trust_score for r in up) <= 1.0 and G.tier_of(up[9].trust_score) == "trusted"
    down = fold(spark, ["abuse"] * 20)
    assert min(r.trust_score for r in down) >= 0.0 and G.tier_of(down[4].trust_score) == "anonymous"
    assert [r.candidate for r in down[:5]] == [False, False, False, True, True]


def test_decay_expiry_and_reset(spark):
    rows = fold(spark, ["success", "read", "read"], gap=2 * DAY_US)
    assert rows[1].trust_read == round(rows[0].trust_score - 0.04, 3)
    assert fold(spark, ["abuse", "read"], gap=31 * DAY_US)[1].trust_read == 0.7
    assert fold(spark, ["abuse", "reset", "read"])[2].trust_read == 0.7
    raised = fold(spark, ["abuse"] * 4 + ["read"], gap=7 * HOUR_US)
    assert raised[-1].trust_read == 0.3
    kept = fold(spark, ["abuse"] * 4 + ["read"], Params(floor_only_lowers=True), gap=7 * HOUR_US)
    assert kept[-1].trust_read < 0.05


def random_events(seed, n=1200):
    rng, clock, rows = random.Random(seed), {}, []
    for i in range(n):
        u = rng.choice(["hot"] * 6 + ["b", "c"])
        clock[u] = clock.get(u, 0) + rng.choice([0, HOUR_US // 10, HOUR_US, 30 * HOUR_US, 31 * DAY_US if rng.random() < 0.1 else 1])
        kind = rng.choice(["success"] * 6 + ["abuse", "block", "challenge_fail", "read"] + (["reset"] if rng.random() < 0.1 else []))
        rows.append((i, u, clock[u], kind, float(rng.randint(0, 100))))
    return rows


@pytest.mark.parametrize("mode", ["python", "half_up"])
@pytest.mark.parametrize("hot_rows, chunk_rows", [(10**9, 1), (400, 60)])
def test_fold_equals_step_function(spark, mode, hot_rows, chunk_rows):
    rows = random_events(5)
    params = replace(Params(), rounding=mode, hot_rows=hot_rows, chunk_rows=chunk_rows)
    df = spark.createDataFrame(rows, EVENTS).repartition(5)
    got = {r.request_id: tuple(r[c] for c in R.OUTPUTS) for r in R.reputation_fold(df, params=params).collect()}
    state, want = {}, {}
    for i, u, t, kind, cost in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        state[u], want[i] = R.reputation_step(state.get(u), (t, kind, cost), params)
    assert got == want


GATE = "request_id long, user_id string, ts_us long, risk_block boolean, recursive_detected boolean, cost_score int, proof int, defender_risk double, deny_reason string"


def test_hot_users_with_costs_beyond_the_tables(spark):
    events = [(i, u, t, k, c * 40 - 300 if u == "hot" else c) for i, u, t, k, c in random_events(9, 900)]
    events = [(i, "hot" if i % 2 else u, t, k, c * 40 - 300 if i % 2 else c) for i, u, t, k, c in events]
    df = spark.createDataFrame(events, "request_id long, user_id string, ts_us long, kind string, cost double")
    cols = ("request_id", *R.OUTPUTS)
    wanted = sorted((tuple(r[c] for c in cols) for r in R.reputation_fold(df).collect()), key=str)
    hot = replace(Params(), hot_rows=300, chunk_rows=60)
    assert sorted((tuple(r[c] for c in cols) for r in R.reputation_fold(df, params=hot).collect()), key=str) == wanted


@pytest.mark.parametrize("hot_rows", [10**9, 100])
def test_gate_equals_step_function(spark, hot_rows):
    rng, clock, rows = random.Random(9), {}, []
    for i in range(900):
        u = rng.choice(["hot"] * 5 + ["b", "c", "d"])
        clock[u] = clock.get(u, 0) + rng.choice([1, HOUR_US // 20, HOUR_US // 3, HOUR_US, 26 * HOUR_US])
        rows.append((i, u, clock[u], rng.random() < 0.15, rng.random() < 0.1, rng.randint(0, 100), rng.randint(-1, 1),
                     rng.choice([0.1, 0.1, 0.1, 0.7]), "ip blacklisted" if rng.random() < 0.05 else None))
    params = replace(Params(), hot_rows=hot_rows)
    df = spark.createDataFrame(rows, GATE).repartition(3)
    got = {r.request_id: tuple(r[c] for c in G.OUTPUTS) for r in G.request_gate(df, params).collect()}
    state, want = {}, {}
    for i, u, *row, deny in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if deny:
            want[i] = ("auth", "blocked", None, None, None, None, None, None, False)
            continue
        state[u], want[i] = G.gate_step(state.get(u, (None, None)), (*row, 0), params)
    assert got == want
    assert {w[0] for w in want.values()} == {"auth", "risk", "amplification", "challenge", "proof", "defender", "allowed"}


def test_board(spark):
    states = spark.createDataFrame(
        [("a", 0, 0.8, 3, 0, 10.0, 5, None), ("b", 0, 0.2, 1, 2, 10.0, 5, 4), ("old", -31 * DAY_US, 0.9, 1, 0, 1.0, 1, None), ("gone", 0, None, 0, 0, 0.0, None, None)],
        "user_id string, saved_us long, trust_score double, total_requests long, abuse_count long, avg_cost_score double, last_seen_us long, last_abuse_us long")
    banned = spark.createDataFrame([("user", "a", "spam", "manual", 7), ("ip", "b", None, "auto", 8)], "kind string, key string, reason string, triggered_by string, ts_us long")
    board = R.board_sort(R.reputation_board(states, banned, 10)).orderBy("position").collect()
    assert [(r.user_id, r.tier, r.trust_score) for r in board] == [
        ("a", "blacklisted", 0.8), ("gone", "expired", 0.0), ("old", "expired", 0.0), ("b", "anonymous", 0.2)]
    assert (board[0].blacklist_reason, board[0].triggered_by, board[0].blacklisted_us, board[1].triggered_by) == ("spam", "manual", 7, None)
