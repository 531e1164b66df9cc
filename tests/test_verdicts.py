"""Verdict parsing and risk merging: the reference cases as rows of our own."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptwatch import Params
from promptwatch.functions import policy as PO
from promptwatch.functions import verdicts as V
from promptwatch.functions.exemplars import EXEMPLARS, exemplar_bank
from promptwatch.operators import similarity


def ext(spark, verdict, enabled=True):
    text = None if verdict is None else verdict if isinstance(verdict, str) else json.dumps(verdict)
    return V.with_ext_signals(spark.createDataFrame([(text,)], "ext_json string"), enabled=enabled).first()


@pytest.mark.parametrize("verdict, flags, score, status", [
    ({"categories": {"pii": True}, "category_scores": {"pii": 0.8}}, ["PII_DETECTED"], 80, "ok"),
    ({"categories": {"moderated_content/weapons": True}, "category_scores": {"moderated_content/weapons": 0.95}}, ["CONTENT_MODERATION_FLAG"], 95, "ok"),
    ({"results": [{"categories": {"jailbreak": True, "prompt_injection": True}, "flagged": True}]}, ["JAILBREAK_ATTEMPT"], 100, "ok"),
    ({"categories": {"some_new_detector": True}, "category_scores": {"some_new_detector": 0.6}}, ["LAKERA_SOME_NEW_DETECTOR"], 60, "ok"),
    ({"categories": {"jailbreak": False}, "category_scores": {"jailbreak": 0.4}}, [], 40, "ok"),
    ({"results": []}, [], 0, "ok"),
    ("not json", [], 0, "unavailable"),
    (None, [], 0, "unavailable"),
    ('{"flagged": tr', [], 0, "unavailable"),
    ('{"flagged":true} trailing', [], 0, "unavailable"),
    ('{"flagged":true}{}', [], 0, "unavailable"),
    ("{'flagged':true}", [], 0, "unavailable"),
    ('["flagged"]', [], 0, "unavailable"),
    ('\n {"flagged":true}\n', [], 100, "ok"),
])
def test_external_verdict(spark, verdict, flags, score, status):
    r = ext(spark, verdict)
    assert (r.ext_flags, r.ext_score, r.ext_status) == (flags, score, status)


def test_external_disabled(spark):
    r = ext(spark, {"flagged": True}, enabled=False)
    assert (r.ext_flags, r.ext_score, r.ext_status) == ([], 0, "disabled")


def test_merge_is_union_and_max(spark):
    df = spark.createDataFrame(
        [(["JAILBREAK_ATTEMPT"], ["JAILBREAK_ATTEMPT"], ["JAILBREAK_ATTEMPT", "PII_DETECTED"], 18, 91, 95), ([], [], [], 0, 0, 40)],
        "a array<string>, b array<string>, c array<string>, x int, y int, z int")
    flags, score, suspicious = V.risk_merge([F.col(c) for c in "abc"], [F.col(c) for c in "xyz"])
    rows = df.select(flags.alias("f"), score.alias("s"), suspicious.alias("u")).collect()
    assert (rows[0].f, rows[0].s, rows[0].u) == (["JAILBREAK_ATTEMPT", "PII_DETECTED"], 95, True)
    assert (rows[1].f, rows[1].s, rows[1].u) == ([], 40, False)


@pytest.mark.parametrize("reply, risk, confidence, reason, threats", [
    ('{"defender_risk":0.1,"confidence":0.9,"reason":"ok","threats":[]}', 0.1, 0.9, "ok", []),
    ('{"defender_risk":1.7,"confidence":-1,"reason":"x","threats":["a","b"]}', 1.0, 0.0, "x", ["a", "b"]),
    ('  ```json\n{"defender_risk":0.45}\n```  ', 0.45, 0.5, "no reason provided", []),
    ("{}", 0.1, 0.5, "no reason provided", []),
    ('{"defender_risk":"0.7"}', 0.7, 0.5, "no reason provided", []),
    ('{"defender_risk":"x"}', 0.1, 0.0, "defender unavailable", []),
    ('{"defender_risk":null}', 0.1, 0.0, "defender unavailable", []),
    ("not json", 0.1, 0.0, "defender unavailable", []),
    (None, 0.1, 0.0, "defender unavailable", []),
    ('{"defender_risk":0.9} trailing', 0.1, 0.0, "defender unavailable", []),
    ("{'defender_risk':0.9}", 0.1, 0.0, "defender unavailable", []),
    ('{"defender_risk":0.9,"threats":null}', 0.1, 0.0, "defender unavailable", []),
    ('{"defender_risk":0.9,"threats":7}', 0.1, 0.0, "defender unavailable", []),
    ('{"defender_risk":true,"threats":"ab"}', 1.0, 0.5, "no reason provided", ["a", "b"]),
    ('{"defender_risk":"true"}', 0.1, 0.0, "defender unavailable", []),
    ('{"defender_risk":"inf","confidence":false}', 1.0, 0.0, "no reason provided", []),
])
def test_defender_reply(spark, reply, risk, confidence, reason, threats):
    r = V.with_defender(spark.createDataFrame([(reply,)], "defender_text string")).first()
    assert (r.defender_risk, r.defender_confidence, r.defender_reason, r.defender_threats) == (risk, confidence, reason, threats)


def test_semantic_match(spark):
    bank = spark.createDataFrame([("A", [2.0, 0.0]), ("B", [0.0, 1.0]), ("B", [0.0, -5.0])], "category string, embedding array<double>")
    vectors = {0: [1.0, 0.1], 1: [0.0, -3.0], 2: [0.0, 0.0], 3: None}
    df = spark.createDataFrame(list(vectors.items()), "k int, embedding array<double>")
    rows = {r.k: r for r in similarity.semantic_match(df, bank).collect()}
    assert rows[0].semantic_flags == ["A"] and rows[0].max_similarity == round(1 / np.hypot(1, 0.1), 4)
    assert rows[1].semantic_flags == ["B"] and rows[1].semantic_matches[0].similarity == 1.0
    assert rows[2].semantic_flags == [] and rows[3].semantic_flags == [] and rows[3].max_similarity == 0.0


def test_semantic_score_of_a_paraphrase(spark):
    df = spark.createDataFrame([(["JAILBREAK_ATTEMPT"], 0.91), ([], 0.7)], "f array<string>, m double")
    assert [r.s for r in df.select(V.semantic_score(F.col("f"), F.col("m")).alias("s")).collect()] == [91, 0]


def test_embedder_runs_once_per_prompt(spark):
    df = spark.createDataFrame([(1, "h1", "ab"), (2, "h1", "ab"), (3, "h2", "abcd")], "k int, prompt_hash string, prompt string")
    out = similarity.embed_prompts(df, lambda p: F.array(F.length(p).cast("double"), F.lit(0.0)))
    assert {r.k: r.embedding for r in out.collect()} == {1: [1.0, 0.0], 2: [1.0, 0.0], 3: [1.0, 0.0]}


def test_exemplar_bank(spark):
    assert exemplar_bank(spark).count() == 31 == sum(map(len, EXEMPLARS.values()))


def test_a_bank_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(5)
    names = ["A", "B", "C"]
    bank_rows = [(names[0 if i < 40 else 1 + i % 2], rng.normal(size=4).tolist()) for i in range(90)] + [("B", [0.0] * 4)]
    vectors = [(i, rng.normal(size=4).tolist(), -1) for i in range(50)] + [(50, None, -1), (51, [1.0], -1), (52, [0.0] * 4, -1)] + [(0, [1.0, 0.0, 0.0, 0.0], -1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, _row int").drop("_row").repartition(3)
    bank = spark.createDataFrame(bank_rows, "category string, embedding array<double>").repartition(4)
    columns = ("vec_id", "semantic_flags", "semantic_matches", "max_similarity")
    whole = sorted(str([r[c] for c in columns]) for r in similarity.semantic_match(df, bank).collect())
    monkeypatch.setattr(similarity, "MOST_HELD", 7)
    dealt = similarity.semantic_match(df, bank)
    assert sorted(str([r[c] for c in columns]) for r in dealt.collect()) == whole and "A" in str(whole)
    assert dealt.columns == ["vec_id", "embedding", "semantic_matches", "semantic_flags", "max_similarity"]


def test_challenge_and_budget(spark):
    df = spark.createDataFrame([(0.9, 20), (0.2, 85), (0.2, 30), (0.9, 90)], "t double, c int")
    assert [r.x for r in df.select(PO.challenge_required(F.col("t"), F.col("c")).alias("x")).collect()] == [False, True, False, False]
    df = spark.createDataFrame([(10, 0.8), (10, 0.5), (10, 0.1), (40, 0.1), (70, 0.1), (70, 0.9)], "r int, t double")
    assert [r.x for r in df.select(PO.token_budget(F.col("r"), F.col("t")).alias("x")).collect()] == [5000, 3750, 2500, 1000, 250, 500]


def test_proof_audit(spark):
    import hashlib
    nonce = next(n for n in range(200_000) if hashlib.sha256(f"abc{n}".encode()).hexdigest().startswith("0000"))
    df = spark.createDataFrame([("abc", str(nonce), 10), ("abc", str(nonce), 301), ("abc", "0", 10)], "c string, n string, a int")
    rows = [r.p for r in df.select(PO.proof_audit(F.col("c"), F.col("n"), F.col("a")).alias("p")).collect()]
    assert [r.verified for r in rows] == [True, False, False]
    assert rows[1].reason == "challenge too old" and rows[2].reason.startswith("invalid nonce")


def test_decay_floor_variant(spark):
    from promptwatch.params import HOUR_US
    df = spark.range(1)
    args = (F.lit(0.1), F.lit(0), F.lit(48 * HOUR_US))
    assert df.select(PO.trust_decay(*args).alias("t")).first().t == 0.3
    assert df.select(PO.trust_decay(*args, Params(floor_only_lowers=True)).alias("t")).first().t == 0.1
