"""The fitted cost model: exact optimum, scoring, storing."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptwatch.functions.cost import FEATURES
from promptwatch.plans import training as M
from promptwatch.sources import bindings as B

SCHEMA = "label int, " + ", ".join(f"{f} double" for f in FEATURES)


def plain_fit(rows, rounds=200):
    """Newton on standardised columns, with numpy."""
    y, x = np.array([r[0] for r in rows], float), np.array([r[1:] for r in rows], float)
    spread = x.std(axis=0)
    z = np.column_stack([(x - x.mean(axis=0)) / np.where(spread > 0, spread, 1), np.ones(len(x))])
    shrink, beta = np.array([1.0] * 4 + [0.0]), np.zeros(5)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ beta))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(shrink + 1e-12), z.T @ (p - y) + shrink * beta)
        beta = beta - step * min(1, 2 / max(1e-9, np.abs(step).max()))
    return beta, 1 / (1 + np.exp(-z @ beta))


def labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = rng.choice([0, 0, 50, 90]), rng.choice([2.0, 2.0, 40.0, 100.0]), rng.uniform(0, 30)
        rows.append((int(rng.random() < 1 / (1 + math.exp(2 - a / 40 - b / 50))), float(a), b, c, 7.0))
    return rows + rows[:20]


@pytest.mark.parametrize("seed", [1, 2])
def test_the_fit_is_the_optimum(spark, seed):
    rows = labelled(300, seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = M.train_cost_model(df)
    beta, p = plain_fit(rows)
    assert np.allclose([*model.weights, model.intercept], beta, atol=1e-7) and model.weights[3] == pytest.approx(0, abs=1e-9)
    assert np.abs(M.optimality(model, df)).max() < 1e-6
    got = sorted(r["cost_score"] for r in M.score(model, df).collect())
    assert got == sorted(round(100 * x) for x in p)


def test_separable_rows_and_single_labels(spark):
    rows = [(int(i >= 10), float(100 * (i >= 10)), 2.0, 0.0, 0.0) for i in range(20)]
    model = M.train_cost_model(spark.createDataFrame(rows, SCHEMA))
    assert np.allclose([*model.weights, model.intercept], plain_fit(rows)[0], atol=1e-6)
    far = M.score(model, spark.createDataFrame([(0, 1e9, 2.0, 0.0, 0.0), (0, -1e9, 2.0, 0.0, 0.0)], SCHEMA)).collect()
    assert sorted(r["cost_score"] for r in far) == [0, 100]
    for bad in ([], rows[:5]):
        with pytest.raises(ValueError, match="both labels"):
            M.train_cost_model(spark.createDataFrame(bad, SCHEMA))


def test_a_stored_model_is_the_same_model(spark, tmp_path):
    model = M.train_cost_model(spark.createDataFrame(labelled(100, 3), SCHEMA))
    M.save_model(spark, model, f"{tmp_path}/m")
    assert M.CostModel(**spark.read.parquet(f"{tmp_path}/m").first().asDict()) == model
    (tmp_path / "broken").mkdir()
    with pytest.raises(Exception, match="schema|infer"):
        M.score_with_store(spark, f"{tmp_path}/broken", spark.createDataFrame(labelled(5, 4), SCHEMA))


def test_a_model_runs_after_an_observation(spark):
    from pyspark.sql import Observation

    spark.range(5).observe(Observation(), F.count(F.lit(1)).alias("n")).collect()
    df = spark.createDataFrame(labelled(60, 5), SCHEMA)
    assert M.score(M.train_cost_model(df), df).count() == 80


def test_small_tables_are_dealt_out_and_large_ones_left(spark, tmp_path):
    spark.range(20_000).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    used = B.spread(one).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert B.spread(one) is one
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
