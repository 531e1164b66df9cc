"""Training, scoring and evaluating the cost model."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptwatch.functions.cost import FEATURES, TEXT_FORMS, with_cost_signals, with_text_forms
from promptwatch.sources.workspace import materialize

# Column names of the exported training data, and display names of the features.
CSV_COLUMNS = ["prompt", "label", "encoding_score", "expansion_factor_normalized", "obfuscation_score", "entropy_score"]
FEATURE_NAMES = ["encoding_score", "expansion_factor(normalized)", "obfuscation_score", "entropy_score"]


def extract_features(df: DataFrame) -> DataFrame:
    """The four serving-time features of each prompt, under their training names."""
    return with_model_features(with_cost_signals(with_text_forms(df)).drop(*TEXT_FORMS))


def with_model_features(signals: DataFrame) -> DataFrame:
    """Cost signals with the one feature that the model reads in another scale."""
    return signals.withColumn("expansion_normalized", F.least(F.col("expansion_factor") * 2, F.lit(100.0)))


def dataset_union(*parts: DataFrame) -> DataFrame:
    """Concatenate labelled parts; their order carries no meaning."""
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return df


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), F.count_if(F.col(label) == 1).alias("risky"),
        F.count_if(F.col(label) == 0).alias("benign"),
    )


def stratified_split(
    df: DataFrame, key: str, label: str = "label", train: float = 0.8, seed: int = 42, buckets: int = 4096
) -> DataFrame:
    """Add ``split`` (train/test): exactly ``floor(train * n)`` training rows per label.

    Rows are ranked by a hash of the key. A label may hold most of the rows, so the rank
    is taken inside hash buckets, on top of the sizes of the buckets before it.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    df = df.withColumn("_h", digest).withColumn("_b", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32)).cast("int"))
    sizes = df.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    by_label = Window.partitionBy(label)
    before = by_label.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        label, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.floor(F.sum("_n").over(by_label) * train).alias("_take"),
    )
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    placed = df.withColumn("_r", rank).join(sizes, [label, "_b"])
    inside = F.col("_before") + F.col("_r") <= F.col("_take")
    return placed.withColumn("split", F.when(inside, "train").otherwise("test")).drop(
        "_h", "_b", "_r", "_before", "_take"
    )


@dataclass(frozen=True)
class CostModel:
    """A standardised logistic regression: probability = sigmoid(intercept + sum(weight * (x - mean) / scale))."""

    features: list[str]
    means: list[float]
    scales: list[float]
    weights: list[float]
    intercept: float
    rows: int
    rounds: int

    def standardised(self) -> list[Column]:
        return [(F.col(f) - F.lit(m)) / F.lit(s) for f, m, s in zip(self.features, self.means, self.scales)]

    def probability(self) -> Column:
        margin = F.lit(self.intercept)
        for w, z in zip(self.weights, self.standardised()):
            margin = margin + F.lit(w) * z
        return 1 / (1 + F.exp(-margin))


def _sums(table: DataFrame, model: CostModel, label: str, curved: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Log loss, gradient and, if asked, curvature of the unpenalised loss, by one partially combined aggregate."""
    z, p, n = [*model.standardised(), F.lit(1.0)], model.probability(), F.col("_n")
    # log(1 + exp(-m)) of the margin towards the label, without overflow
    margin = F.log(F.col("_p")) - F.log1p(-F.col("_p"))
    signed = F.when(F.col(label) == 1, margin).otherwise(-margin)
    k = len(z)
    rows = table.select(label, "_n", F.greatest(F.lit(1e-300), F.least(F.lit(1 - 2.0**-53), p)).alias("_p"), *[x.alias(f"_z{i}") for i, x in enumerate(z)])
    x = [F.col(f"_z{i}") for i in range(k)]
    sums = [F.sum(n * F.log1p(F.exp(-signed)))] + [F.sum(n * (F.col("_p") - F.col(label)) * x[i]) for i in range(k)]
    if curved:
        sums += [F.sum(n * F.col("_p") * (1 - F.col("_p")) * x[i] * x[j]) for i in range(k) for j in range(i + 1)]
    got = [float(v) for v in rows.agg(*sums).first()]
    hessian = np.zeros((k, k))
    if curved:
        hessian[np.tril_indices(k)] = got[1 + k :]
        hessian = np.tril(hessian) + np.tril(hessian, -1).T
    return got[0], np.array(got[1 : 1 + k]), hessian


def train_cost_model(train: DataFrame, label: str = "label", penalty: float = 1.0, max_rounds: int = 100, close: float = 1e-9) -> CostModel:
    """Standardise and fit a logistic regression with unit inverse regularisation, by Newton's method.

    Equal rows are counted once. Every round is one aggregate over those: a gradient and a curvature matrix of a row and a
    column for each feature and the intercept, which alone come to the driver. A round that does not lower the loss is
    taken again with half the step. Features without spread keep their scale; a table without rows, or with one label
    only, has no finite optimum for the intercept and is refused.
    """
    k = len(FEATURES)
    table = materialize(train.select(F.col(label).cast("int").alias(label), *FEATURES).groupBy(label, *FEATURES).agg(F.count("*").alias("_n")))
    n = F.col("_n")
    first = table.agg(F.sum("_n"), F.sum(n * F.col(label)), *[F.sum(n * F.col(f)) for f in FEATURES]).first()
    rows, risky = int(first[0] or 0), int(first[1] or 0)
    if not 0 < risky < rows:
        raise ValueError(f"{rows} rows, {risky} of them risky: a classifier needs both labels")
    means = [float(x) / rows for x in first[2:]]
    spread = table.agg(*[F.sum(n * (F.col(f) - F.lit(m)) * (F.col(f) - F.lit(m))) for f, m in zip(FEATURES, means)]).first()
    scales = [math.sqrt(float(x) / rows) or 1.0 for x in spread]

    def at(beta: np.ndarray, rounds: int) -> CostModel:
        return CostModel(list(FEATURES), means, scales, [float(b) for b in beta[:k]], float(beta[k]), rows, rounds)

    shrink = np.array([penalty] * k + [0.0])
    beta = np.array([0.0] * k + [math.log(risky / (rows - risky))])
    loss, gradient, curvature = _sums(table, at(beta, 0), label)
    loss += float(shrink @ beta**2) / 2
    for done in range(1, max_rounds + 1):
        slope = gradient + shrink * beta
        if np.abs(slope).max() <= close * rows:
            break
        step, size = np.linalg.solve(curvature + np.diag(shrink + 1e-12), slope), 1.0
        while True:
            tried = beta - size * step
            new, new_gradient, new_curvature = _sums(table, at(tried, done), label)
            new += float(shrink @ tried**2) / 2
            if new <= loss + 1e-12 * abs(loss) or size < 1e-6:
                break
            size /= 2
        beta, loss, gradient, curvature = tried, new, new_gradient, new_curvature
    return at(beta, done)


def score(model: CostModel, features: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``cost_score``, the model's rounded percentage, replacing the fallback score."""
    risky = model.probability()
    return features.withColumns({
        "prediction": (risky > 0.5).cast("double"),
        "cost_score": F.bround(risky * 100).cast("int"),
        "scoring_method": F.lit("ml_classifier"),
    })


def score_with_store(spark: SparkSession, path: str, features: DataFrame) -> DataFrame:
    """Score with the stored model; where no store is there keep the fallback average."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        # only a store that is not there means the fallback scorer; an outage must be seen
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return features.withColumn("scoring_method", F.lit("fallback_average"))
    return score(CostModel(**stored.first().asDict()), features)


def save_model(spark: SparkSession, model: CostModel, path: str) -> None:
    """A model is a table of one row."""
    schema = "features array<string>, means array<double>, scales array<double>, weights array<double>, intercept double, rows bigint, rounds int"
    spark.createDataFrame([asdict(model)], schema).coalesce(1).write.mode("overwrite").parquet(path)


def write_training_csv(features: DataFrame, path: str) -> None:
    named = features.withColumnRenamed("expansion_normalized", "expansion_factor_normalized")
    named.select(*CSV_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def feature_weights(spark: SparkSession, model: CostModel) -> DataFrame:
    return spark.createDataFrame(list(zip(FEATURE_NAMES, model.weights)), "feature string, weight double")


def optimality(model: CostModel, train: DataFrame, label: str = "label", penalty: float = 1.0) -> list[float]:
    """The penalised loss's gradient by feature, then by intercept: all zero where the fit is exact."""
    gradient = _sums(train.withColumn("_n", F.lit(1)), model, label, curved=False)[1]
    return (gradient + penalty * np.array([*model.weights, 0.0])).tolist()


def classification_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class: precision, recall, F1 and support, with the overall accuracy."""
    pairs = scored.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("pred")).count()
    classes = pairs.select(F.explode(F.array(
        F.struct(F.col("label").alias("c"), F.when(F.col("label") == F.col("pred"), F.col("count")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("predicted"), F.col("count").alias("support")),
        F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("tp"), F.col("count").alias("predicted"),
                 F.lit(0).cast("long").alias("support")),
    )).alias("x")).select("x.*")
    by_class = classes.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("tp", "predicted", "support")])
    everything = Window.partitionBy()
    precision = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    by_class = by_class.withColumns({
        "precision": precision, "recall": recall,
        "accuracy": F.sum("tp").over(everything) / F.sum("support").over(everything),
    })
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return by_class.select(F.col("c").alias("label"), "precision", "recall", f1.alias("f1"), "support", "accuracy")
