"""Similarity of prompt vectors to a curated bank of attack phrasings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptwatch.params import Params
from promptwatch.sources.workspace import materialize

#: Exemplars that a task holds at most. A larger bank is dealt to blocks of this size, which take turns.
MOST_HELD = 10_000
#: Exemplars that are compared with an Arrow batch at once.
BLOCK = 256


def unit_normalize(vec: Column) -> Column:
    """Vector divided by its length; the zero vector is left alone."""
    v = vec.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def _best(categories: list[str], names: list[str], embeddings: list[list[float]], vec: Column, dim: int) -> Column:
    """Best cosine per category as one array column; one matrix product per Arrow batch, no join and no shuffle."""
    vectors = np.array(embeddings, dtype=np.float64).reshape(len(embeddings), dim)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norms, out=vectors, where=norms > 0)
    owner = np.array([categories.index(c) for c in names])
    blocks = [[own[i : i + BLOCK] for i in range(0, len(own), BLOCK)] for own in (vectors[owner == c] for c in range(len(categories)))]

    @F.arrow_udf("array<double>")
    def best(batch: pa.Array) -> pa.Array:
        valid = np.asarray(batch.is_valid()) & (np.asarray(batch.value_lengths().fill_null(0)) == dim)
        taken = batch.filter(pa.array(valid))
        m = taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norm, out=m, where=norm > 0)
        top = np.full((len(m), len(blocks)), -np.inf)
        for c, own in enumerate(blocks):  # one block of the bank at a time against the batch
            for block in own:
                np.maximum(top[:, c], (m @ block.T).max(axis=1, initial=-np.inf), out=top[:, c])
        rows = iter(top.tolist())
        return pa.array([next(rows) if ok else None for ok in valid], pa.list_(pa.float64()))

    return best(vec)


def with_category_similarity(df: DataFrame, bank: DataFrame, vec: str, into: str) -> tuple[list[str], DataFrame]:
    """Categories in order, and ``df`` with their best cosines as one array column.

    A bank beyond ``MOST_HELD`` exemplars is written in blocks by a hash, and each block meets all vectors in a pass of
    its own, which keeps the larger of each category's maxima; a row's vector is written once and never shuffled.
    """
    plain = bank.select("category", "embedding")
    facts = plain.agg(F.count("*"), F.sort_array(F.collect_set("category")), F.max(F.size("embedding"))).first()  # categories are a few
    rows, categories, dim = facts
    if rows <= MOST_HELD:
        held = plain.toArrow()
        return categories, df.withColumn(into, _best(categories, held.column(0).to_pylist(), held.column(1).to_pylist(), F.col(vec), dim))
    blocks = -(-rows // MOST_HELD)
    dealt = materialize(plain.withColumn("_at", F.monotonically_increasing_id()))
    dealt = materialize(dealt.withColumn("_block", F.pmod(F.xxhash64("_at"), F.lit(2 * blocks))))
    keyed = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    found = keyed.select("_row", F.col(vec).alias("_vec"), F.lit(None).cast("array<double>").alias(into))
    for k in range(2 * blocks):
        held = dealt.filter(F.col("_block") == k).select("category", "embedding").toArrow()
        if held.num_rows:
            own = _best(categories, held.column(0).to_pylist(), held.column(1).to_pylist(), F.col("_vec"), dim)
            larger = F.when(F.col(into).isNull(), F.col("_own")).otherwise(F.zip_with(into, "_own", lambda a, b: F.greatest(a, b)))
            found = materialize(found.withColumn("_own", own).select("_row", "_vec", larger.alias(into)))
    return categories, keyed.join(found.drop("_vec"), "_row").drop("_row")


def embed_prompts(
    df: DataFrame, embedder: Callable[[Column], Column], key: str = "prompt_hash", prompt: str = "prompt"
) -> DataFrame:
    """Add ``embedding`` from a user's vectorised embedder, run once per distinct prompt."""
    once = df.groupBy(key).agg(F.first(prompt).alias("_text"))
    vectors = once.select(key, unit_normalize(embedder(F.col("_text"))).alias("embedding"))
    return df.join(vectors, key, "left")


def semantic_match(
    df: DataFrame, bank: DataFrame, vec: str = "embedding", params: Params = Params()
) -> DataFrame:
    """Add ``semantic_flags``, ``semantic_matches`` and ``max_similarity``.

    A row without a vector (the embedder was not available) raises no flag; nor does any row
    when the bank is empty.
    """
    if bank.isEmpty():
        return df.withColumns({
            "semantic_matches": F.array().cast("array<struct<category:string,similarity:double>>"),
            "semantic_flags": F.array().cast("array<string>"), "max_similarity": F.lit(0.0),
        })
    categories, df = with_category_similarity(df, bank, vec, "_best")
    pairs = F.array(*[
        F.struct(F.lit(c).alias("category"), F.get(F.col("_best"), i).alias("similarity"))
        for i, c in enumerate(categories)
    ])
    hits = F.filter(pairs, lambda p: F.coalesce(p["similarity"] >= params.similarity_threshold, F.lit(False)))
    return df.withColumns({
        "semantic_matches": F.transform(
            hits, lambda p: F.struct(p["category"].alias("category"), F.round(p["similarity"], 4).alias("similarity"))
        ),
        "semantic_flags": F.transform(hits, lambda p: p["category"]),
        "max_similarity": F.coalesce(F.greatest(F.round(F.array_max("_best"), 4), F.lit(0.0)), F.lit(0.0)),
    }).drop("_best")
