"""Character entropy: a streaming-safe Arrow function and the aggregate form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


_SHORT, _BLOCK = 512, 512


def _text_entropy(text: str) -> float:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.unique(codes, return_counts=True)[1]
    p = counts / codes.size
    return float(-(p * np.log2(p)).sum())


@F.arrow_udf(DoubleType())
def shannon_entropy(texts: pa.Array) -> pa.Array:
    """Bits per character of each whole text; empty text is 0, NULL stays NULL.

    ASCII rows are counted straight from the Arrow buffer; only rows with other
    characters are decoded.
    """
    texts = texts.cast(pa.large_string())
    _, offsets_buf, data_buf = texts.buffers()
    offsets = np.frombuffer(offsets_buf, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    out = np.zeros(len(texts))
    foreign = []
    # short rows: one histogram over a block of them (row number and byte form the bin)
    short = np.flatnonzero((sizes > 0) & (sizes <= _SHORT))
    for begin in range(0, len(short), _BLOCK):
        rows = short[begin : begin + _BLOCK]
        n = sizes[rows]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        chars = data[np.repeat(offsets[rows], n) + inside].astype(np.int64)
        counts = np.bincount(np.repeat(np.arange(len(rows)), n) * 256 + chars, minlength=len(rows) * 256).reshape(-1, 256)
        out[rows] = np.log2(n) - np.where(counts > 0, counts * np.log2(np.maximum(counts, 1)), 0).sum(axis=1) / n
        foreign.extend(rows[counts[:, 128:].any(axis=1)].tolist())
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        counts = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
        p = counts[counts > 0] / sizes[i]
        out[i] = -(p * np.log2(p)).sum()
        if counts[128:].any():
            foreign.append(i)
    for i in foreign:
        out[i] = _text_entropy(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return pa.array(np.maximum(out, 0.0), mask=np.asarray(texts.is_null()))


def char_histogram(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Character counts per key (or over the corpus when no key is given)."""
    chars = df.select(*keys, F.explode(F.split(F.col(text), "")).alias("ch")).filter(F.col("ch") != "")
    return chars.groupBy(*keys, "ch").agg(F.count("*").alias("n"))


def entropy_by_key(df: DataFrame, text: str, key: str) -> DataFrame:
    """The same value as :func:`shannon_entropy` as two aggregations (no Python worker).

    Every key has a row: one with only empty texts has 0, one with only NULL texts has NULL.
    """
    nothing = F.array(F.lit(None).cast("string"))
    chars = F.when(F.length(text) > 0, F.filter(F.split(F.col(text), ""), lambda c: c != "")).otherwise(nothing)
    hist = df.select(key, F.col(text).isNotNull().alias("_has"), F.explode(chars).alias("ch")).groupBy(key, "ch").agg(
        F.count("ch").alias("n"), F.bool_or("_has").alias("_has")
    )
    n = F.sum("n")
    bits = F.coalesce(F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n, F.lit(0.0))
    return hist.groupBy(key).agg(F.when(F.bool_or("_has"), bits).alias("entropy"))


def entropy_score(length: Column, entropy: Column, low: float = 3.5, high: float = 4.7) -> Column:
    """Distance from ordinary prose, in either direction."""
    distance = F.when(entropy < low, low - entropy).when(entropy > high, entropy - high).otherwise(0.0)
    return F.when(length < 20, F.lit(0.0)).otherwise(F.least(distance * 40, F.lit(100.0)))
