"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import contextlib
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptwatch.sources import workspace

__all__ = [
    "chunks", "connected", "discard", "folder", "fresh", "kept", "lower_ascii", "materialize", "mix", "posix", "read",
    "shuffles_removed", "strings", "text_chunks", "word_hashes",
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; only Spark opens it."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Whether shuffle files go when the query that made them ends, and not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Within this, queries remove their shuffle files as they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read that; nothing needs its shuffle files afterwards."""
    with shuffles_removed(df.sparkSession):
        return workspace.materialize(df)


def discard(table: DataFrame) -> None:
    """Remove a table that :func:`materialize` wrote and no plan reads any more."""
    files = table.inputFiles()
    if files:
        fs, path = posix(files[0].rsplit("/", 1)[0])
        fs.delete_dir(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    while name in df.columns:
        name += "_"
    return name


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder for an operator's own files, in the shared folder of the cluster."""
    return f"{workspace.workspace_path(spark)}-{kind}-{uuid.uuid4().hex[:8]}"


def posix(uri: str):
    """(file system, path) of a shared folder's URI, for files that Spark has no writer for."""
    import pyarrow.fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(uri)


def kept(key: tuple, make: Callable[[], object], most: int = 8) -> object:
    """An object that a Python worker keeps between its tasks.

    Functions travel to the workers by value, so the globals of this package begin anew with every task.
    """
    store = sys.modules.setdefault("_kept_between_tasks", types.ModuleType("_kept_between_tasks")).__dict__
    if key not in store:
        own = [k for k in store if isinstance(k, tuple)]
        for old in own[: max(0, len(own) - most + 1)]:
            del store[old]
        store[key] = make()
    return store[key]


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def text_chunks(column: pa.Array, limit: int) -> Iterator[tuple[int, int, list[str]]]:
    """(a, b, texts) of neighbouring rows [a, b) with ``limit`` bytes together at most; null counts as empty.

    Only one chunk's texts are Python strings at a time.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in chunks(sizes, limit):
        yield a, b, strings(column.slice(a, b - a))


def chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of neighbouring items whose sizes add up to ``limit`` at most; a larger item stands alone."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes whose words are hashed together.
SEGMENT = 1 << 19

#: Each byte's value in a word's polynomial hash.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; a worker keeps one table for each base."""
    have = kept(("powers", base), dict)
    if len(have.get("table", ())) <= n:
        factors = np.full(max(SEGMENT, n) + 1, base, np.uint64)
        factors[0] = 1
        have["table"] = np.multiply.accumulate(factors)
    return have["table"][: n + 1]


def lower_ascii() -> np.ndarray:
    """Table of 256 bytes: A-Z to lower case, every other byte to itself."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_hashes(data: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word in UTF-8 ``data``.

    ``word`` says by byte value what belongs to a word. The hash depends on the word's bytes alone; all hashes of a
    segment come from one running sum, and segments are cut between words.
    """
    parts, at = [], 0
    while at < len(data):
        stop = at + SEGMENT
        while stop < len(data) and word[data[stop]]:
            gap = np.flatnonzero(~word[data[stop : stop + SEGMENT]])
            stop += int(gap[0]) if len(gap) else SEGMENT
        start, end, value = _segment_hashes(data[at:stop], word)
        parts.append((start + at, end + at, value))
        at = stop
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


def _segment_hashes(data: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = word[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n)[:n], out=total[1:])
    value = (total[end] - total[start]) * _powers(_INVERSE, n)[start]
    return start, end, mix(value ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node that has an edge.

    Large-star and small-star rounds alternate: every node points its larger neighbours at its smallest one, then
    its smaller neighbours and itself. The edges of a round are one table in the shared folder and the driver sees
    a count and a checksum only; the rounds end when those stay, after a number that grows with the logarithm of the
    largest component. Each star's minimum comes from a partially combined aggregate, so a hub with very many
    neighbours is no group of its own.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v"))
            )
        return out.where("u <> v").distinct()

    def written(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        """The pairs as a table, and its count and checksum."""
        table = materialize(pairs)
        return table, tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs, now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while now[0] and now != before:
        before = now
        pairs, now = written(star(star(pairs, True), False))
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
