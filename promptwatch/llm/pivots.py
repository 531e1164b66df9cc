"""Exact top-k inner products with a pivot-distance index.

Vectors are whole numbers (``floor(256 * x)``). With M the largest length, a row x gets one more component
sqrt(M^2 - |x|^2) and a query one of 0: then ``|q - x|^2 = |q|^2 + M^2 - 2 q . x``, so the largest products are the smallest
distances and the triangle inequality speaks of them directly. Pivots are chosen farthest-first from a sample of
``SAMPLE`` rows at most. Every row keeps its distances to all pivots and is keyed by the nearest one and that distance,
in rings of equal width whose number grows with the rows. A ring's summary (least and largest distance to every
pivot, rows, queries) is all that planning needs. For a query and a ring, and for a query and a row, each pivot p gives
``|q - x| >= | |q - p| - |x - p| |``; the best of these bounds counts.

Rings are taken in descending order of their bound: first as many as hold k rows besides the query's own, which gives
each query its k-th best score so far; then those whose bound still reaches it. Within a ring, rows are sorted by
distance to its pivot: a query looks at the annulus that can still matter, and at those of its rows that all other
pivots allow. What is left cannot hold a better row or an equal one.

Queries are dealt to groups by the ring they lie in, and a ring's rows are copied only for groups that visit it. Large
rings are cut into blocks. So neither a ring with very many rows (a vector that repeats) nor one that all queries visit
lands in one task, and each block gives k rows for a query at most. How much is pruned depends on the vectors: in clusters
nearly all, among random directions of many dimensions nothing (every exact method then compares everything).

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id;
shorter vectors count as filled up with zeros; components beyond the whole numbers of 64 bits count as the nearest, and so do
scores; repeated rows are rows of their own, and only the query's own row is left out; ties go to the smaller id. An empty
table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptwatch.llm.shared import materialize

#: Rows that pivots are chosen from.
SAMPLE = 2048
PIVOTS = 12
#: Rings of a pivot at least, and rows that a ring holds on average where more rings are needed.
RINGS, RING_ROWS = 8, 4096
BLOCK_ROWS = 8192
BLOCK_QUERIES = 2048


def whole(vector: Column) -> Column:
    """Components as whole numbers; null where the vector takes no part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    usable = vector.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(usable, F.transform(x, lambda c: F.floor(c * 256).cast("bigint")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to ``dims``."""
    if not len(column):
        return np.zeros((0, dims), np.int64)
    flat, size = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    if np.all(size == dims):
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(n) for n in size]).astype(int)] = flat
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sample row farthest from those before it."""
    picked = [0]
    gap = np.linalg.norm(sample - sample[0], axis=1)
    while len(picked) < n and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(sample - sample[picked[-1]], axis=1))
    return sample[picked]


class Index(NamedTuple):
    """What planning needs: pivots (with the added component), M, and the rings' summaries."""

    pivots: np.ndarray
    longest: float
    ring: np.ndarray
    low: np.ndarray  # (ring, pivot)
    high: np.ndarray
    rows: np.ndarray
    group: np.ndarray  # of each ring's queries the first group, and how many groups
    groups: np.ndarray


def with_added(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Rows or queries as doubles with the component that turns products into distances."""
    x = x.astype(float)
    added = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return np.concatenate([x, added[:, None]], axis=1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every row to every pivot, by differences."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(x), 0))


def build(vectors: DataFrame, is_query: Column, vec_id: str, vector: str) -> tuple[DataFrame, Index, int, str]:
    """(rows with uid, id, packed vector, distances, ring and whether they ask; index; dimensions; kind of arithmetic)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), whole(F.col(vector)).alias("v")).where("id is not null and v is not null")
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("asks", F.coalesce(is_query, F.lit(False))))
    wide = F.transform("v", lambda c: c.cast("double"))
    facts = rows.agg(
        F.max(F.size("v")), F.max(F.array_max(F.transform(wide, F.abs))), F.max(F.aggregate(wide, F.lit(0.0), lambda acc, c: acc + c * c)), F.count("*")
    ).first()
    dims, top, longest, n = facts[0] or 0, facts[1] or 0.0, float(np.sqrt(facts[2] or 0.0)) * (1 + 1e-12), facts[3]
    sample = rows.orderBy(F.xxhash64("id", "uid"), "uid").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    sample = with_added(_matrix(sample, dims), longest, False)
    pivots = choose_pivots(sample, PIVOTS) if len(sample) else np.zeros((0, dims + 1))
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches):
        p = shared.value
        for batch in batches:
            v = _matrix(batch.column(1), dims)
            gap = distances(with_added(v, longest, False), p)
            nearest = gap.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), batch.column(3), pa.array([r.tobytes() for r in v], pa.binary()),
                pa.array(nearest, pa.int32()), pa.array(gap[np.arange(len(v)), nearest]), pa.array(list(gap), pa.list_(pa.float64())),
            ], ["id", "uid", "asks", "packed", "pivot", "distance", "gaps"])

    schema = "id bigint, uid bigint, asks boolean, packed binary, pivot int, distance double, gaps array<double>"
    placed = materialize(rows.select("id", "v", "uid", "asks").mapInArrow(place, schema))
    many = max(RINGS, -(-n // (max(1, len(pivots)) * RING_ROWS)))
    width = (placed.agg(F.max("distance")).first()[0] or 0) / many + 1e-9
    placed = placed.withColumn("ring", (F.col("pivot") * many + F.least(F.floor(F.col("distance") / width), F.lit(many - 1))).cast("int"))
    ends = [f(F.get("gaps", k)).alias(f"{name}{k}") for k in range(len(pivots)) for name, f in (("low", F.min), ("high", F.max))]
    rings = placed.groupBy("ring").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking"), *ends).toPandas().sort_values("ring")
    low, high = (rings[[f"{name}{k}" for k in range(len(pivots))]].to_numpy(float) for name in ("low", "high"))
    group, groups, held, at = [], [], 0, 0
    for asking in rings["asking"].tolist():  # neighbouring rings share a group until it is full
        if held and held + asking > BLOCK_QUERIES:
            at, held = at + 1, 0
        cut = max(1, -(-asking // BLOCK_QUERIES))
        group.append(at)
        groups.append(cut)
        at, held = (at, held + asking) if cut == 1 else (at + cut, 0)
    index = Index(pivots, longest, rings["ring"].to_numpy(int), low, high, rings["n"].to_numpy(int), np.array(group, int), np.array(groups, int))
    most = top * top * max(dims, 1)
    return placed, index, dims, "double" if most < 1 << 52 else "long" if most < 1 << 62 else "wide"


def bounds(gaps: np.ndarray, squared: np.ndarray, index: Index) -> np.ndarray:
    """Largest possible score of each query (row) in each ring (column); never below the true one."""
    gap = np.zeros((len(gaps), len(index.ring)))
    for k in range(len(index.pivots)):
        far = gaps[:, k : k + 1]
        np.maximum(gap, np.maximum(far - index.high[:, k], index.low[:, k] - far), out=gap)
    gap = np.maximum(0, gap - slack(squared, index)[:, None])
    reach = squared[:, None] + index.longest**2
    return (reach - gap**2) / 2 + 1e-9 * (1 + reach)


def slack(squared: np.ndarray, index: Index) -> np.ndarray:
    """What rounding may have added to a difference of distances."""
    return 1e-6 * (1 + np.sqrt(squared) + index.longest)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", counted: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row that ``is_query`` (over column ``id``) selects.

    With ``counted`` also ``compared``: with how many rows the query's product was formed.
    """
    placed, index, dims, kind = build(vectors, is_query, vec_id, vector)
    chosen = placed.where("asks").select("id", "uid", "packed", "ring")
    found = materialize(_probe(placed, chosen.withColumn("least", F.lit(None).cast("bigint")), index, dims, kind, k, True))
    first = materialize(_best(found.where("id is not null"), k))
    limit = first.where(F.col("rank") == k).select("quid", F.col("score").alias("least"))
    again = chosen.join(limit, chosen["uid"] == limit["quid"], "left").drop("quid")
    rest = materialize(_probe(placed, again, index, dims, kind, k, False))
    every = first.drop("rank").unionByName(rest.where("id is not null"))
    best = _best(every, k)
    out = ["query_id", "rank", F.col("id").alias("vec_id"), "score"]
    if not counted:
        return best.select(*out)
    seen = found.unionByName(rest).where("id is null").groupBy("quid").agg(F.sum("score").alias("compared"))
    return best.join(seen, "quid").select(*out, "compared")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("quid").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unpacked(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), dims)


def _products(q: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    """Scores of queries (rows) and rows (columns), exactly; beyond 64 bits the nearest."""
    if kind == "double":
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    if kind == "long":
        return q @ x.T
    ends = np.iinfo(np.int64)
    return np.clip(q.astype(object) @ x.T.astype(object), ends.min, ends.max).astype(np.int64)


_SCORED = pa.schema([("query_id", pa.int64()), ("quid", pa.int64()), ("id", pa.int64()), ("uid", pa.int64()), ("score", pa.int64())])


def _probe(placed: DataFrame, queries: DataFrame, index: Index, dims: int, kind: str, k: int, first: bool) -> DataFrame:
    """Scores of queries in their first rings (as many as hold k rows and the query), or in all others that can matter.

    For each task and query there is also a row without an id, whose score is the number of rows compared.
    """
    shared = placed.sparkSession.sparkContext.broadcast(tuple(index))  # plain values: executors need no class of ours

    def visits(batches):
        index = Index(*shared.value)
        blocks = -(-index.rows // BLOCK_ROWS)
        for batch in batches:
            q = with_added(_unpacked(batch.column(2), dims), index.longest, True)
            home = np.searchsorted(index.ring, batch.column(3).to_numpy())
            least, uid = batch.column(4).to_pylist(), batch.column(1).to_numpy()
            groups = index.group[home] + np.where(index.groups[home] > 1, uid % index.groups[home], 0)
            for lo in range(0, len(q), 256):
                part = q[lo : lo + 256]
                best = bounds(distances(part, index.pivots), (part * part).sum(axis=1), index)
                at, to = [], []
                for i, row in enumerate(best):
                    order = np.lexsort((np.abs(np.arange(len(row)) - home[lo + i]), -row))
                    head = 1 + int(np.searchsorted(np.cumsum(index.rows[order]), k + 1))
                    own = order[:head] if first else order[head:]
                    if not first and least[lo + i] is not None:
                        own = own[row[own] >= least[lo + i]]
                    cut = blocks[own]
                    at += [lo + i] * int(cut.sum())
                    to += [(r, b) for r, n in zip(index.ring[own].tolist(), cut.tolist()) for b in range(n)]
                if at:
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([
                        *(batch.column(c).take(take) for c in (0, 1, 2, 4)), pa.array([r for r, _ in to], pa.int32()),
                        pa.array([b for _, b in to], pa.int32()), pa.array(groups[at], pa.int64()),
                    ], ["id", "uid", "packed", "least", "ring", "part", "visitors"])

    schema = "id bigint, uid bigint, packed binary, least bigint, ring int, part int, visitors bigint"
    wanted = materialize(queries.select("id", "uid", "packed", "ring", "least").mapInArrow(visits, schema))
    blocks = placed.groupBy("ring").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    visited = wanted.select(F.col("ring").alias("to"), F.col("part").alias("block"), F.col("visitors").alias("by")).distinct()
    rows = placed.select("ring", "id", "uid", "packed", "gaps").join(blocks, "ring")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).drop("blocks")
    rows = rows.join(visited, (F.col("ring") == F.col("to")) & (F.col("part") == F.col("block"))).drop("to", "block").withColumn("visitors", F.col("by") + 0).drop("by")

    def score(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _SCORED.empty_table()
        index = Index(*shared.value)
        q, x = _unpacked(queries.column("packed"), dims), _unpacked(rows.column("packed"), dims)
        gaps = rows.column("gaps").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        pivot = int(np.bincount(gaps.argmin(axis=1)).argmax()) if gaps.shape[1] else 0
        near = gaps[:, pivot] if gaps.shape[1] else np.zeros(len(x))
        ids, uids = (rows.column(c).to_numpy() for c in ("id", "uid"))
        by = np.argsort(near, kind="stable")
        ids, uids, x, gaps, near = ids[by], uids[by], x[by], gaps[by], near[by]
        qid, quid, least = (queries.column(c).to_pylist() for c in ("id", "uid", "least"))
        lifted = with_added(q, index.longest, True)
        squared, own = (lifted * lifted).sum(axis=1), distances(lifted, index.pivots)
        limit = np.array([np.inf if s is None else max(0.0, n + index.longest**2 - 2 * s) for s, n in zip(least, squared.tolist())])
        radius = np.sqrt(limit + 1e-9 * (1 + squared + index.longest**2)) + slack(squared, index)
        middle = own[:, pivot] if own.shape[1] else np.zeros(len(q))
        lo, hi = np.searchsorted(near, middle - radius), np.searchsorted(near, middle + radius, side="right")
        out: list[list] = [[], [], [], [], []]
        for a in range(0, len(q), 128):
            block = range(a, min(a + 128, len(q)))
            dense = (hi[a : a + 128] - lo[a : a + 128]).sum() * 2 > len(block) * len(x)  # then one product is cheaper than many
            scores = _products(q[a : a + 128], x, kind) if dense else None
            for i in block:
                if dense:
                    at, s, compared = np.arange(len(x)), scores[i - a], len(x)
                else:
                    at = np.arange(lo[i], hi[i])
                    for p in range(own.shape[1]):
                        at = at[np.abs(gaps[at, p] - own[i, p]) <= radius[i]]
                    s, compared = _products(q[i : i + 1], x[at], kind)[0], len(at)
                ok = uids[at] != quid[i]
                if least[i] is not None:
                    ok &= s >= least[i]
                at, s = at[ok], s[ok]
                if len(at) > k:
                    best = s >= np.partition(s, len(at) - k)[len(at) - k]
                    at, s = at[best], s[best]
                    best = np.lexsort((uids[at], ids[at], -s.astype(object) if kind == "wide" else -s))[:k]
                    at, s = at[best], s[best]
                out[0] += [qid[i]] * (len(at) + 1)
                out[1] += [quid[i]] * (len(at) + 1)
                out[2] += [None, *ids[at].tolist()]
                out[3] += [None, *uids[at].tolist()]
                out[4] += [compared, *s.tolist()]
        return pa.table([pa.array(c, pa.int64()) for c in out], schema=_SCORED)

    keys = ("ring", "part", "visitors")
    return wanted.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(score, "query_id bigint, quid bigint, id bigint, uid bigint, score bigint")


def top_products(vectors: DataFrame) -> DataFrame:
    """The five best rows for every row whose id is divisible by 50."""
    return nearest(vectors, F.col("id") % 50 == 0)
