"""Conversation prefix trie: sorted neighbours, their common prefixes, and union-find from the deepest upward.

A conversation is the sequence of its turns' digests (two 64-bit hashes of role and text, and the bytes of the text).
Equal sequences are one class with a count, its least conv_id and its members' ids. Classes are sorted as sequences over
the whole cluster (range partitions), and every piece of a partition, an Arrow batch, becomes a forest by itself:
neighbours are joined by edges of the length of their common prefix, edges are taken in descending length, and a
union at length d makes or widens the node of depth d at which the joined conversations part. Before a depth is left, every
component is a node of that depth; its first row is its root, since components are runs of sorted rows.

Nodes on the path of a piece's first or last row may go on in the next piece: they are *open*. They are put out with what
their closed children contribute and a digest of their path as a key, and are merged over all pieces by sums and minima;
what is missing then (open children, saved tokens of merged counts) is added along the paths: every open node
counts for each of its ancestors. A piece contributes two paths at most, so the contracted forest has two paths' nodes
for each piece, never a row for each conversation.

Leaves are nodes without a child. A node saves (members - 1) times the bytes of its last turn's text, which is what a
serving cache keeps by storing the turn once; ``saved_tokens`` is the sum over the subtree.

Members that end at a node are listed by ids in order: ids are packed by runs of ``PACK`` numbers and a hash goes over the
packs in order, holding one pack at a time, so a third of all conversations may be equal.

Defined results: rows without a conv_id are no turns of any conversation; null role and text count as empty; turns with
the same number are ordered by their digests, so results do not depend on the order of rows; a conversation without
turns after rebuilding ends at the root; an empty table gives no row. Columns other than the four are not read. A
conversation's digests (24 bytes a turn) are held by one task; texts never are: they do not leave the scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptwatch.llm.shared import materialize

#: Bits of an id that a pack of ids spans.
PACK = 16
NOTHING = hashlib.sha256(b"").hexdigest()

_NODE = pa.schema([
    ("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("least", pa.int64()), ("n", pa.int64()), ("children", pa.int64()),
    ("leaves", pa.int64()), ("saved", pa.int64()), ("bytes", pa.int64()), ("ended", pa.int64()), ("parent", pa.int64()),
    ("path", pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))),
])
_NODE_ROWS = (
    "k1 bigint, k2 bigint, depth bigint, least bigint, n bigint, children bigint, leaves bigint, saved bigint, bytes bigint, "
    "ended bigint, parent bigint, path array<struct<k1: bigint, k2: bigint>>"
)


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1) and the digests of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(text, F.lit(1), role).alias("h2"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "h1", "h2"))
    return slim.select("conv_id", place.alias("place"), "h1", "h2", "bytes")


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and seq, its turns' digests in order."""
    listed = F.sort_array(F.collect_list(F.struct("place", "h1", "h2", "bytes")))
    bare = F.transform(listed, lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["bytes"].alias("bytes")))
    return turns.groupBy("conv_id").agg(bare.alias("seq"))


def rebuilt(own: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Each conversation with its first turns taken from the one whose number is the last multiple of ``every``.

    How many is the crc32 of its number as text modulo ``most``; all if there are fewer, none if that one is absent.
    """
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    base = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, most - 1).alias("start"))
    keyed = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("taken", taken)
    joined = keyed.join(base, "base", "left")
    start = F.slice(F.coalesce("start", F.slice("seq", 1, 0)), F.lit(1), F.col("taken"))
    rest = F.slice("seq", F.col("taken") + 1, F.greatest(F.size("seq") - F.col("taken"), F.lit(0)))
    return joined.select("conv_id", F.concat(start, rest).alias("seq"))


def _classes(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (seq, least, n) and packs (least of the class, pack, ids)."""
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")))
    packs = convs.groupBy("seq", F.shiftright("conv_id", PACK).alias("pack")).agg(F.min("conv_id").alias("low"), F.count("*").alias("n"), ids.alias("ids"))
    packs = materialize(packs)
    classes = materialize(packs.groupBy("seq").agg(F.min("low").alias("least"), F.sum("n").alias("n"), F.count("*").alias("packs")))
    single = packs.join(classes.where("packs = 1").select("least"), packs["low"] == F.col("least"), "left_semi")
    ends = single.select(F.col("low").alias("ended"), F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    large = classes.where("packs > 1").select("seq", "least")
    parts = packs.join(large, "seq").select("least", "pack", "ids").repartition("least").sortWithinPartitions("least", "pack")
    return classes.drop("packs"), ends.unionByName(parts.mapInArrow(_hashed, "ended bigint, ends_sha256 string"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash over each class's packs in order."""
    now, state = None, None
    for batch in batches:
        out: list[tuple[int, str]] = []
        for least, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
            if least != now:
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state = least, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], ["ended", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["ended", "ends_sha256"])


def _paths(turns: np.ndarray) -> list[tuple[int, int]]:
    """Key of each prefix of a sequence, the empty one first."""
    state, out = hashlib.blake2b(digest_size=16), []
    for k in range(len(turns) + 1):
        if k:
            state.update(turns[k - 1].tobytes())
        out.append(tuple(np.frombuffer(state.copy().digest(), np.int64).tolist()))
    return out


def common_prefixes(seqs: list[np.ndarray]) -> np.ndarray:
    """How many turns each sequence has in common with the one before; -1 for the first."""
    lcp = np.full(len(seqs), -1, np.int64)
    for i in range(1, len(seqs)):
        k = min(len(seqs[i - 1]), len(seqs[i]))
        apart = np.flatnonzero((seqs[i - 1][:k] != seqs[i][:k]).any(axis=1))
        lcp[i] = apart[0] if len(apart) else k
    return lcp


def piece_forest(seqs: list[np.ndarray], least: np.ndarray, n: np.ndarray) -> pa.Table:
    """Nodes of sorted distinct sequences (arrays of turns by three numbers), closed and open ones.

    A closed node has no path; its k1 and k2 are its parent's key if that is open, else ``parent`` is the parent's least
    member. An open node has its own key and path, and what its closed children contribute.
    """
    size, lcp = np.array([len(s) for s in seqs], np.int64), common_prefixes(seqs)
    last = len(seqs) - 1
    keys = {0: _paths(seqs[0]), last: _paths(seqs[last])}
    # every node by its first row, from the deepest up
    row = np.repeat(np.arange(len(seqs)), size - lcp)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(size - lcp) - size - 1, size - lcp)
    order = np.lexsort((row, -depth))
    row, depth = row[order], depth[order]
    level = np.flatnonzero(np.diff(depth, prepend=depth[0] + 1))
    edges, at = np.argsort(-lcp, kind="stable").tolist(), 0
    up = list(range(len(seqs)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    count, low = n.copy(), least.copy()
    kids, leaves, saved = (np.zeros(len(seqs), np.int64) for _ in range(3))
    closed: list[list[np.ndarray]] = []
    opened: list[tuple] = []
    below: list[np.ndarray] | None = None  # closed nodes of the depth before, which wait for their parents

    for a, b in zip(level.tolist(), [*level[1:].tolist(), len(row)]):
        now, d = row[a:b], int(depth[a])
        while lcp[edges[at]] == d:  # neighbours that part here become one
            x, y = find(edges[at] - 1), find(edges[at])
            up[y] = x
            for total in (count, kids, leaves, saved):
                total[x] += total[y]
            low[x] = min(low[x], low[y])
            at += 1
        whose = {}  # open nodes: row of their component's root to the row whose path they are on
        if size[last] >= d:
            whose[find(last)] = last
        if size[0] >= d:
            whose[0] = 0
        is_open = np.isin(now, list(whose))
        if below is not None:
            parent = now[np.searchsorted(now, below[0], side="right") - 1]
            by_key = np.isin(parent, list(whose))
            key = np.array([keys[whose[x]][d] if k else (0, 0) for x, k in zip(parent.tolist(), by_key.tolist())], np.int64).reshape(-1, 2)
            closed.append([*below[1:], low[parent], by_key, key[:, 0], key[:, 1]])
        turn = np.array([seqs[i][d - 1][2] if d else 0 for i in now.tolist()], np.int64)
        own = np.where(size[now] == d, least[now], -1)
        for i, cost, end in zip(now[is_open].tolist(), turn[is_open].tolist(), size[now[is_open]] == d):
            path = keys[whose[i]][: d + 1]
            opened.append((*path[d], d, int(low[i]), int(count[i]), int(kids[i]), int(leaves[i]), int(saved[i]), cost, int(least[i]) if end else None, None, [{"k1": x, "k2": y} for x, y in path]))
            kids[i] = leaves[i] = saved[i] = 0  # told above; the rest is known when the pieces are merged
        shut = now[~is_open]
        leaves[shut] += kids[shut] == 0
        saved[shut] += (count[shut] - 1) * turn[~is_open]
        below = [shut, np.full(len(shut), d), low[shut], count[shut], kids[shut], leaves[shut], saved[shut], turn[~is_open], size[shut] == d, least[shut]]
        kids[shut] = 1
    inner = [np.concatenate(x) for x in zip(*closed)] if closed else [np.zeros(0, np.int64)] * 13
    d, lowest, members, children, leaf, save, cost, ends, own, parent, by_key, k1, k2 = inner
    by_key, ends = by_key.astype(bool), ends.astype(bool)
    columns = [k1, k2, d, lowest, members, children, leaf, save, cost, own, parent]
    absent = {0: ~by_key, 1: ~by_key, 9: ~ends, 10: by_key}
    shut_rows = pa.table([*[pa.array(c.astype(np.int64), mask=absent.get(i)) for i, c in enumerate(columns)], pa.nulls(len(k1), _NODE.field("path").type)], schema=_NODE)
    open_rows = pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*opened), _NODE)], schema=_NODE)
    return pa.concat_tables([shut_rows, open_rows])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted classes (seq, least, n) to the nodes of each batch's forest."""
    for batch in batches:
        if batch.num_rows:
            seq = batch.column(0)
            turns = np.stack([seq.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            ends = (seq.offsets.to_numpy() - seq.offsets[0].as_py()).tolist()
            seqs = [turns[a:b] for a, b in zip(ends[:-1], ends[1:])]
            yield from piece_forest(seqs, *(batch.column(c).to_numpy().copy() for c in (1, 2))).combine_chunks().to_batches()


def prefix_trie(convs: DataFrame) -> DataFrame:
    """Every node of the trie of sequences (conv_id, seq); see the module for its columns."""
    classes, ends = _classes(convs)
    first = classes.agg(F.min("least")).first()[0]  # the root's conv_id
    nodes = materialize(classes.select("seq", "least", "n").repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(_forests, _NODE_ROWS))
    merged = materialize(nodes.where("path is not null").groupBy("k1", "k2").agg(
        F.max("depth").alias("depth"), F.min("least").alias("least"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
        F.max("bytes").alias("bytes"), F.max("ended").alias("ended"), F.max("path").alias("path"),
    ).withColumn("up", F.try_element_at("path", F.lit(-2))))
    key = ["k1", "k2"]
    heads = merged.where("up is not null").groupBy(F.col("up.k1").alias("k1"), F.col("up.k2").alias("k2")).agg(F.count("*").alias("more"))
    whole = merged.join(heads, key, "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    whole = materialize(whole.withColumn("leaves", F.col("leaves") + (F.col("children") == 0).cast("bigint")).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("bytes")))
    along = whole.select(F.explode("path").alias("a"), "leaves", "saved").groupBy(F.col("a.k1").alias("k1"), F.col("a.k2").alias("k2")).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    over = merged.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("least").alias("over"))
    told = ["depth", "least", "n", "children", "leaves", "saved", "ended"]
    opened = whole.drop("leaves", "saved").join(along, key).join(over, (F.col("up.k1") == F.col("u1")) & (F.col("up.k2") == F.col("u2")), "left")
    opened = opened.select(*told, F.col("over").alias("parent"))
    root = F.when(F.col("depth") == 1, F.lit(first))  # many nodes hang from the root
    closed = nodes.where("path is null").withColumn("parent", F.coalesce(root, "parent"))
    inner = closed.where("parent is not null").select(*told, "parent")
    outer = closed.where("parent is null").drop("parent").join(over, (F.col("k1") == F.col("u1")) & (F.col("k2") == F.col("u2"))).select(*told, F.col("over").alias("parent"))
    every = opened.unionByName(inner).unionByName(outer)
    passed = every.where("ended is null").drop("ended").withColumn("ends_sha256", F.lit(NOTHING))
    final = passed.unionByName(every.where("ended is not null").join(ends, "ended").drop("ended"))
    return final.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The query: the trie of the rebuilt conversations."""
    own = materialize(sequences(turns_in_order(conversations)))
    return prefix_trie(materialize(rebuilt(own)))
