"""N-gram Jaccard join: shared rare shingles propose, signature trees prune, exact sets decide.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets form a class, which has
a number of its own. For a similarity of t or more two sets of n shingles share one of their first
``n - ceil(t n) + 1`` in any common order; the order is by hash, with shingles of crowded buckets last. So classes are
dealt to buckets by those first shingles and no pair outside a bucket is lost. The first pass notes about twice as
many shingles as that, which leaves room for crowded ones to go. A class in which too many are crowded (a member of a
large group of near copies, mostly) keeps its plain order; it meets all others in buckets of that order, in which only
pairs with such a class are looked at. Buckets are numbered by half a hash; what meets by accident is compared in vain.

Two rounds then tie each bucket's classes of similar size to a leader, the class whose shingles most others share:
a group of n near copies costs n comparisons there, not n squared. A bucket whose classes are all tied together is
done. The others become cells: buckets with the same leader are one, since the many buckets of a group of near copies
hold much the same classes. In each cell the classes' bitmaps (a bit or two for each shingle) are the leaves of a
signature tree, whose nodes hold the OR of their bitmaps, their range of sizes and components and the most shingles that
share a bit. Pairs of nodes are followed from the roots down, and a pair is dropped as soon as the sizes or the largest
possible overlap (bits in common, and shingles whose bit the other side lacks) rule out t, or all its leaves are of one
component. A first pass finds the classes that have any partner left; their exact sets are brought to the cell, where a
second pass compares them and unites components as it goes. A task passes on only the links that joined two
components, so its output is never more than its rows. Links become components by distributed star rounds.

Cells beyond ``BLOCK_ROWS`` rows are split into blocks, every two of which meet in a task of their own. Bitmaps are made in
the one pass over all texts. The texts of classes that share a bucket are kept in buckets by class number, and sets are made
from them only for classes that a pair or a cell names, so wide rows move once.

Defined results: a text without words, and a null one, has no shingles and links with nothing; fewer words than a
shingle make one shingle; rows with a null doc_id get their shingle count and no component, unless an equal set has an
id; rows that share a doc_id are one document, linked by it, in ``near_duplicates``, whatever their texts; ``one_of_each``
goes by the sets alone. Shingles are told apart by a 64-bit hash, equal sets by two.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptwatch.llm.decontaminate import SHARD_BYTES
from promptwatch.llm.shared import connected, discard, folder, fresh, lower_ascii, materialize, mix, shuffles_removed, text_chunks, word_hashes

#: A bucket of more classes than this is crowded; its shingle goes to the end of the order.
CROWDED = 24
#: Crowded shingles that are sent to the tasks at most (4 bytes each).
MOST_CROWDED = 1 << 20
#: Rows of a block at most, and shingles of a block of bitmaps and of one of sets; every two blocks of a cell meet in a task.
BLOCK_ROWS = 2048
BLOCK_BITS, BLOCK_SHINGLES = 1 << 24, 1 << 21
FANOUT = 8

_LOWER = lower_ascii()
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw])])
    start, _, w = word_hashes(_LOWER[np.frombuffer(b"\n".join(raw), np.uint8)], _WORD)
    first = np.searchsorted(start, offset)

    def folded(w: np.ndarray, size: int) -> np.ndarray:
        n = len(w) - size + 1
        h = np.full(max(n, 0), size, np.uint64)
        for j in range(size if n > 0 else 0):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n])
        return h

    every = folded(w, words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(every[a : b - words + 1]))
        else:
            out.append(folded(w[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def prefix_length(n: int, over: int, of: int) -> int:
    """How many first shingles any partner with similarity over / of shares one of."""
    return n - -(-n * over // of) + 1 if n else 0


def _noted(n: int, over: int, of: int) -> int:
    """How many first shingles are noted, so that some may be crowded."""
    return min(n, 2 * prefix_length(n, over, of) + 16)


def _sketches(docs: DataFrame, words: int, over: int, of: int) -> DataFrame:
    """doc_id, mark of the text, size, two digests, the first shingles (half their hashes) and the bitmap of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1), SHARD_BYTES):
                size, one, two, noted, bits = [], [], [], [], []
                for own in shingle_sets(texts, words):
                    size.append(len(own))
                    one.append(int(mix(own).sum(dtype=np.uint64).astype(np.int64)))
                    two.append(int(mix(own ^ salt).sum(dtype=np.uint64).astype(np.int64)))
                    noted.append((own[: _noted(len(own), over, of)] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    flags = np.zeros(width_of(len(own)), bool)
                    flags[(own & np.uint64(len(flags) - 1)).astype(np.int64)] = True
                    bits.append(np.packbits(flags).tobytes())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(size, pa.int32()), pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()), pa.array(noted, pa.list_(pa.int32())), pa.array(bits, pa.binary()),
                ], ["doc_id", "mark", "size", "one", "two", "noted", "bits"])

    schema = "doc_id bigint, mark bigint, size int, one bigint, two bigint, noted array<int>, bits binary"
    return docs.select("doc_id", "text", "mark").mapInArrow(run, schema)


def _dealt(classes: DataFrame, over: int, of: int) -> DataFrame:
    """A row for each class and bucket: route, token, node, size, place in the order, and whether it lacks room."""
    first = F.slice("noted", 1, F.col("size") - F.ceil(F.col("size") * F.lit(over) / F.lit(of)).cast("int") + 1)
    plain = classes.select("node", "size", F.posexplode(first).alias("place", "token"))
    counts = materialize(plain.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED))
    total = counts.agg(F.sum("n")).first()[0] or 0
    bound = max(CROWDED, total // MOST_CROWDED)
    crowded = np.sort(counts.where(F.col("n") > bound).select("token").toArrow().column(0).to_numpy())
    columns = [F.lit(0).alias("route"), "token", "node", "size", "place", F.lit(False).alias("lacks")]
    if not len(crowded):
        return plain.select(*columns)
    shared = classes.sparkSession.sparkContext.broadcast(crowded)

    def reorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in batches:
            size, noted = batch.column(1).to_numpy(), batch.column(2)
            flat, ends = noted.flatten().to_numpy(), noted.offsets.to_numpy() - noted.offsets[0].as_py()
            at = np.minimum(np.searchsorted(late, flat), len(late) - 1)
            busy = late[at] == flat
            first, lacks = [], []
            for n, a, b in zip(size.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                need, order = prefix_length(n, over, of), np.argsort(busy[a:b], kind="stable")
                lacks.append(bool(b - a < n and b - a - busy[a:b].sum() < need))
                first.append(flat[a:b][order[:need]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(first, pa.list_(pa.int32())), pa.array(lacks)], ["node", "size", "first", "lacks"]
            )

    moved = materialize(
        classes.select("node", "size", "noted").mapInArrow(reorder, "node bigint, size int, first array<int>, lacks boolean")
    )
    roomy = moved.where("not lacks").select("node", "size", F.posexplode("first").alias("place", "token")).select(*columns)
    short = moved.where("lacks").select("node", F.lit(True).alias("lack"))
    flagged = plain.join(short, "node", "left").withColumn("lacks", F.col("lack").isNotNull())
    met = flagged.where("lacks").select("token").distinct()
    beside = flagged.join(met, "token", "left_semi").select(F.lit(1).alias("route"), "token", "node", "size", "place", "lacks")
    return roomy if short.isEmpty() else roomy.unionByName(beside)


def _sets(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Node and whole set of the classes in ``nodes``, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own in text_chunks(batch.column(1), SHARD_BYTES):
                sets = [x.view(np.int64) for x in shingle_sets(own, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return materialize(texts.join(nodes, "node", "left_semi").mapInArrow(run, "node bigint, shingles array<bigint>"))


def _texts(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, str]:
    """A text of each wanted class (doc_id, mark, node), in buckets by node: joins by that move the other side alone.

    It comes with the name of its table, since buckets are known to the catalog only.
    """
    spark = docs.sparkSession
    name, path = f"texts_{uuid.uuid4().hex}", folder(spark, "texts")
    one_each = docs.join(wanted, ["doc_id", "mark"]).select("node", "text").dropDuplicates(["node"])
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_removed(spark):
        one_each.write.format("parquet").bucketBy(buckets, "node").option("path", path).saveAsTable(name)
    return spark.table(name), name


def width_of(size: int) -> int:
    """Bits of a bitmap: a power of two, one for each shingle at least.

    Half of such a bitmap stays empty, which is plenty against overlaps of nine tenths; what it lets through is
    compared exactly.
    """
    return max(64, 1 << (size - 1).bit_length())


class SignatureTree:
    """Leaves are bitmaps of equal width in order of size; each node has FANOUT children and their OR.

    ``comp`` are the components that the leaves are known to belong to; a node has the least and largest of its leaves.
    """

    def __init__(self, bits: np.ndarray, size: np.ndarray, comp: np.ndarray | None = None):
        self.order = np.lexsort((*bits[:, :4].T[::-1], size)) if len(size) else np.zeros(0, int)
        level = bits[self.order], size[self.order], size[self.order], (size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))[self.order]
        self.levels = [level]
        comp = (np.arange(len(size)) if comp is None else comp)[self.order]
        self.comps = [(comp, comp)]
        while len(level[1]) > 1:
            at = np.arange(0, len(level[1]), FANOUT)
            level = (
                np.bitwise_or.reduceat(level[0], at, axis=0), np.minimum.reduceat(level[1], at),
                np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at),
            )
            self.levels.append(level)
            least, most = self.comps[-1]
            self.comps.append((np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def fold(self) -> "SignatureTree":
        """The same tree with bitmaps of half the width."""
        new = object.__new__(SignatureTree)
        new.order, new.comps, new.levels = self.order, self.comps, []
        for bits, low, high, shared in self.levels:
            half = bits.shape[1] // 2
            lost = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            bits = bits[:, :half] | bits[:, half:]
            new.levels.append((bits, low, high, shared + lost - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)))
        # a parent's count of shingles that share a bit must cover its children's
        for k in range(1, len(new.levels)):
            below = new.levels[k - 1][3]
            bits, low, high, _ = new.levels[k]
            new.levels[k] = (bits, low, high, np.maximum.reduceat(below, np.arange(0, len(below), FANOUT)))
        return new


def dual_pairs(a: SignatureTree, b: SignatureTree, over: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs (original row numbers) of different components that may reach over / of; of a tree with itself each pair once."""
    out = list(_dual_batches(a, b, over, of))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _dual_batches(a: SignatureTree, b: SignatureTree, over: int, of: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of :func:`dual_pairs`, some at a time."""
    same = a is b  # else two trees over different rows
    if not len(a.order) or not len(b.order):
        return
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        step = max(1, (1 << 19) // a.levels[la][0].shape[1])
        if len(i) > step:
            stack.append((la, lb, i[step:], j[step:]))
            i, j = i[:step], j[:step]
        x, low, high, share = a.levels[la]
        y, low2, high2, share2 = b.levels[lb]
        ok = (high[i] * of >= over * low2[j]) & (high2[j] * of >= over * low[i])
        (c, d), (c2, d2) = a.comps[la], b.comps[lb]
        ok &= (c[i] != d[i]) | (c2[j] != d2[j]) | (c[i] != c2[j])  # something is left to unite
        if same and la == lb == 0:
            ok &= i < j
        i, j = i[ok], j[ok]
        common = np.bitwise_count(x[i] & y[j]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(high[i], high2[j]), common + np.minimum(share[i], share2[j]))
        if la == 0:  # a leaf's own shingles whose bit the other side lacks
            most = np.minimum(most, high[i] - np.bitwise_count(x[i]).sum(axis=1, dtype=np.int64) + common)
        if lb == 0:
            most = np.minimum(most, high2[j] - np.bitwise_count(y[j]).sum(axis=1, dtype=np.int64) + common)
        ok = (over + of) * most >= over * (low[i] + low2[j])  # overlap >= t / (1 + t) of both sizes together
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            yield a.order[i], b.order[j]
            continue
        down_a, down_b = 0 < la >= lb, 0 < lb >= la
        if down_a:
            i = _children(i, len(a.levels[la - 1][1]))
        if down_b:
            j = _children(j, len(b.levels[lb - 1][1]))
        i, j, la, lb = i.reshape(len(i), -1), j.reshape(len(j), -1), la - down_a, lb - down_b
        i, j = np.repeat(i, j.shape[1], axis=1).ravel(), np.tile(j, (1, i.shape[1])).ravel()
        ok = (i >= 0) & (j >= 0)
        if same:
            ok &= i <= j
        stack.append((la, lb, i[ok], j[ok]))


def _children(nodes: np.ndarray, below: int) -> np.ndarray:
    """Children of each node as a row, -1 where there is none."""
    kids = nodes[:, None] * FANOUT + np.arange(FANOUT)
    return np.where(kids < below, kids, -1)


#: What tells the groups of a task apart, in the order in which its rows are sorted.
_GROUP = ("route", "band", "leader", "bi", "bj")


def _candidates(group: pa.Table, over: int, of: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group (two blocks of a cell, or one) that bitmaps, sizes and places allow."""
    size, place, block = (group.column(c).to_numpy().astype(np.int64) for c in ("size", "place", "block"))
    mixed = group.column("bi")[0].as_py() != group.column("bj")[0].as_py()
    route, lacks = group.column("route")[0].as_py(), group.column("lacks").to_numpy(zero_copy_only=False)
    comp = np.unique(group.column("comp").to_numpy(), return_inverse=True)[1]
    bits = group.column("bits").to_pylist()
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    trees: dict[tuple[int, bool], tuple[np.ndarray, SignatureTree]] = {}
    for w, short in sorted(set(zip(width.tolist(), lacks.tolist()))):
        at = np.flatnonzero((width == w) & (lacks == short))
        packed = np.frombuffer(b"".join(bits[i] for i in at), np.uint8).reshape(len(at), w)
        trees[w, short] = at, SignatureTree(packed.view(np.uint64), size[at], comp[at])
    for (w, short), (a, tree) in trees.items():
        for (w2, short2), (b, other) in trees.items():
            # in plain order only pairs with a class that lacks room; of equal widths each two trees once
            if w2 not in (w, 2 * w) or (route and not (short or short2)) or (w == w2 and short2 < short):
                continue
            for i, j in _dual_batches(tree, other if w == w2 else other.fold(), over, of):
                i, j = a[i], b[j]
                ahead = np.minimum(size[i] - place[i], size[j] - place[j])  # no common shingle comes before these places
                ok = (over + of) * ahead >= over * (size[i] + size[j])
                if mixed:
                    ok &= block[i] != block[j]
                if ok.any():
                    yield i[ok], j[ok]


def _hopeful(over: int, of: int):
    """Task function: of each group's rows those that may be similar to another of a different component."""

    def own(group: pa.Table) -> pa.RecordBatch:
        found = np.zeros(group.num_rows, bool)
        for i, j in _candidates(group, over, of):
            found[i] = found[j] = True
        return group.filter(pa.array(found)).select(["route", "band", "leader", "node"])

    return lambda batches: (x for t in _groups(batches) for x in own(t).to_batches())


def _joining(over: int, of: int):
    """Task function: links between a group's rows by their exact sets, as many as join two components."""

    def links(group: pa.Table) -> tuple[list[int], list[int]]:
        node, size = group.column("node").to_numpy(), group.column("size").to_numpy().astype(np.int64)
        comp = np.unique(group.column("comp").to_numpy(), return_inverse=True)[1]
        shingles = group.column("shingles").chunk(0)
        ends = shingles.offsets.to_numpy() - shingles.offsets[0].as_py()
        values, word = np.unique(shingles.flatten().to_numpy(), return_inverse=True)
        sets = [word[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        marked, left, right = np.zeros(len(values), bool), [], []
        for i, j in _candidates(group, over, of):
            apart = comp[i] != comp[j]
            i, j = i[apart], j[apart]
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            cut = [0, *(np.flatnonzero(i[1:] != i[:-1]) + 1).tolist(), len(i)]
            for x, y in zip(cut[:-1], cut[1:]):
                if x == y:
                    continue
                one, others = int(i[x]), j[x:y]
                marked[sets[one]] = True
                while len(others := others[comp[others] != comp[one]]):
                    now = others[: max(1, (1 << 20) // int(size[others].max()))]
                    others = others[len(now) :]
                    both = np.add.reduceat(marked[np.concatenate([sets[k] for k in now.tolist()])], np.cumsum(size[now]) - size[now], dtype=np.int64)
                    for k in now[of * both >= over * (size[one] + size[now] - both)].tolist():
                        if comp[k] != comp[one]:
                            comp[comp == comp[k]] = comp[one]
                            left.append(int(node[one]))
                            right.append(int(node[k]))
                marked[sets[one]] = False
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            left, right = links(group)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows cut into groups of equal ``_GROUP``; one group is held, and the batch it ends in."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in _GROUP]
        cut = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(c)[-1].as_py() != k[0] for c, k in zip(_GROUP, keys)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for a, b in zip(cut[:-1], cut[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def similar(over: int, of: int) -> Column:
    """Whether joined rows' sets x and y reach the similarity over / of."""
    both = F.size(F.array_intersect("x", "y")).cast("bigint")
    return F.lit(of) * both >= F.lit(over) * (F.size("x") + F.size("y") - both)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, over: int, of: int) -> DataFrame:
    """Pairs (a, b) whose exact sets are similar, as a table; only sets that a pair names are made."""
    pairs = materialize(pairs.distinct())
    own = _sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), words)
    x = own.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = own.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    found = materialize(pairs.join(y, "b").join(x, "a").where(similar(over, of)).select("a", "b"))
    discard(own)
    return found


def _same_ids(sketches: DataFrame, names: DataFrame) -> DataFrame:
    """Links (a, b) of classes that share a doc_id."""
    digests = F.struct("one", "two")
    rows = sketches.where("size > 0 and doc_id is not null")
    several = rows.groupBy("doc_id").agg(F.min(digests).alias("low"), F.max(digests).alias("high")).where("low <> high").select("doc_id", "low.*")
    several = materialize(several.toDF("doc_id", "one_a", "two_a"))
    pairs = rows.join(several, "doc_id").where("one <> one_a or two <> two_a").select("one", "two", "one_a", "two_a").distinct()
    pairs = pairs.join(names.select("one", "two", F.col("node").alias("b")), ["one", "two"])
    of = names.select(F.col("one").alias("one_a"), F.col("two").alias("two_a"), F.col("node").alias("a"))
    return materialize(pairs.join(of, ["one_a", "two_a"]).select("a", "b"))


def _components(docs: DataFrame, words: int, over: int, of: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, size, one, two), and classes (one, two, component) with the smallest (least doc_id, mark) of those linked.

    Classes that share a doc_id are linked if ``by_id``.
    """
    wide = materialize(_sketches(docs, words, over, of))
    classes = wide.where("size > 0 and doc_id is not null").groupBy("one", "two").agg(
        F.min(F.struct("doc_id", "mark")).alias("first"), F.max("size").alias("size"), F.min("noted").alias("noted"), F.min("bits").alias("bits"),
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    sketches = materialize(wide.drop("noted", "bits", "mark"))
    names = materialize(classes.select("one", "two", "node", F.struct(F.col("first.doc_id").alias("least"), F.col("first.mark").alias("mark")).alias("first")))
    discard(wide)
    base = math.log(of / over) * (1 + 1e-9)  # sizes that can be similar are never two bands apart
    rows = _meeting(_dealt(classes.drop("bits"), over, of), base)
    bitmaps = materialize(classes.select("node", "bits").join(rows.select("node").distinct(), "node", "left_semi"))
    discard(classes)
    wanted = names.join(rows.select("node").distinct(), "node", "left_semi").select(F.col("first.least").alias("doc_id"), "first.mark", "node")
    texts, texts_name = _texts(docs, wanted)

    links = _same_ids(sketches, names) if by_id else None
    open_rows = rows.withColumn("comp", F.col("node"))
    for shift in (0.0, 0.5):
        band = F.floor(F.log(F.col("size").cast("double")) / base + shift)
        banded = open_rows.withColumn("band", band)
        leaders = banded.groupBy("route", "token", "band").agg(
            F.max_by(F.struct("node", "comp"), F.struct("weight", -F.col("node"))).alias("leader"), F.min("comp").alias("low"), F.max("comp").alias("high")
        ).where("low <> high").select("route", "token", "band", "leader.*").toDF("route", "token", "band", "a", "lead_comp")
        pairs = banded.join(leaders, ["route", "token", "band"]).where("comp <> lead_comp").groupBy("a", F.col("node").alias("b")).agg(
            F.count("*").alias("shared"), F.max("size").alias("size")
        ).where(F.col("shared") * 3 * of >= F.col("size") * (of - over))
        found = _verified(pairs.select("a", "b"), texts, words, over, of)
        links = found if links is None else links.unionByName(found)
        roots = connected(links)
        open_rows = _open(rows, roots)
        if open_rows.isEmpty():
            break
    if not open_rows.isEmpty():
        cells = _cells(open_rows, base)
        first = _blocks(cells, bitmaps, BLOCK_ROWS, BLOCK_BITS).mapInArrow(_hopeful(over, of), "route int, band bigint, leader bigint, node bigint")
        hopeful = materialize(cells.join(first.distinct(), ["route", "band", "leader", "node"], "left_semi"))
        own = _sets(texts, hopeful.select("node").distinct(), words).join(bitmaps, "node")
        found = _blocks(hopeful, own, BLOCK_ROWS, BLOCK_SHINGLES).mapInArrow(_joining(over, of), "a bigint, b bigint")
        roots = connected(links.unionByName(materialize(found)))
    discard(texts)
    docs.sparkSession.sql(f"DROP TABLE {texts_name}")
    tied = names.join(roots, "node").groupBy("root").agg(F.min("first").alias("smallest"))
    labels = names.join(roots, "node", "left").join(tied, "root", "left").select("one", "two", F.coalesce("smallest", "first").alias("component"))
    return sketches, labels


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and a hash of it, which tells apart texts that share a doc_id."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))


def near_duplicates(docs: DataFrame, words: int = 5, over: int = 80, of: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest linked doc_id) for every row."""
    sketches, labels = _components(_marked(docs, doc_id, text), words, over, of, by_id=True)
    labels = labels.select("one", "two", F.col("component.least").alias("component"))
    labelled = sketches.select("doc_id", "size", "one", "two").join(labels, ["one", "two"], "left")
    return labelled.select(
        "doc_id", F.col("size").cast("bigint").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _meeting(dealt: DataFrame, base: float) -> DataFrame:
    """Rows of buckets in which classes of similar size meet, with the average crowd of each class's buckets as weight."""
    key = ["route", "token"]
    several = materialize(dealt.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))
    own = F.floor(F.log(F.col("size").cast("double")) / base).cast("int")
    met = materialize(dealt.join(several, key).withColumn("own", own))
    banded = met.select(*key, "own", "lacks", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("band"))
    whole = banded.groupBy(*key, "band").agg(F.count("*").alias("rows"), F.min("own").alias("least"), F.max(F.col("lacks").cast("int")).alias("short"))
    whole = whole.where("rows > 1 and least = band and (route = 0 or short = 1)")
    bands = materialize(whole.groupBy(*key).agg(F.collect_set("band").alias("bands")))  # as many as sizes have bands
    near = met.join(bands, key).where(F.array_contains("bands", F.col("own")) | F.array_contains("bands", F.col("own") - 1))
    weight = F.avg("n").over(W.partitionBy("node"))
    rows = materialize(near.drop("own", "bands").withColumn("weight", weight))
    discard(met)
    return rows


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of buckets whose classes are not all of one component yet."""
    with_comp = rows.join(roots, rows["node"] == roots["node"], "left").select(rows["*"], F.coalesce(roots["root"], rows["node"]).alias("comp"))
    with_comp = materialize(with_comp)
    several = with_comp.groupBy("route", "token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    still = materialize(with_comp.join(several.select("route", "token"), ["route", "token"], "left_semi"))
    discard(with_comp)
    return still


def _cells(rows: DataFrame, base: float) -> DataFrame:
    """A row for each class and cell: the buckets (of a route and a band) that have the same leader are one cell.

    Near copies share most of their rare shingles, so their many buckets become a few cells, and a pair is looked at
    once for a cell. A band meets itself and the next one.
    """
    band = F.floor(F.log(F.col("size").cast("double")) / base)
    banded = rows.select("route", "token", "node", "comp", "size", "place", "lacks", "weight", band.alias("own")).withColumn(
        "band", F.explode(F.array(F.col("own"), F.col("own") - 1))
    )
    key = ["route", "token", "band"]
    leaders = banded.groupBy(*key).agg(
        F.max_by("node", F.struct("weight", -F.col("node"))).alias("leader"), F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.min("own").alias("least"), F.max(F.col("lacks").cast("int")).alias("short"),
    ).where("low <> high and least = band and (route = 0 or short = 1)")
    member = banded.join(leaders.select(*key, "leader"), key).groupBy("route", "band", "leader", "node")
    return materialize(member.agg(F.min("comp").alias("comp"), F.max("size").alias("size"), F.min("place").alias("place"), F.max("lacks").alias("lacks")))


def _blocks(cells: DataFrame, sets: DataFrame, most_rows: int, most_shingles: int) -> DataFrame:
    """Rows of cells with columns of ``sets``, dealt to (cell, two blocks) and sorted so."""
    key = ["route", "band", "leader"]
    groups = cells.groupBy(*key).agg(F.count("*").alias("rows"), F.sum(F.col("size").cast("bigint")).alias("shingles"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    cut = F.greatest(F.ceil(F.col("rows") / most_rows), F.ceil(F.col("shingles") / most_shingles)).cast("int")
    placed = cells.join(groups.where("low <> high").select(*key, cut.alias("blocks")), key)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    return placed.join(sets, "node").drop("blocks", "other").repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def linked_documents(docs: DataFrame) -> DataFrame:
    """The join of the query: three-word shingles, 90 per cent."""
    return near_duplicates(docs, words=3, over=90, of=100)


def one_of_each(docs: DataFrame, words: int = 5, over: int = 80, of: int = 100) -> DataFrame:
    """The document with the smallest doc_id of every group of near duplicates; rows without a doc_id all stay.

    Different texts that share a doc_id both stay, unless their sets are equal or linked.
    """
    plain = F.col("doc_id").isNull() | F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    _, labels = _components(_marked(docs, "doc_id", "text"), words, over, of, by_id=False)
    mark = fresh(docs, "__mark")
    kept = labels.select(F.col("component.least").alias("doc_id"), F.col("component.mark").alias(mark)).distinct()
    worded = docs.where(~plain).withColumn(mark, F.xxhash64("text")).join(kept, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return docs.where(plain).unionByName(worded.select(docs.columns))
