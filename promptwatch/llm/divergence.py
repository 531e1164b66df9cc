"""Source divergence audit: which sources of a language differ, and by which terms; strings are joined back late.

Every (lang, source) group has a smoothed distribution over the terms that its language keeps, those in at least
``least_docs`` of its documents. Two groups differ by the sum over terms of (p - q)^2 / (p + q), and a group differs from
its language most by the terms with the largest such part; p and q are whole numbers in billionths, so all is exact.

Late string materialization: one pass over the texts writes, for each piece of a task's documents, a row for each group
and term digest with its count and its document count, and a row for each digest with the least and greatest string
behind it. The counts that are shuffled are those of 64-bit digests alone; the strings stay in the written table. They
are read again for digests that reach ``least_docs`` at all (whatever else shares a digest cannot be kept either), and where the least and
the greatest string differ, two terms share a digest: then a second pass counts the texts' terms of those digests by their
strings, and they replace the digest's counts. Terms get their text back last, only those that are put out or tie for it.

Pairs: terms are dealt to blocks of ``BLOCK_TERMS`` of a language, sources to blocks of ``BLOCK_GROUPS``; a task holds the
matrix of one term block and two source blocks and adds up the pairs' parts, so a term's sources are never listed
in pairs, and the partial sums are added by an ordinary aggregate. A term that a group lacks counts with the group's
smoothed share of zero.

Defined results: null text, lang and source count as ''; documents without a term count as documents only; a group
without terms has the smoothed share everywhere; a language with no kept term has pairs of value 0 and no terms; a
language with one source has no pairs; repeated rows count as often as they occur; an empty table gives no row. Only
the columns text, lang and source are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptwatch.llm.shared import lower_ascii, materialize, text_chunks, word_hashes

LEAST_DOCS = 10
TOP = 10
#: The unit of a share.
UNIT = 1_000_000_000
#: Terms of a block, and groups of a block, at most: a task's matrices hold their product.
BLOCK_TERMS, BLOCK_GROUPS = 1024, 128
#: Bytes of text that are counted together, and rows that a task holds before it writes them.
PIECE_BYTES, HELD_ROWS = 4 << 20, 3 << 18
#: Rows that leave a task at once.
BATCH_ROWS = 1 << 16

_LOWER = lower_ascii()
_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_COUNTED = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("digest", pa.int64()), ("n", pa.int64()), ("docs", pa.int64()),
    ("low", pa.binary()), ("high", pa.binary()),
])


class _Words:
    """The words of a chunk of texts: document, digest, and where they stand in ``data``."""

    def __init__(self, texts: list[str], bits: int):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = _LOWER[np.frombuffer(b"\n".join(raw), np.uint8)]
        start, end, value = word_hashes(self.data, _WORD)
        self.start, self.size, self.digest = start, end - start, (value >> np.uint64(64 - bits)).view(np.int64)
        self.doc = np.searchsorted(np.cumsum([len(t) + 1 for t in raw]), start, side="right")

    def sort(self, order: np.ndarray) -> None:
        self.start, self.size, self.digest, self.doc = (x[order] for x in (self.start, self.size, self.digest, self.doc))

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at these places."""
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        inside = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
        data = self.data[np.repeat(self.start[at], size) + inside]
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])

    def ends(self, cut: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Least and greatest string of each run of words from ``cut``; runs of one string are told without a loop."""
        run = np.diff(cut, append=len(self.start))
        first = np.repeat(cut, run)
        odd = self.size != self.size[first]
        # bytes are compared in steps of equal size, the words of each length together
        for size in np.unique(self.size).tolist():
            at = np.flatnonzero((self.size == size) & ~odd & (first != np.arange(len(first))))
            step = max(1, (1 << 22) // size)
            for a in range(0, len(at), step):
                k = at[a : a + step]
                inside = np.arange(size)
                same = self.data[self.start[k][:, None] + inside] == self.data[self.start[first[k]][:, None] + inside]
                odd[k[~same.all(axis=1)]] = True
        low = self.strings(cut)
        if not odd.any():
            return low, low
        low = low.to_pylist()
        high = list(low)
        for r in np.unique(np.searchsorted(cut, np.flatnonzero(odd), side="right") - 1).tolist():
            own = self.strings(np.arange(cut[r], cut[r] + run[r])).to_pylist()
            low[r], high[r] = min(own), max(own)
        return pa.array(low, pa.binary()), pa.array(high, pa.binary())


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _summed(parts: list[pa.Table]) -> pa.Table:
    """Counts of the same group and digest as one."""
    out = pa.concat_tables(parts).group_by(["group", "digest"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select(["group", "digest", "n_sum", "docs_sum"]).rename_columns(["group", "digest", "n", "docs"])


def _spanned(parts: list[pa.Table]) -> pa.Table:
    """Least and greatest string of each digest."""
    out = pa.concat_tables(parts).group_by("digest", use_threads=False).aggregate([("low", "min"), ("high", "max")])
    return out.select(["digest", "low_min", "high_max"]).rename_columns(["digest", "low", "high"])


def _rows(table: pa.Table, groups: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Batches with all columns, groups by their names; counts have no strings, and strings no count."""
    names = {c: pa.array([g[i] for g in groups], pa.string()) for i, c in enumerate(("lang", "source"))}
    for at in range(0, table.num_rows, BATCH_ROWS):
        part = table.slice(at, BATCH_ROWS).combine_chunks()
        own = {c: names[c].take(part.column("group").combine_chunks()) for c in names} if "group" in part.column_names else {}
        own |= {c: part.column(c).cast(_COUNTED.field(c).type) for c in part.column_names if c != "group"}
        columns = [own[f.name] if f.name in own else pa.nulls(part.num_rows, f.type) for f in _COUNTED]
        yield from pa.table(columns, schema=_COUNTED).combine_chunks().to_batches()


def _counted(bits: int, exact: bool):
    """Task function: rows of documents to counts by group and digest, and the digests' strings; if ``exact``, counts by string."""

    def piece(words: _Words, lang: list[str], source: list[str], number: dict[tuple[str, str], int]) -> tuple[pa.Table, pa.Table]:
        group = np.array([number.setdefault(g, len(number)) for g in zip(lang, source)], np.int32)[words.doc]
        string = np.zeros(len(words.start), np.int64)
        if exact and len(string):
            string = np.unique(np.array(words.strings(np.arange(len(string))).to_pylist(), object), return_inverse=True)[1]
        # by digest (and string) for the strings, then by group within
        order = np.lexsort((words.doc, group, string, words.digest))
        words.sort(order)
        group, string = group[order], string[order]
        terms = _edges(words.digest, string)
        low, high = words.ends(terms)
        rows = _edges(words.digest, string, group)
        new_doc = np.zeros(len(group), np.int64)
        new_doc[_edges(words.digest, string, group, words.doc)] = 1
        n = np.diff(rows, append=len(group))
        counts = pa.table({"group": group[rows], "digest": words.digest[rows], "n": n, "docs": np.add.reduceat(new_doc, rows) if len(rows) else n})
        if exact:
            counts = counts.append_column("low", low.take(pa.array(np.searchsorted(terms, rows, side="right") - 1)))
        return counts, pa.table({"digest": words.digest[terms], "low": low, "high": high})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[pa.Table]] = {_summed: [], _spanned: []}
        groups: dict[tuple[str, str], int] = {}  # in the order of their numbers
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(0), PIECE_BYTES):
                lang, source = (batch.column(c).slice(a, b - a).to_pylist() for c in (1, 2))
                counts, strings = piece(_Words(texts, bits), lang, source, groups)
                if exact:
                    yield from _rows(counts, list(groups))
                    continue
                for (merge, parts), table in zip(held.items(), (counts, strings)):
                    parts.append(table)
                    if sum(t.num_rows for t in parts) > HELD_ROWS:
                        parts[:] = [merge(parts)]
                        if parts[0].num_rows > HELD_ROWS // 2:
                            yield from _rows(parts.pop(), list(groups))
        for merge, parts in held.items():
            if parts:
                yield from _rows(merge(parts), list(groups))

    return run


_ROWS = "lang string, source string, digest bigint, n bigint, docs bigint, low binary, high binary"


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), exactly."""
    wide = F.lit(UNIT).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + 2)
    return F.call_function("div", wide, total.cast("decimal(20,0)") + 2 * kept.cast("decimal(20,0)")) + 1


def _part(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, counts of kept terms by group, and the terms' texts.

    Groups: gid, lang, source. Counts: gid, lang, term, n. Texts: term, text. A term is the pair (digest, exact), where
    ``exact`` is empty but for strings that share a digest.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups = materialize(plain.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()))
    counted = materialize(plain.mapInArrow(_counted(bits, False), _ROWS))

    def often(rows: DataFrame, *key: str) -> DataFrame:
        """Counts by group of terms that are in enough documents of their language, all from one exchange by term."""
        slim = rows.join(groups, ["lang", "source"]).select("gid", "lang", *key, "n", "docs").repartition("lang", *key)
        summed = slim.groupBy("gid", "lang", *key).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        held = W.partitionBy("lang", *key)  # a row for each source of the language
        return summed.withColumn("all_docs", F.sum("docs").over(held)).where(F.col("all_docs") >= least_docs).drop("all_docs", "docs")

    counts = materialize(often(counted.where("n is not null"), "digest"))
    wanted = counts.select("digest").distinct()
    strings = materialize(
        counted.where("n is null").select("digest", "low", "high").join(wanted, "digest", "left_semi")
        .groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )
    shared = materialize(strings.where("low <> high").select("digest"))
    none = F.lit(b"").alias("exact")
    if shared.isEmpty():
        texts = strings.select("digest", none, F.col("low").cast("string").alias("text"))
        return groups, counts.select("gid", "lang", "digest", none, "n"), texts
    by_string = plain.mapInArrow(_counted(bits, True), _ROWS).join(shared, "digest", "left_semi").withColumn("exact", F.col("low"))
    split = materialize(often(by_string, "digest", "exact"))
    alone = counts.join(shared, "digest", "left_anti").select("gid", "lang", "digest", none, "n")
    texts = strings.where("low = high").select("digest", none, F.col("low").cast("string").alias("text"))
    apart = split.select("digest", "exact", F.col("exact").cast("string").alias("text")).distinct()
    return groups, materialize(alone.unionByName(split.select("gid", "lang", "digest", "exact", "n"))), texts.unionByName(apart)


def _pair_sums(rows: DataFrame) -> DataFrame:
    """(one, two, value): sums over the terms of each block.

    Rows are (lang, block, i, j, gid, side, digest, exact, p, terms): one for each count, and one without a digest for each
    group, with its share of zero and the number of terms of the block.
    """

    def block(key: tuple, group: pa.Table) -> pa.Table:
        gid, p = group.column("gid").to_numpy(), group.column("p").to_numpy()
        header = group.column("digest").is_null().to_numpy(zero_copy_only=False)
        names = gid[header]
        order = np.argsort(names)
        names, zero, side = names[order], p[header][order], group.column("side").to_numpy()[header][order]
        most = int(group.column("terms").to_numpy()[header].max())
        terms = group.filter(pa.array(~header))
        digest, exact = terms.column("digest").to_numpy(), np.array(terms.column("exact").to_pylist(), object)
        term = np.unique(digest, return_inverse=True)[1]
        if any(exact):
            seen: dict[tuple, int] = {}
            term = np.array([seen.setdefault(x, len(seen)) for x in zip(digest.tolist(), exact.tolist())], np.int64)
        matrix = np.repeat(zero[:, None], int(term.max()) + 1 if len(term) else 0, axis=1)
        matrix[np.searchsorted(names, gid[~header]), term] = p[~header]
        one, two, value = [], [], []
        same = key[2].as_py() == key[3].as_py()
        for a in np.flatnonzero(side == 0).tolist():
            others = np.arange(a + 1, len(names)) if same else np.flatnonzero(side == 1)
            step = max(1, (1 << 20) // max(1, matrix.shape[1]))
            for x in range(0, len(others), step):
                b = others[x : x + step]
                gap = matrix[a] - matrix[b]
                bare = zero[a] - zero[b]  # terms that only groups of other blocks have
                bare = (most - matrix.shape[1]) * (bare * bare // (zero[a] + zero[b]))
                value += ((gap * gap // (matrix[a] + matrix[b])).sum(axis=1) + bare).tolist()
                one += [int(names[a])] * len(b)
                two += names[b].tolist()
        return pa.table([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(value, pa.int64())], names=["one", "two", "value"])

    parts = rows.groupBy("lang", "block", "i", "j").applyInArrow(block, "one bigint, two bigint, value bigint")
    return parts.groupBy("one", "two").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """lang, source, part, item, value and rank: every group's distance from its language's others, and its own terms."""
    groups, counts, texts = kept_counts(docs, least_docs, bits)
    term = ["digest", "exact"]
    by_lang = counts.groupBy("lang", *term).agg(F.sum("n").alias("lang_n"))
    sizes = materialize(by_lang.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")))
    totals = counts.groupBy("gid").agg(F.sum("n").alias("total"))
    known = groups.join(totals, "gid", "left").join(sizes, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1  # as many rows as the language has sources
    known = materialize(known.withColumn("own", F.floor(number / BLOCK_GROUPS).cast("int")))
    zero = F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.greatest("kept", F.lit(1)))).otherwise(F.lit(0))

    # pairs
    p = _share(F.col("n"), F.col("total"), F.col("kept"))
    placed = counts.join(known.drop("lang", "source"), "gid").withColumn("p", p)
    blocks = F.ceil(F.col("kept") / BLOCK_TERMS).cast("int")
    most = F.max("own").over(W.partitionBy("lang"))
    meets = materialize(known.withColumn("last", most).select("gid", "lang", "own", "last", "kept", zero.alias("p")))
    placed = placed.join(meets.select("gid", "last"), "gid")
    other = F.explode(F.sequence(F.lit(0), F.col("last")))

    def dealt(df: DataFrame) -> DataFrame:
        met = df.withColumn("other", other)
        return met.select(
            "lang", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "gid",
            (F.col("own") > F.col("other")).cast("int").alias("side"), *term, "p", "terms",
        )

    heads = meets.where("kept > 0").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    block_of = F.pmod(F.xxhash64(*term), blocks).cast("int").alias("block")
    held = by_lang.join(sizes.select("lang", "kept"), "lang").groupBy("lang", block_of).agg(F.count("*").alias("terms"))
    heads = heads.join(held, ["lang", "block"]).withColumns({"digest": F.lit(None).cast("bigint"), "exact": F.lit(b"")})
    cells = placed.select("*", block_of, F.lit(0).cast("bigint").alias("terms"))
    sums = materialize(_pair_sums(dealt(heads).unionByName(dealt(cells))))
    both = sums.unionByName(sums.select(F.col("two").alias("one"), F.col("one").alias("two"), "value"))
    x = known.select(F.col("gid").alias("one"), "lang", "source")
    y = known.select(F.col("gid").alias("two"), F.col("lang"), F.col("source").alias("item"))
    pairs = x.join(y, "lang").where("one <> two").join(both, ["one", "two"], "left")  # the result's own rows
    pairs = pairs.select(F.col("one").alias("gid"), F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))

    # terms
    told = placed.join(by_lang, ["lang", *term]).withColumn("q", _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).where("n > 0 and p > q")
    told = told.select("gid", *term, _part(F.col("p"), F.col("q")).alias("value"))
    ties = told.withColumn("at", F.rank().over(W.partitionBy("gid").orderBy(F.desc("value")))).where(F.col("at") <= top)
    terms = ties.drop("at").join(texts, term).select("gid", F.lit("term").alias("part"), F.col("text").alias("item"), "value")

    rows = pairs.unionByName(terms)
    rank = F.row_number().over(W.partitionBy("gid", "part").orderBy(F.desc("value"), "item"))
    ranked = rows.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.join(groups, "gid").select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank"))


def audit(docs: DataFrame) -> DataFrame:
    """The query's audit: terms in ten documents or more, ten terms for each source."""
    return source_divergence(docs)
