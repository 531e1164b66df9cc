"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Every source is a queue of its documents in a shuffled order, up to ``epochs`` times over. A copy of a document starts
when the source's words before it have been served and finishes after its own; divided by the source's weight these are
its virtual start and finish. All copies are sorted by virtual finish time over the whole cluster (range partitions,
sorted within, with the words of the partitions before as offsets) and the sequence is truncated at the budget, which is
the number of words of all documents times ``share``.

A queue that runs dry after ``epochs`` rounds leaves its part to the others by weight. So the targets are known ahead:
with sources in order of ``epochs * size / weight``, those that the even share of what remains would exceed are capped,
the others share the rest. When the budget ends, every source that is still served has one document in service; it is
cut where its source's target ends, so a source's taken words are its target up to one word, however long a document is.

Shuffled means: in order of the first 60 bits of md5(seed:doc_id:text), then doc_id. The result depends on the rows alone,
not on their order or partitions. Weights are whole numbers, dealt to the sources in code point order, null last,
repeating; virtual times are compared as whole numbers (times the weights' least common multiple).

Only row keys, sources and counts are shuffled, never texts. A source of any size is spread over all partitions. Tables
of sources and of partitions are aggregates; the one window without a key runs over a row for each partition.

Defined results: a text that is null or has no word has size 0 and takes 0; equal rows are documents of their own;
null doc_ids are rows like others; rows with the same doc_id and text are told apart by row only, so which of them is
repeated is open, not how many are; an empty table gives no row; when all sizes are 0, so are all targets. Further
columns are passed on by :func:`mixture`, whatever their names, but for the three that it adds, which replace such columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptwatch.llm.shared import fresh, materialize

WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"

_WIDE = "decimal(38,0)"


def running(df: DataFrame, order: list[Column], totals: dict[str, str]) -> DataFrame:
    """``df`` with, for each (new column, summed column) of ``totals``, the sum over all rows before it in ``order``.

    Rows are dealt to ranges of ``order`` and written with the number of their range; sums of the ranges before and sums
    within a range add up. Rows that are equal in ``order`` get sums in an order of their own.
    """
    table = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums = table.groupBy("__range").agg(*[F.sum(F.col(x).cast(_WIDE)).alias(f"__{new}") for new, x in totals.items()])
    ahead = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    bases = sums.select("__range", *[F.coalesce(F.sum(f"__{new}").over(ahead), F.lit(0)).alias(f"__{new}") for new in totals])
    before = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = table.select("*", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(new) for new, x in totals.items()])
    total = {new: (F.col(new) + F.col(f"__{new}")).cast("bigint") for new in totals}
    return inside.join(bases, "__range").withColumns(total).drop("__range", *[f"__{new}" for new in totals])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0) -> DataFrame:
    """source, source_size, weight, rank, base (words of the sources before), capped, target and cap (its next whole number).

    ``sizes`` has a row (source, size) for each document.
    """
    period = len(weights)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = running(sources, by_name, {"rank": "one", "base": "source_size"})
    unit = math.lcm(*weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("rank") % period + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * epochs)
    ranked = ranked.withColumn("ratio", F.col("most") * F.element_at(F.array(*[F.lit(unit // w) for w in weights]), (F.col("rank") % period + 1).cast("int")))
    ordered = materialize(running(ranked, [F.col("ratio"), F.col("rank")], {"most_before": "most", "weight_before": "weight"}))
    total, heavy = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, heavy = int((total or 0) * share), heavy or 0
    left = F.lit(budget).cast(_WIDE) - F.col("most_before")
    own = F.col("most").cast(_WIDE) * (F.lit(heavy).cast(_WIDE) - F.col("weight_before")) <= F.col("weight").cast(_WIDE) * left
    capped = materialize(ordered.withColumn("capped", own))
    gone, light = capped.where("capped").agg(F.sum("most"), F.sum("weight")).first()
    rest, open_weight = budget - (gone or 0), max(1, heavy - (light or 0))
    part = F.col("weight") * F.lit(rest).cast("bigint")
    return capped.select(
        "source", "source_size", "weight", "rank", "base", "capped",
        F.when(F.col("capped"), F.col("most").cast("double")).otherwise(part.cast("double") / F.lit(float(open_weight))).alias("target"),
        F.when(F.col("capped"), F.col("most")).otherwise(F.expr(f"(weight * {rest}L + {open_weight - 1}L) div {open_weight}L")).alias("cap"),
        F.lit(budget).cast("bigint").alias("budget"), (F.lit(unit) / F.col("weight")).cast("bigint").alias("pace"),
    )


def _queued(docs: DataFrame, row: str, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """A slim row for each document: row, doc_id, source, size and its place in the shuffled order."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return docs.select(
        F.col(row).alias("__row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint").alias("shuffled"),
    )


def _served(queued: DataFrame, weights: tuple[int, ...], epochs: int, share: float) -> DataFrame:
    """A row for each copy in the mix, and one at least for each document: what is taken of it, and where in the mix."""
    targets = source_targets(queued.select("source", "size"), weights, epochs, share)
    same = queued["source"].eqNullSafe(targets["source"])
    known = queued.join(targets, same).drop(targets["source"])
    behind = running(known, [F.col("rank"), F.col("shuffled"), F.col("doc_id")], {"ahead": "size"})
    first = F.col("ahead") - F.col("base")
    copies = F.least(F.lit(epochs), F.expr("(cap - (ahead - base) + source_size - 1) div greatest(source_size, 1L)"))
    one_each = F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)).cast("int") - 1))
    copied = behind.withColumn("start", first).withColumn("copy", one_each).withColumn("start", F.col("start") + F.col("copy") * F.col("source_size"))
    timed = copied.withColumn("finish", (F.col("start") + F.col("size")) * F.col("pace"))
    served = timed.withColumn("words", F.greatest(F.lit(0), F.least("size", F.col("cap") - F.col("start"))))
    slim = served.select("__row", "doc_id", "size", "source_size", "target", "budget", "rank", "shuffled", "copy", "finish", "words")
    mixed = running(slim, [F.col(c) for c in ("finish", "rank", "copy", "shuffled", "doc_id")], {"at": "words"})
    return mixed.withColumn("words", F.greatest(F.lit(0), F.least("words", F.col("budget") - F.col("at"))))


def mixture(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0, seed: str = "mix",
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The mix itself: the rows of ``docs`` that it takes, once for each copy, with mix_copy, mix_words and mix_at.

    ``mix_words`` is how many of the text's words are taken (all but for the documents in service when the budget ends),
    ``mix_at`` the words of the mix before it: sorted by that, this is the order in which to train.
    """
    row = fresh(docs, "__row")
    numbered = materialize(docs.drop("mix_copy", "mix_words", "mix_at").withColumn(row, F.monotonically_increasing_id()))
    taken = _served(materialize(_queued(numbered, row, doc_id, text, source, seed)), weights, epochs, share).where("words > 0")
    taken = taken.select(F.col("__row").alias(row), F.col("copy").alias("mix_copy"), F.col("words").alias("mix_words"), F.col("at").alias("mix_at"))
    return numbered.join(taken, row).drop(row)


def mixed_words(docs: DataFrame) -> DataFrame:
    """The query: doc_id, size, source_size, target, taken, and mix_at, where in the mix its first copy stands (null: nowhere)."""
    row = fresh(docs, "__row")
    queued = materialize(_queued(docs.withColumn(row, F.monotonically_increasing_id()), row, "doc_id", "text", "source", "mix"))
    copies = _served(queued, WEIGHTS, EPOCHS, 1.0)
    same = [F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return copies.groupBy("__row").agg(
        *same, F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("at"))).alias("mix_at")
    ).select("doc_id", "size", "source_size", "target", "taken", "mix_at")
