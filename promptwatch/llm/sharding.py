"""Sharding by extendible hashing: a directory over hash-prefix bits, split only where a bucket is too large.

Every row gets 60 hash bits. A bucket of depth d holds the rows with the same first d bits; it splits on one more bit
while its bytes exceed the limit. Bucket sizes never grow with depth, so a row's shard is its shallowest ancestor that
fits. Bytes are first added up by cell (prefixes some bits deeper than the average shard needs), a few cells for each
shard; each cell is then counted for all its ancestors at once. Only rows of cells that still exceed the limit go on
to the next, deeper cells. All of it is partially combined aggregation; rows meet their shard by a join on the cell.

Bits cannot part rows whose hashes agree (repeated rows, if the key has nothing that tells them apart). A bucket that
is still too large when the bits end gets overflow pages, as extendible hashing does: its rows are counted through by
(task, order in the task), sums by task first, and a page is filled up to the limit. A row of more than the limit fits
no bucket at any depth; it is set aside first and is a page of its own, named by all its bits.

Defined results: null keys and texts hash as a mark of their own and hold 0 bytes; an empty table gives no shards;
repeated rows are equal in hash and share a bucket until pages part them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptwatch.llm.shared import materialize

BITS = 60
#: Cells are this many bits deeper than shards of average size.
SLACK = 3


def hash_bits(*columns: Column) -> Column:
    """60 bits of the MD5 of the columns as a whole number; nulls differ from any text."""
    joined = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, BITS // 4), 16, 10).cast("bigint")


def directory(sizes: DataFrame, limit: int, depth: int, above: int) -> DataFrame:
    """(cell, level, fits) of cells given as (cell, bytes) at ``depth``: the shallowest ancestor below ``above`` that fits."""
    levels = F.explode(F.sequence(F.lit(above), F.lit(depth)))
    each = sizes.withColumn("level", levels).withColumn("up", F.expr(f"shiftright(cell, {depth} - level)"))
    fitting = each.groupBy("level", "up").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit)
    found = each.select("cell", "level", "up").join(fitting.select("level", "up"), ["level", "up"])
    return found.groupBy("cell").agg(F.min("level").alias("level"))


def shards(rows: DataFrame, key: list[str], size: Column, limit: int) -> DataFrame:
    """``rows`` with ``shard`` (its bits, then ``+page`` if overflowing), ``depth`` and ``shard_bytes``.

    Columns of ``rows`` with one of these three names are replaced, all others are passed on.
    """
    whole = materialize(rows.select(
        F.struct(*[c for c in rows.columns if c not in ("shard", "depth", "shard_bytes")]).alias("__in"),
        F.coalesce(size, F.lit(0)).cast("bigint").alias("__bytes"), hash_bits(*[F.col(c) for c in key]).alias("__hash"),
        F.monotonically_increasing_id().alias("__row"),
    ))
    done = _pages(whole.where(F.col("__bytes") > limit), limit).withColumn("depth", F.lit(BITS))
    left, above = whole.where(F.col("__bytes") <= limit), 0
    total = left.agg(F.sum("__bytes")).first()[0]
    depth = min(BITS, max(1, -(-(total or 0) // max(limit, 1))).bit_length() + SLACK)
    while True:
        cells = left.withColumn("cell", F.shiftright("__hash", BITS - depth))
        sizes = materialize(cells.groupBy("cell").agg(F.sum("__bytes").alias("bytes")))
        leaves = materialize(directory(sizes, limit, depth, above))
        settled = cells.join(leaves, "cell")
        settled = settled.withColumn("depth", F.col("level")).withColumn("page", F.lit(None).cast("bigint"))
        done = done.unionByName(settled.drop("cell", "level"))
        if depth == BITS or sizes.where(F.col("bytes") > limit).isEmpty():
            break
        left = materialize(cells.join(leaves, "cell", "left_anti").drop("cell"))
        above, depth = depth + 1, min(BITS, 2 * depth)
    if depth == BITS:
        rest = cells.join(leaves, "cell", "left_anti").drop("cell")
        done = done.unionByName(_pages(rest, limit).withColumn("depth", F.lit(BITS)).select(done.columns))
    bits = F.lpad(F.conv(F.expr(f"shiftright(__hash, {BITS} - depth)").cast("string"), 10, 2), F.col("depth"), "0")
    named = done.withColumn("shard", F.concat(F.when(F.col("depth") == 0, F.lit("")).otherwise(bits), F.coalesce(F.concat(F.lit("+"), F.col("page").cast("string")), F.lit(""))))
    named = materialize(named)
    sums = named.groupBy("shard").agg(F.sum("__bytes").alias("shard_bytes"))
    return named.join(sums, "shard").select("__in.*", "shard", "depth", "shard_bytes")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of rows that share all bits, and so their bytes: as many to a page as the limit holds."""
    task = F.shiftright("__row", 33)
    counted = rows.withColumn("task", task)
    before = W.partitionBy("__hash").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = counted.groupBy("__hash", "task").agg(F.count("*").alias("own")).withColumn("start", F.coalesce(F.sum("own").over(before), F.lit(0)))
    largest = rows.groupBy("__hash").agg(F.max("__bytes").alias("most"))
    place = F.row_number().over(W.partitionBy("__hash", "task").orderBy("__row")) - 1
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("most")))
    return (
        counted.withColumn("place", place).join(starts.drop("own"), ["__hash", "task"]).join(largest, "__hash")
        .withColumn("page", F.floor((F.col("start") + F.col("place")) / per_page).cast("bigint"))
        .drop("task", "place", "start", "most")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One Parquet folder for each shard, written by the task that holds it; shards fit their limit, so tasks do."""
    sharded.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, shard, depth and shard_bytes for every document; bytes are those of its UTF-8 text."""
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    return shards(rows, ["doc_id", "digest"], F.col("bytes"), limit).select("doc_id", "shard", "depth", "shard_bytes")
