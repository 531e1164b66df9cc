"""A global order as a column, without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptwatch.sources.workspace import materialize


def global_rank(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """Add ``out``: the row's place, from 1, in ``order``, which should leave no ties.

    Rows are dealt to ranges of the order and written with their range's number; a row's place is its place in the
    range plus the rows of the ranges before. The window without a key runs over a row for each range.
    """
    table = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return table.withColumn(out, inside).join(offsets, "_range").withColumn(out, F.col(out) + F.col("_offset")).drop("_range", "_offset")
