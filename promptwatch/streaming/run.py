"""Drive a streaming query over everything that is available now."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptwatch.sources.workspace import ensure_checkpoint_dir
from promptwatch.streaming.ordered import STORE


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings that a query takes along when it starts."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partitions: int | None = None) -> StreamingQuery:
    """Append a stream to a table; restarting with the same checkpoint continues exactly there.

    ``partitions`` of the state are fixed by the first start; the default is one for each core of the cluster, since
    every one of them is a store and a worker in every trigger.
    """
    spark = stream.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism)}
    with _settings(spark, wanted):
        return (
            stream.writeStream.format("parquet").outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
        )


def run_available(stream: DataFrame) -> DataFrame:
    """Process what is there into a table of its own and read that back."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/promptwatch-stream-{uuid.uuid4().hex}"
    start(stream, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def run_totals(stream: DataFrame) -> DataFrame:
    """Same for a complete-mode aggregate: each trigger replaces the table of totals."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/promptwatch-stream-{uuid.uuid4().hex}"

    def replace(totals: DataFrame, _: int) -> None:
        totals.write.mode("overwrite").parquet(f"{base}/table")

    (
        stream.writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def file_stream(spark: SparkSession, folder: str, table: str, schema: object, files_per_trigger: int = 1) -> DataFrame:
    """A table of parquet files as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped so far because they came after the watermark had passed them."""
    return sum(
        operator.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress for operator in progress.get("stateOperators", [])
    )


def split_late(stream: DataFrame, folder: str, delay_us: int, ts: str = "ts_us") -> None:
    """Process what is there into two tables: ``folder/on_time``, and ``folder/late`` with the rows behind the watermark.

    The engine drops late rows and only counts them; here they are kept, by trigger. The watermark of a trigger is the
    latest time of all triggers before it, less the delay, and a row at or before it is late, as the engine has it.
    What a trigger saw is a row of ``folder/seen``; every trigger writes its own folders anew, so a repeated one changes nothing.
    """
    spark = stream.sparkSession

    def split(rows: DataFrame, trigger: int) -> None:
        try:
            seen = spark.read.parquet(f"{folder}/seen").where(F.col("trigger") < trigger).agg(F.max("latest")).first()[0]
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            seen = None
        mark = -(1 << 62) if seen is None else (seen - delay_us) // 1000 * 1000
        late = F.floor(F.col(ts) / 1000) * 1000 <= mark
        rows.filter(late).withColumn("watermark_us", F.lit(mark)).write.mode("overwrite").parquet(f"{folder}/late/trigger={trigger}")
        rows.filter(~late).write.mode("overwrite").parquet(f"{folder}/on_time/trigger={trigger}")
        latest = rows.agg(F.max(ts).alias("latest")).where("latest is not null")
        latest.write.mode("overwrite").parquet(f"{folder}/seen/trigger={trigger}")

    stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _views(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder}/newest")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def keep_newest(stream: DataFrame, folder: str, most: int, order: list[str]) -> None:
    """Process what is there into ``folder/log``, and a view of the ``most`` newest rows by ``order`` beside it.

    Each trigger writes its rows and the view after it under its own number: the newest of the view before and its rows.
    A repeated trigger writes the same folders again, so it changes nothing; readers take the view with the highest number.
    """
    spark = stream.sparkSession

    def commit(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/log/trigger={trigger}")
        views = _views(spark, folder)
        if views is not None:
            earlier = views.filter(F.col("trigger") < trigger)
            last = earlier.agg(F.max("trigger")).first()[0]
            if last is not None:
                rows = rows.unionByName(earlier.filter(F.col("trigger") == last).drop("trigger"))
        top = rows.orderBy(*[F.desc(c) for c in order]).limit(most)
        top.write.mode("overwrite").parquet(f"{folder}/newest/trigger={trigger}")

    stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The view after the last trigger."""
    views = spark.read.parquet(f"{folder}/newest")
    return views.filter(F.col("trigger") == views.agg(F.max("trigger")).first()[0]).drop("trigger")
