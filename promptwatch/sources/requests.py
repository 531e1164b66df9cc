"""Request sources and log sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("client_ip", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("challenge_response", T.StringType()),
])

REPUTATION_JSON = (
    "trust_score double, total_requests bigint, abuse_count bigint, avg_cost_score double, "
    "last_seen double, created_at double, last_abuse double"
)


def default_user(user_id: Column, client_ip: Column) -> Column:
    """A missing or empty user is known by the address."""
    return F.coalesce(F.nullif(user_id, F.lit("")), F.concat(F.lit("anon_"), client_ip))


def _normalise(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "user_id": default_user(F.col("user_id"), F.col("client_ip")),
        "ts_us": F.unix_micros("ts"),
    })


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Requests from parquet, JSON or CSV files."""
    return _normalise(spark.read.format(fmt).schema(REQUEST).options(**options).load(path))


def stream_requests(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """The same files as a stream; unchanged columns so that batch and stream plans agree."""
    return _normalise(spark.readStream.format(fmt).schema(REQUEST).options(**options).load(path))


def log_entries(report: DataFrame, response: Column | None = None) -> DataFrame:
    """Request-log rows: time, shortened prompt and response, and the nested report."""
    shown = F.substring(F.coalesce(response if response is not None else F.lit(None).cast("string"), F.lit("")), 1, 300)
    fields = [c for c in report.columns if c != "prompt"]
    return report.select(
        F.timestamp_micros("ts_us").alias("ts"), F.substring("prompt", 1, 200).alias("prompt"),
        shown.alias("response"), F.struct(*fields).alias("report"),
        F.to_date(F.timestamp_micros("ts_us")).alias("date"),
    )


def write_request_log(report: DataFrame, path: str, response: Column | None = None) -> None:
    """Append to the log, one folder per day. The cap on kept rows is a matter of reading."""
    log_entries(report, response).write.mode("append").partitionBy("date").parquet(path)


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def reputation_from_json(df: DataFrame, user: str = "user_id", json: str = "state") -> DataFrame:
    """Import saved JSON states as columns."""
    return df.withColumn("_s", F.from_json(json, REPUTATION_JSON)).select(user, "_s.*")


def reputation_to_json(states: DataFrame, user: str = "user_id") -> DataFrame:
    """Export states as JSON, one document per user."""
    fields = [c for c in states.columns if c != user]
    return states.select(user, F.to_json(F.struct(*fields)).alias("state"))


def save_snapshot(states: DataFrame, path: str) -> None:
    states.write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str, now_us: int, ttl_us: int) -> DataFrame:
    """States that have not outlived their TTL."""
    return spark.read.parquet(path).filter(F.lit(now_us) - F.col("saved_us") < ttl_us)


def known_users(states: DataFrame, user: str = "user_id") -> DataFrame:
    return states.select(user).distinct()
