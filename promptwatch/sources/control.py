"""The blacklist as a table of add / remove actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptwatch.operators.prefix import latest_mark
from promptwatch.params import HOUR_US

# Fixed value: reason recorded when an action gives none.
DEFAULT_REASON = "Manually blacklisted"


def blacklist_current(control: DataFrame) -> DataFrame:
    """Members in force now (``kind, key, reason, triggered_by, ts_us``): the last action wins."""
    last = control.groupBy("kind", "key").agg(
        F.max_by(F.struct("action", "reason", "triggered_by", "ts_us"), F.struct("ts_us", "seq")).alias("a")
    )
    return last.filter("a.action = 'add'").select("kind", "key", "a.reason", "a.triggered_by", "a.ts_us")


def blacklist_intervals(control: DataFrame) -> DataFrame:
    """Disjoint validity intervals ``kind, key, reason, from_us, to_us`` (open end is NULL)."""
    w = Window.partitionBy("kind", "key").orderBy("ts_us", "seq")
    spans = control.select(
        "kind", "key", "action", "reason", F.col("ts_us").alias("from_us"), F.lead("ts_us").over(w).alias("to_us")
    )
    return spans.filter("action = 'add'").drop("action")


#: Up to this many actions on one key, intervals are joined; beyond, the log is merged in time.
FEW_ACTIONS = 32


def blacklist_gate(requests: DataFrame, control: DataFrame, ts: str = "ts_us") -> DataFrame:
    """Add ``deny_reason`` (NULL when not blacklisted at the time); the user is asked before the address."""
    busiest = control.groupBy("kind", "key").count().agg(F.max("count")).first()[0] or 0
    find = _by_interval if busiest <= FEW_ACTIONS else _as_of
    df = requests
    for kind, column, prefix in (("user", "user_id", "_u"), ("ip", "client_ip", "_i")):
        df = find(df, control.filter(F.col("kind") == kind), column, ts, prefix)
    user_reason = F.coalesce(F.concat(F.lit("user blacklisted: "), F.col("_u_reason")), F.lit("user blacklisted"))
    reason = F.when(F.col("_u_listed"), user_reason).when(F.col("_i_listed"), "ip blacklisted")
    return df.withColumn("deny_reason", reason).drop("_u_reason", "_u_listed", "_i_reason", "_i_listed")


def _by_interval(df: DataFrame, control: DataFrame, column: str, ts: str, prefix: str) -> DataFrame:
    spans = blacklist_intervals(control).select(
        F.col("key").alias("_key"), F.col("reason").alias(f"{prefix}_reason"),
        F.lit(True).alias(f"{prefix}_listed"), "from_us", "to_us",
    )
    in_force = (
        (F.col(column) == F.col("_key")) & (F.col(ts) >= F.col("from_us"))
        & (F.col("to_us").isNull() | (F.col(ts) < F.col("to_us")))
    )
    return df.join(spans, in_force, "left").drop("_key", "from_us", "to_us")


def _as_of(df: DataFrame, control: DataFrame, column: str, ts: str, prefix: str) -> DataFrame:
    marks = control.select(F.col("key").alias(column), F.col("ts_us").alias(ts), "seq", "action", "reason")
    found = latest_mark(df, marks, column, ts, "seq", ["action", "reason"], "_last", HOUR_US)
    return found.withColumns({
        f"{prefix}_reason": F.col("_last.reason"),
        f"{prefix}_listed": F.coalesce(F.col("_last.action") == "add", F.lit(False)),
    }).drop("_last")
