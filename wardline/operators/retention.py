"""Logs that do not grow for ever, and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.text import log_time


def truncate(log: DataFrame, most: int, by: str = "filter") -> DataFrame:
    """Drops every line of a log that has reached ``most`` lines. Counts come from an aggregate, so no log is gathered in one task."""
    full = log.groupBy(by).count().filter(F.col("count") >= most).select(by)
    return log.join(F.broadcast(full) if full.limit(10_001).count() <= 10_000 else full, by, "left_anti")


def keep_latest(log: DataFrame, n: int, by: str = "filter", order: str = "seq") -> DataFrame:
    """The last n lines of each log; Spark keeps only n rows a log and task before it moves any."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return log.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def remove_oldest(log: DataFrame, now, keep_ms: int, line: str = "line") -> DataFrame:
    """Lines not older than ``keep_ms``; lines without a readable time stay."""
    at = log_time(F.col(line))
    age = F.unix_millis(F.to_timestamp(now)) - F.unix_millis(at.cast("timestamp"))
    return log.filter(at.isNull() | (age <= keep_ms))


def line_counts(log: DataFrame, by: str = "filter") -> DataFrame:
    return log.groupBy(by).agg(F.count("*").alias("lines"))
