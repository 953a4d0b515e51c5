"""Sinks: log files by filter, notices, and one writer for every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pyspark.sql.streaming.listener import StreamingQueryListener

from wardline.functions.text import fill, log_line, parse_action, typed_action, webhook_body


def log_rows(notes: DataFrame, template: str, ts: str = "ts") -> DataFrame:
    """filter, line of notices (filter, user_id, item)."""
    body = fill(template, {"player": F.col("user_id").cast("string"), "item": F.col("item"), "filter": F.col("filter")})
    return notes.select("filter", log_line(F.col(ts), body).alias("line"))


def append_logs(lines: DataFrame, path: str) -> None:
    """A folder of text files for each filter."""
    lines.select("filter", F.col("line").alias("value")).write.partitionBy("filter").mode("append").text(path)


def webhook_rows(notes: DataFrame, template: str) -> DataFrame:
    """msg_id and the JSON body for each notice; sending them is the host's."""
    return notes.select("msg_id", webhook_body(fill(template, {"player": F.col("user_id").cast("string"), "item": F.col("item")})).alias("body"))


def action_rows(df: DataFrame, lines: str = "actions") -> DataFrame:
    """Adds parsed, the (type, content) of each action line, and typed, whom each reaches with which arguments; dispatch is the host's."""
    return df.withColumn("parsed", F.transform(lines, parse_action)).withColumn("typed", F.transform("parsed", typed_action))


def punishment_rows(fired: DataFrame, template: str, ts: str = "ts") -> DataFrame:
    """filter, line of the punishment log for violations that fire a stage (filter, user_id, at_count, stage, items)."""
    joined = F.array_join("items", ", ")
    values = {
        "player": F.col("user_id").cast("string"), "time": F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), "violations": F.col("at_count").cast("string"),
        "stage": F.col("stage").cast("string"), "words": joined, "links": joined, "original-message": F.when(F.size("items") == 0, F.lit("[CAPS]")).otherwise(joined),
    }
    return fired.select("filter", fill(template, values).alias("line"))


class Metrics(StreamingQueryListener):
    """Counts what streams of moderation have read and written, by the query's name; add it to spark.streams."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.failures: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.name), 0)

    def onQueryProgress(self, event) -> None:
        name = str(event.progress.name)
        self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows
        self.batches[name] = self.batches.get(name, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failures[str(event.runId)] = event.exception


def write_each(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """One idempotent write for each micro-batch."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
