"""State machines over each user's messages in order of time: one step, two adapters."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

KEYS = ("msg_id", "ts", "user_id")


class Fold(ABC):
    """A subclass names the columns it needs and adds, and gives a new state, the step, and the state as text."""

    needs: tuple[str, ...]
    adds: tuple[tuple[str, str], ...]
    ttl_ms: int

    @abstractmethod
    def new(self) -> Any: ...

    @abstractmethod
    def step(self, state: Any, at: int, row: dict) -> tuple: ...

    @abstractmethod
    def dump(self, state: Any) -> str: ...

    @abstractmethod
    def load(self, text: str) -> Any: ...

    def schema(self) -> str:
        return ", ".join(["msg_id long", "ts timestamp_ntz", "user_id long", *(f"{n} {t}" for n, t in self.adds)])

    def prepared(self, messages: DataFrame) -> DataFrame:
        have = set(messages.columns)
        own = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in self.needs]
        own = [F.unix_millis(F.col(c).cast("timestamp")).alias(c) if c == "first_seen" and c in have else x for c, x in zip(self.needs, own, strict=True)]
        return messages.select(F.col("msg_id").cast("long"), F.col("ts").cast("timestamp_ntz"), F.col("user_id").cast("long"), F.unix_millis(F.col("ts").cast("timestamp")).alias("_ms"), *own)

    def batch(self, messages: DataFrame) -> DataFrame:
        """msg_id, ts, user_id and the added columns; see along()."""
        return along(self.prepared(messages), (self, {c: c for c in self.needs})).select(*KEYS, *(n for n, _ in self.adds))

    def stream(self, messages: DataFrame, late: str = "10 seconds") -> DataFrame:
        """The same over a stream: rows wait for the watermark, then run in order; rows later than that are dropped by Spark."""
        from wardline.streaming.stateful import run

        return run(self, messages, late)


def along(messages: DataFrame, *folds: tuple[Fold, dict[str, str | tuple[str, str]]]) -> DataFrame:
    """The messages with what folds add, in one pass. Each fold comes with the column that each of its needs is read from, or with two, the
    second for where the first is null.

    Users are dealt over tasks and streamed in order of (ts, msg_id): a task holds one user's state, never a user's messages, and a row
    comes out once whatever its msg_id. Rows without a user have no record and stand alone; rows without a time (``_ms``, if there is that
    column, else from ts) change no record and get nulls. Rows that agree in user, time, msg_id and the columns that are read are interchangeable.
    """
    if not folds:
        return messages
    timed = messages if "_ms" in messages.columns else messages.withColumn("_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    folds = tuple((fold, {need: (c, c) if isinstance(c, str) else c for need, c in own.items()}) for fold, own in folds)
    reads = list(dict.fromkeys(c for _, own in folds for both in own.values() for c in both))
    plain = [c for c in reads if timed.schema[c].dataType.typeName() not in ("struct", "array", "map")]
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alone = F.when(F.col("user_id").isNull(), F.xxhash64("ts", "msg_id", *plain))
    dealt = timed.repartition(n, "user_id", alone).sortWithinPartitions("user_id", "ts", "msg_id", *plain)
    kept = [c for c in messages.columns if c != "_ms"]
    fields = [T.StructField(c, timed.schema[c].dataType) for c in kept]
    adds = [T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in fold.adds)).fields for fold, _ in folds]
    kinds = [[to_arrow_type(f.dataType) for f in own] for own in adds]
    names = [*kept, *(f.name for own in adds for f in own)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, states = None, []
        for batch in batches:
            users, times = batch.column("user_id").to_pylist(), batch.column("_ms").to_pylist()
            values = {c: batch.column(c).to_pylist() for c in reads}
            made = [[[] for _ in own] for own in kinds]
            for i, (who, at) in enumerate(zip(users, times, strict=True)):
                if not states or who is None or who != user:
                    user, states = who, [fold.new() for fold, _ in folds]
                for (fold, own), state, cols in zip(folds, states, made, strict=True):
                    got = (None,) * len(cols) if at is None else fold.step(state, at, {need: values[c][i] if values[c][i] is not None else values[other][i] for need, (c, other) in own.items()})
                    for col, value in zip(cols, got, strict=True):
                        col.append(value)
            new = [pa.array(col, kind) for cols, own in zip(made, kinds, strict=True) for col, kind in zip(cols, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=names)

    return dealt.mapInArrow(work, T.StructType([*fields, *(T.StructField(f.name, f.dataType) for own in adds for f in own)]))


def clean(row: dict) -> dict:
    return {k: None if not isinstance(v, (list, dict)) and pd.isna(v) else v for k, v in row.items()}
