"""transformWithState adapter of the folds."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline.operators.fold import KEYS, Fold, clean


class Ordered(StatefulProcessor):
    """Keeps a user's rows by time until the watermark has passed them, then steps through them in order of (ts, msg_id).

    Each timer reads and removes the rows of its own millisecond; timers of a user fire in order of time. Rows without a user stand alone.
    """

    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "text string, at long")
        self.waiting = handle.getMapState("waiting", "ms long", "rows string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if pdf.empty:  # a batch without data has no columns
                continue
            pdf.columns = [*KEYS, "_ms", *self.fold.needs, "_event"]  # Spark names computed columns by place here
            own = pdf[["msg_id", "user_id", "_ms", *self.fold.needs]].assign(ts=pdf["ts"].astype("datetime64[ns]").astype("int64").astype("string"))
            fresh: dict[int, list[dict]] = {}
            for r in own.to_dict("records"):
                fresh.setdefault(int(r["_ms"]), []).append({k: _plain(v) for k, v in clean(r).items()})
            for at, items in fresh.items():
                old = json.loads(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
                self.waiting.updateValue((at,), (json.dumps(old + items),))
                self.handle.registerTimer(at + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() - 1
        old = self.state.get() if self.state.exists() else None
        if not self.waiting.containsKey((at,)):
            if old is not None and old[1] + self.fold.ttl_ms <= at:
                self.state.clear()
            return
        now = sorted(json.loads(self.waiting.getValue((at,))[0]), key=lambda r: (int(r["ts"]), r["msg_id"] is not None, r["msg_id"] or 0, str(r.get("text"))))
        self.waiting.removeKey((at,))
        state, out = self.fold.load(old[0]) if old is not None else self.fold.new(), []
        for r in now:
            if r["user_id"] is None:
                state = self.fold.new()
            out.append((r["msg_id"], pd.Timestamp(int(r["ts"])), r["user_id"], *self.fold.step(state, at, r)))
        if now[0]["user_id"] is not None:
            self.state.update((self.fold.dump(state), at))
            self.handle.registerTimer(at + self.fold.ttl_ms + 2)
        pdf = pd.DataFrame(out, columns=[*KEYS, *(n for n, _ in self.fold.adds)])
        for n, t in [("msg_id", "long"), ("user_id", "long"), *self.fold.adds]:
            if t in ("int", "long"):
                pdf[n] = pdf[n].astype("Int64")
            elif t == "boolean":
                pdf[n] = pdf[n].astype("boolean")
        yield pdf

    def close(self) -> None:
        pass


def _plain(v: Any) -> Any:
    return v.item() if hasattr(v, "item") else v.tolist() if hasattr(v, "tolist") else v


def run(fold: Fold, messages: DataFrame, late: str) -> DataFrame:
    timed = fold.prepared(messages).select(*KEYS, "_ms", *fold.needs).withColumn("_event", F.col("ts").cast("timestamp")).withWatermark("_event", late)
    grouped = timed.groupBy("user_id")
    return grouped.transformWithStateInPandas(Ordered(fold), outputStructType=fold.schema(), outputMode="Append", timeMode="EventTime")
