"""What the two vector searches share: valid vectors, and distinct vectors with the smallest ids of their copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part.

    Left out: null ids, null or empty vectors, vectors with null or non-finite components, zero vectors unless ``zero``, and vectors
    whose length is not the most frequent one (ties: the longer).
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if not zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return rows.filter(F.size("v") == size[0].size) if size else rows


def cells(column: pa.Array) -> np.ndarray:
    """(rows, dimensions) of an array column without nulls; of doubles, -0.0 and 0.0 are one value."""
    flat = column.flatten().to_numpy()
    return (flat + 0.0 if flat.dtype.kind == "f" else flat).reshape(len(column), -1)


def distinct(rows: DataFrame, keep: int) -> DataFrame:
    """vector (binary, its components) and ids, its ``keep`` smallest vec_ids. Each task sends a vector once, so a frequent one is no hot key."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(best), pa.binary()), pa.array(list(best.values()), pa.list_(pa.int64()))], names=["vector", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            for vec_id, row in zip(batch.column(0).to_pylist(), cells(batch.column(1)), strict=True):
                ids = best.setdefault(row.tobytes(), [])
                ids.append(vec_id)
                if len(ids) > 4 * keep:
                    ids[:] = sorted(set(ids))[:keep]
            if len(best) > 50_000:
                yield flush()
                best = {}
        if best:
            yield flush()

    sent = rows.select("vec_id", "v").mapInArrow(local, "vector binary, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return sent.groupBy("vector").agg(ids.alias("ids"))


def queries(rows: DataFrame, every: int) -> DataFrame:
    """query_id and vector of the rows whose vec_id is divisible by ``every``; repeated rows once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in cells(batch.column(1))], pa.binary())], names=["query_id", "vector"])

    own = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v")
    return own.mapInArrow(pack, "query_id long, vector binary").distinct()


def best(found: DataFrame, n: int) -> DataFrame:
    """vector, near: the n best (score, vec_id) of all its rows of found, sorted, each id once, smaller scores being better."""
    items = found.select("vector", F.inline("near")).groupBy("vector", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("score", "vec_id"))
    return items.withColumn("place", place).filter(F.col("place") <= n).groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))


def ranked(asked: DataFrame, found: DataFrame, k: int, ascending: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of found (vector, near: array of (score, vec_id)) without the query itself, ties to the smaller id.

    near holds scores such that smaller is better. Copies of an id count once, at their best, in what is asked for too. What partitions have found for a vector is
    cut to its best k + 1 before it meets the queries, many of which may ask for one vector.
    """
    tops = best(found, k + 1)
    near = asked.join(tops, "vector").select("query_id", F.inline("near")).filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", (F.col("score") if ascending else -F.col("score")).alias("score"))
