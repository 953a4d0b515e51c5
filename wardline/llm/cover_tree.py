"""Exact top-k by inner product: dual-tree search over cover trees.

Vectors are turned into integers and copies collapse. Data are range-partitioned by the nearest of a few top centres; every partition
builds a cover tree over its vectors, and the queries that reach it get one too. A pair of nodes is dropped when no inner product
between them, bounded by the centres' product and the covering radii, can reach the worst kth score among the node's queries. The same
bound drops whole partitions for query groups. Groups visit the likeliest partition first, then a few more, then all that may still hold a
score as good as the kth found by then, so that these answer with little.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import checkpointed, saved, shuffle_partitions, smallest
from wardline.llm.vectors import best, distinct, queries, ranked, valid

#: Centres at the top, chosen among at most FIT_ROWS vectors; children of a node; vectors of a leaf; queries of a group.
CENTRES, FIT_ROWS, FAN, LEAF, GROUP = 32, 2048, 8, 512, 256
#: Partitions, the likeliest by their bounds, that queries visit in the first rounds.
ROUNDS = (1, 12)
#: Products of doubles are exact while no vector's squared length reaches this; integers are multiplied beyond.
DOUBLES = 2.0**52


@dataclass
class Node:
    rows: np.ndarray
    centre: np.ndarray
    radius: float
    children: list[Node]


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Places of n rows, each as far as can be from those before: they lie apart and cover the rest within the last distance."""
    chosen, gap = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1), out=gap)
    return np.array(chosen)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Each level's centres are apart and cover their subtrees within the radius kept there."""
    rows = np.arange(len(x)) if rows is None else rows
    own = x[rows]
    centre = own.mean(0)
    radius = float(np.sqrt(((own - centre) ** 2).sum(1).max()))
    node = Node(rows, centre, radius, [])
    if len(rows) > leaf and radius > 0:
        near = nearest(own, own[farthest_first(own, FAN)])
        parts = [rows[near == i] for i in range(near.max() + 1)]
        parts = [p for p in parts if len(p)]
        if len(parts) > 1:
            node.children = [cover_tree(x, p, leaf) for p in parts]
    return node


def bound(a: Node, b: Node) -> float:
    """No inner product between the nodes' vectors is above; with room for rounding."""
    na, nb = np.linalg.norm(a.centre), np.linalg.norm(b.centre)
    most = float(a.centre @ b.centre + na * b.radius + nb * a.radius + a.radius * b.radius)
    return most + 1e-9 * (abs(most) + 1)


class Tops:
    """The best k rows of each query so far, by score, then by smallest id."""

    def __init__(self, n: int, k: int, floor: np.ndarray, kind: type = np.float64):
        self.k, self.floor = k, floor
        self.score = np.full((n, k), -np.inf if kind is np.float64 else np.iinfo(kind).min, kind)
        self.row = np.full((n, k), -1, np.int64)

    def worst(self, rows: np.ndarray) -> float:
        last = np.where(self.row[rows, -1] < 0, -np.inf, self.score[rows, -1].astype(np.float64))
        return float(np.maximum(last, self.floor[rows]).min())

    def add(self, queries: np.ndarray, rows: np.ndarray, scores: np.ndarray, first: np.ndarray) -> None:
        """scores: (queries, rows); first: the smallest id of each row of data."""
        for q, s in zip(queries, scores, strict=True):
            at = np.flatnonzero((s >= self.score[q, -1]) & (s >= self.floor[q]))
            if len(at) > self.k:
                at = at[s[at] >= np.partition(s[at], -self.k)[-self.k]]
            if len(at):
                score, row = np.concatenate([self.score[q], s[at]]), np.concatenate([self.row[q], rows[at]])
                order = np.lexsort((np.where(row >= 0, first[row], 2**62), -score if score.dtype.kind == "f" else ~score))[: self.k]
                self.score[q], self.row[q] = score[order], row[order]


def dual_search(q: np.ndarray, x: np.ndarray, first: np.ndarray, k: int, floor: np.ndarray) -> Tops:
    """Best k rows of x for each row of q; rows under a query's floor may be left out. Integers are multiplied as such, without rounding;
    trees and bounds take doubles, with room for their rounding."""
    tops = Tops(len(q), k, floor, q.dtype.type)
    tq, tx = cover_tree(q.astype(np.float64), leaf=GROUP // 4), cover_tree(x.astype(np.float64))
    n = 0
    heap = [(-bound(tq, tx), n, tq, tx)]
    while heap:
        most, _, a, b = heapq.heappop(heap)
        if -most < tops.worst(a.rows):
            continue
        if not a.children and not b.children:
            tops.add(a.rows, b.rows, q[a.rows] @ x[b.rows].T, first)
            continue
        pairs = [(c, b) for c in a.children] if a.children and (a.radius >= b.radius or not b.children) else [(a, c) for c in b.children]
        for c, d in pairs:
            n += 1
            heapq.heappush(heap, (-bound(c, d), n, c, d))
    return tops


def _matrix(blobs, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """The k highest integer inner products of each query, the rows whose vec_id is divisible by ``every``, with all other rows.

    A component x counts as floor(scale * x). Products are exact: of doubles while they stay under 2 ** 53, of 64-bit integers where a vector is
    longer than that allows; scores must fit in 64 bits. Copies are searched once, with their k + 1
    smallest ids. Rows that take no part: see vectors.valid (zero vectors do take part); without a valid row the result is empty. Ties go
    to the smaller vec_id; rows that repeat an id count once, at their best. Other columns than vec_id and embedding are not looked at.
    Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, zero=True).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    kind = np.float64 if (rows.agg(F.max(square)).first()[0] or 0.0) < DOUBLES else np.int64
    if kind is np.float64:
        rows = rows.withColumn("v", F.transform("v", lambda x: x.cast("double")))

    def doubles(blobs) -> np.ndarray:
        return _matrix(blobs, kind).astype(np.float64)

    asked = saved(queries(rows, every), "tree-queries")
    units = saved(distinct(rows, k + 1).withColumn("h", F.xxhash64("vector")), "tree-vectors")
    sample = smallest(units, "h", FIT_ROWS).select("vector").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    x = doubles([bytes(r.vector) for r in sample])
    centres = x[farthest_first(x, CENTRES)]

    @F.pandas_udf("int")
    def centre(vector: pd.Series) -> pd.Series:
        return pd.Series(nearest(doubles(list(vector)), centres) if len(vector) else [], dtype="int32")

    order = ["node", "h", "vector"]
    dealt = checkpointed(units.withColumn("node", centre("vector")).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pid = np.full(batch.num_rows, TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(pid), *batch.columns], names=["pid", *batch.schema.names])

    data = dealt.select("vector", "ids").mapInArrow(numbered, "pid int, vector binary, ids array<long>")

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [v for b in batches for v in b.column(0).to_pylist()]
        if blobs:
            own = doubles(blobs)
            middle = own.mean(0)
            radius = float(np.sqrt(((own - middle) ** 2).sum(1).max()))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([middle.tobytes()]), pa.array([radius])], names=["pid", "middle", "radius"])

    parts = [(r.pid, Node(np.empty(0), np.frombuffer(r.middle, np.float64), r.radius, [])) for r in dealt.select("vector").mapInArrow(outline, "pid int, middle binary, radius double").collect()]
    asking = asked.select("vector").distinct()

    def local(data: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(query):
            return pd.DataFrame({"vector": [], "near": [], "pid": []}, dtype=object).astype({"pid": "int32"})
        ids = data["ids"].to_numpy()
        tops = dual_search(_matrix(list(query["vector"]), kind), _matrix(list(data["vector"]), kind), np.array([i[0] for i in ids]), k + 1, query["worst"].to_numpy(float))
        near = []
        for score, row in zip(tops.score, tops.row, strict=True):
            found = sorted((-int(s), int(i)) for s, r in zip(score, row, strict=True) if r >= 0 for i in ids[r])[: k + 1]
            near.append([{"score": s, "vec_id": i} for s, i in found])
        return pd.DataFrame({"vector": query["vector"], "near": near, "pid": query["pid"]})

    def reach(most: int | None):
        """Query rows for the partitions that may hold a score as good as a query's kth, of a group's ``most`` likeliest, or of all, but those
        that it has been to."""

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors, worsts, beens = (batch.column(c) for c in ("vector", "worst", "been"))
                for at in range(0, batch.num_rows, GROUP):
                    blobs, worst = vectors[at : at + GROUP].to_pylist(), worsts.to_numpy()[at : at + GROUP]
                    been = beens[at : at + GROUP].to_pylist()
                    own = doubles(blobs)
                    middle = own.mean(0)
                    group = Node(np.empty(0), middle, float(np.sqrt(((own - middle) ** 2).sum(1).max())), [])
                    for top, pid in sorted(((bound(group, node), pid) for pid, node in parts), reverse=True)[:most]:
                        go = [i for i in np.flatnonzero(worst <= top) if pid not in been[i]]
                        if go:
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(go), pid, np.int32)), pa.array([blobs[i] for i in go], pa.binary()), pa.array(worst[go])], names=["pid", "vector", "worst"])

        return send

    def visit(asking: DataFrame, most: int | None) -> DataFrame:
        near = asking.withColumn("node", centre("vector")).repartitionByRange("node", "vector").sortWithinPartitions("node", "vector")
        sent = near.select("vector", "worst", "been").mapInArrow(reach(most), "pid int, vector binary, worst double")
        kinds = "vector binary, near array<struct<score: long, vec_id: long>>, pid int"
        return sent.groupBy("pid").cogroup(data.groupBy("pid")).applyInPandas(lambda q, d: local(d, q), kinds)

    kth = asking.withColumn("worst", F.lit(float("-inf"))).withColumn("been", F.array().cast("array<int>"))
    found = None
    for most in ROUNDS:
        round_ = saved(visit(kth, most), "tree-round")
        found = round_ if found is None else found.unionByName(round_)
        tops = best(found, k + 1).withColumn("score", F.get("near", F.lit(k))["score"].cast("double"))
        # rounded down where doubles round, so that ties stay
        under = -F.col("score") if kind is np.float64 else -F.col("score") - F.abs("score") * 2.0**-50
        been = found.groupBy("vector").agg(F.collect_set("pid").alias("been"))
        kth = asking.join(been, "vector", "left").join(tops, "vector", "left").select("vector", F.coalesce(under, F.lit(float("-inf"))).alias("worst"), F.coalesce("been", F.array().cast("array<int>")).alias("been"))
    return ranked(asked, found.unionByName(visit(kth, None)), k, ascending=False)


def op9(vectors: DataFrame) -> DataFrame:
    return search(vectors)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
