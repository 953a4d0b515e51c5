"""Approximate nearest neighbours by shifted space-filling curves.

Distinct vectors are projected at random onto a few dimensions, shifted, cut into cells and ordered along a Hilbert curve; several such
orderings are range-partitioned in Spark. Cells are so fine that a tight group of near copies is ordered by place too, on every curve by its
own projections. A query's window is a number of ranks on both sides of its own, and the whole of its cell if that holds more; it may span
partitions. The windows of all orderings merge and are reranked by exact distances on the original vectors.

The number of ranks is measured: for a bounded sample of the queries the nearest vectors are found by brute force, and windows are as wide as
it takes to hold the wanted share of them on one ordering at least. Where vectors lie in groups windows are short; where they have no
low-dimensional structure they must be a share of all ranks, and work grows with queries times rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import checkpointed, saved, shuffle_partitions, smallest
from wardline.llm.vectors import distinct, queries, ranked, valid

#: Orderings; projected dimensions and bits of each (66 bytes of key).
CURVES, DIMENSIONS, BITS = 18, 12, 44
#: Queries, at most, that windows are measured on, and the share of their neighbours that these must hold.
PROBES, RECALL = 192, 0.97
#: Ranks on each side at least; their least share of all ranks (1 / SHARES), which bounds the number of cells that are looked at whole.
LEAST, SHARES = 64, 20_000
#: Rows that the scales are fitted on.
FIT_ROWS = 4096


def hilbert_bits(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cells (n, d), integers under 2 ** bits, along the Hilbert curve, as (n, bits * d) binary digits; by the transposed form of Skilling (2004)."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            has = (x[i] & q) != 0
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(has, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    return np.stack([(x[i] >> b & 1).astype(np.uint8) for b in range(bits - 1, -1, -1) for i in range(d)], axis=1)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places as integers, where they have at most 63 digits."""
    key = np.zeros(len(cells), np.int64)
    for digit in hilbert_bits(cells, bits).T:
        key = (key << 1) | digit
    return key


class Curves:
    """Projections, shifts and scales; fitted on at most FIT_ROWS vectors."""

    def __init__(self, sample: np.ndarray, curves: int, dimensions: int, bits: int, seed: int = 41):
        rng = np.random.default_rng(seed)
        self.bits, size = bits, sample.shape[1]
        self.axes = [np.linalg.qr(rng.normal(size=(size, max(size, dimensions))))[0][:, : min(dimensions, size)] for _ in range(curves)]
        self.shifts = rng.uniform(-0.5, 0.5, (curves, dimensions))
        self.middle = sample.mean(0)
        self.scales = [np.maximum(((sample - self.middle) @ a).std(0), 1e-12) for a in self.axes]

    def keys(self, x: np.ndarray, curve: int) -> list[bytes]:
        """Beyond 3 standard deviations space narrows towards 4, so that far vectors keep their order too."""
        z = (x - self.middle) @ self.axes[curve] / self.scales[curve] + self.shifts[curve][: self.axes[curve].shape[1]]
        z = np.where(np.abs(z) > 3, np.sign(z) * (4 - 1 / np.maximum(np.abs(z) - 2, 1)), z)
        cells = np.clip((z + 4) / 8 * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64)
        return [row.tobytes() for row in np.packbits(hilbert_bits(cells, self.bits), axis=1)]


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def probe_neighbours(units: DataFrame, probes: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(probe, hash of a vector) for the k vectors nearest to each probe but itself, by brute force over all distinct vectors (vector, h)."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, names = np.full((len(probes), k), np.inf), np.zeros((len(probes), k), np.int64)
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            for at in range(0, len(blobs), 1024):
                x = _matrix(blobs[at : at + 1024])
                d = np.stack([((x - p) ** 2).sum(1) for p in probes])
                d[d == 0] = np.inf
                own = batch.column(1).to_numpy()[at : at + 1024]
                every, hashes = np.concatenate([best, d], 1), np.concatenate([names, np.broadcast_to(own, d.shape)], 1)
                order = np.argsort(every, axis=1, kind="stable")[:, :k]
                best, names = np.take_along_axis(every, order, 1), np.take_along_axis(hashes, order, 1)
        i, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[i, j]), pa.array(names[i, j])], names=["probe", "d", "h"])

    found = units.select("vector", "h").mapInArrow(nearest, "probe long, d double, h long")
    place = F.row_number().over(Window.partitionBy("probe").orderBy("d", "h"))
    return [(r.probe, r.h) for r in found.withColumn("place", place).filter(F.col("place") <= k).select("probe", "h").collect()]  # PROBES * k rows


def search(vectors: DataFrame, k: int = 10, every: int = 100, curves: int = CURVES, recall: float = RECALL) -> DataFrame:
    """The k nearest found for each query, the rows whose vec_id is divisible by ``every``, among all other rows, by Euclidean distance.

    Windows are measured to hold ``recall`` of the neighbours, see above.
    Copies of a vector are indexed once, with their k + 1 smallest ids, which is exact. Rows that take no part: see vectors.valid;
    without a valid row the result is empty. Ties go to the smaller vec_id; rows that repeat an id count once, at their best.
    Other columns than vec_id and embedding are not looked at. Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, zero=False)
    asked = saved(queries(rows, every), "ann-queries")
    units = saved(distinct(rows, k + 1).withColumn("h", F.xxhash64("vector")), "ann-vectors")
    sample = smallest(units, "h", FIT_ROWS).select("vector").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan = spark.sparkContext.broadcast(Curves(_matrix([bytes(r.vector) for r in sample]), curves, DIMENSIONS, BITS))
    marked = units.join(asked.select("vector").distinct().withColumn("asks", F.lit(True)), "vector", "left")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector").to_pylist())
                for c in range(curves):
                    keys = pa.array(plan.value.keys(x, c), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), keys, *batch.columns], names=["curve", "key", *batch.schema.names])

    placed = marked.select("vector", "ids", F.coalesce("asks", F.lit(False)).alias("asks")).mapInArrow(place, "curve int, key binary, vector binary, ids array<long>, asks boolean")
    order = ["curve", "key", "vector"]
    dealt = checkpointed(placed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order))

    width = max(LEAST, -(-units.count() // SHARES))
    run = pa.struct([("key", pa.binary()), ("first", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of each curve, and its runs of one key that are longer than the least window's side or touch an end of the partition."""
        n = np.zeros(curves, np.int64)
        runs: dict[int, list[list]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            curve, key = batch.column(0).to_numpy(), batch.column(1)
            new = (curve[1:] != curve[:-1]) | pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.flatnonzero(new) + 1])
            size = np.diff(np.append(start, len(curve)))
            of = curve[start]
            edge = np.append(True, of[1:] != of[:-1])
            for i in np.flatnonzero((size > width) | edge | np.append(edge[1:], True)):
                c, k = int(of[i]), key[int(start[i])].as_py()
                first = int(n[c] + start[i] - np.searchsorted(curve, c))
                own = runs.setdefault(c, [])
                if own and own[-1][0] == k:
                    own[-1][2] += int(size[i])
                else:
                    own.append([k, first, int(size[i])])
            n += np.bincount(curve, minlength=curves)
        has = np.flatnonzero(n)
        kept = [[dict(zip(("key", "first", "n"), r, strict=True)) for i, r in enumerate(runs[c]) if i in (0, len(runs[c]) - 1) or r[2] > width] for c in has]
        pid = np.full(len(has), TaskContext.get().partitionId(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pid), pa.array(has.astype(np.int64)), pa.array(n[has]), pa.array(kept, pa.list_(run))], names=["pid", "curve", "n", "runs"])

    counts = dealt.select("curve", "key").mapInArrow(count, "pid long, curve long, n long, runs array<struct<key: binary, first: long, n: long>>").collect()
    pieces: dict[int, list[tuple[int, int, int]]] = {}  # curve: (partition, first rank, rows); partitions + curves of them
    cells: dict[int, list[list]] = {}  # curve: [key, first rank, last rank] of the runs, over the partitions' ends
    for r in sorted(counts, key=lambda r: (r.curve, r.pid)):
        own, full = pieces.setdefault(r.curve, []), cells.setdefault(r.curve, [])
        own.append((r.pid, own[-1][1] + own[-1][2] if own else 0, r.n))
        for key, first, n in r.runs:
            if full and full[-1][0] == key:
                full[-1][2] += n
            else:
                full.append([key, own[-1][1] + first, own[-1][1] + first + n - 1])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        done = np.zeros(curves, np.int64)
        for batch in batches:
            curve = batch.column(0).to_numpy()
            rank = np.empty(len(curve), np.int64)
            for c in np.unique(curve):
                at = np.flatnonzero(curve == c)
                first = next(f for p, f, _ in pieces[c] if p == pid)
                rank[at] = first + done[c] + np.arange(len(at))
                done[c] += len(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(curve), pid, np.int64)), batch.column(0), pa.array(rank), *(batch.column(c) for c in ("vector", "ids", "asks"))], names=["pid", "curve", "rank", "vector", "ids", "asks"])

    ranks = dealt.mapInArrow(numbered, "pid long, curve int, rank long, vector binary, ids array<long>, asks boolean")

    # how far apart, on their best ordering, are sampled queries and their nearest vectors?
    probes = [(bytes(r.vector), r.h) for r in smallest(asked.select("vector").distinct().withColumn("h", F.xxhash64("vector")), "h", PROBES).collect()]
    near = probe_neighbours(units, _matrix([v for v, _ in probes]), k) if probes else []
    if near:
        wanted = spark.createDataFrame([(h,) for h in {h for _, h in probes} | {h for _, h in near}], "h long")  # PROBES * (k + 1) at most
        places: dict[int, np.ndarray] = {}
        for r in ranks.select("curve", "rank", F.xxhash64("vector").alias("h")).join(F.broadcast(wanted), "h").collect():
            places.setdefault(r.h, np.zeros(curves, np.int64))[r.curve] = r.rank
        apart = np.sort([int(np.abs(places[probes[p][1]] - places[h]).min()) for p, h in near])
        width = max(width, int(apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]))
    full = {c: [(first, last) for _, first, last in own if last - first >= width] for c, own in cells.items()}

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for curve, rank, vector in zip(*(batch.column(c).to_pylist() for c in ("curve", "rank", "vector")), strict=True):
                cell = next((f for f in full[curve] if f[0] <= rank <= f[1]), (rank, rank))
                low, high = min(cell[0], rank - width), max(cell[1], rank + width)
                out += [(p, curve, low, high, vector) for p, first, n in pieces[curve] if first <= high and first + n > low]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["pid", "curve", "low", "high", "vector"])

    wanted = ranks.filter("asks").select("curve", "rank", "vector").mapInArrow(windows, "pid long, curve int, low long, high long, vector binary")

    def rerank(data: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        out = []
        for curve, own in query.groupby("curve"):
            part = data[data["curve"] == curve].sort_values("rank")
            x, rank, ids = _matrix(list(part["vector"])), part["rank"].to_numpy(), part["ids"].to_numpy()
            for low, high, vector in zip(own["low"], own["high"], own["vector"], strict=True):
                a, b = np.searchsorted(rank, [low, high + 1])
                d = np.sqrt(((x[a:b] - np.frombuffer(vector, np.float64)) ** 2).sum(1))
                near = np.argpartition(d, k)[: k + 1] if len(d) > k + 1 else np.arange(len(d))
                near = np.flatnonzero(d <= d[near].max()) if len(near) else near
                best = sorted((d[j], i) for j in near for i in ids[a + j])[: k + 1]
                out.append((vector, [{"score": float(s), "vec_id": int(i)} for s, i in best]))
        return pd.DataFrame(out, columns=["vector", "near"])

    found = ranks.groupBy("pid").cogroup(wanted.groupBy("pid")).applyInPandas(rerank, "vector binary, near array<struct<score: double, vec_id: long>>")
    return ranked(asked, found, k, ascending=True)


def op8(vectors: DataFrame) -> DataFrame:
    return search(vectors)
