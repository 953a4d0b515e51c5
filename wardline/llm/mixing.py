"""Mixing sources to target weights by entropy balancing.

Each source's document rates start from 1, may not pass a cap, and must take a target number of words. The calibrated rates
nearest to the start in bounded entropy are cap * s(u + l * size / mean), s the logistic function, u the start's place: the odds
of a document are exponentially tilted by its size, with one multiplier l a source. Distributed Newton iterations on the convex
dual find the multipliers over a table of (source, size, documents). Rates become whole copies within buckets of each source, from the
largest document to the smallest: each takes the copies that bring the words taken nearest to the words due so far, so what the large
ones leave over or short the small ones make up, and a bucket ends within a small document of its share of the target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import release_memory, saved, shuffle_partitions, word_count

#: Documents in a bucket, on average.
BUCKET = 4096


def _indexed(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Adds a source's weight: weights repeat over sources in order of code points, null last. Sorted and numbered in parallel."""
    ordered = sources.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    numbered = ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    df = sources.sparkSession.createDataFrame(numbered, "source string, source_size long, n_docs long, place long")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return df.withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int")))


def _level(sources: DataFrame, budget: float, cap: float) -> float:
    """Words for a unit of weight: the excess over cap * size goes to the others until none is above."""
    level, capped = 0.0, -1
    while True:
        at_cap = F.col("weight") * level >= F.col("source_size") * cap
        if capped < 0:
            at_cap = F.lit(False)
        r = sources.agg(
            F.sum(F.when(at_cap, 0.0).otherwise(F.col("weight")).cast("decimal(38,6)")).alias("open"),
            F.coalesce(F.sum(F.when(at_cap, F.col("source_size"))), F.lit(0)).alias("full"),
            F.count_if(at_cap).alias("n"),
        ).first()
        if r.n == capped or not r.open:
            return level
        capped, level = r.n, (budget - cap * r.full) / float(r.open)


def _rate(cap: float):
    """cap * logistic(start + tilt * size / mean), exactly the cap or 0 at the ends."""
    start = -math.log(cap - 1)  # where the rate is 1
    u = F.lit(start) + F.col("tilt") * F.col("size") / F.col("mean")
    return F.when(F.col("full"), F.lit(cap)).otherwise(F.lit(cap) / (F.lit(1.0) + F.exp(-u)))


def _tilts(sizes: DataFrame, sources: DataFrame, cap: float, rounds: int, tolerance: float) -> DataFrame:
    """source, tilt, mean, full: Newton on each source's dual, all sources at once; sums are decimals, hence the same in any order."""
    counts = saved(sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("docs")), "mix-counts")
    state = sources.select(
        "source",
        "target",
        F.greatest(F.col("source_size") / F.greatest("n_docs", F.lit(1)), F.lit(1.0)).alias("mean"),
        (F.col("target") >= cap * F.col("source_size")).alias("full"),
        F.lit(0.0).alias("tilt"),
        F.lit(-64.0).alias("low"),
        F.lit(64.0).alias("high"),
    )
    for _ in range(rounds):
        state = saved(state, "mix-state")
        at = counts.join(F.broadcast(state) if state.count() <= 10_000 else state, counts["source"].eqNullSafe(state["source"])).drop(counts["source"])
        rate = _rate(cap)
        words = F.col("docs") * F.col("size") * rate
        slope = words * (1 - rate / cap) * F.col("size") / F.col("mean")
        sums = at.groupBy("source").agg(F.sum(words.cast("decimal(38,6)")).cast("double").alias("got"), F.sum(slope.cast("decimal(38,6)")).cast("double").alias("slope"))
        gap = F.col("got") - F.col("target")
        moved = state.alias("s").join(sums.alias("m"), F.col("s.source").eqNullSafe(F.col("m.source")), "left").select("s.*", "got", "slope")
        off = moved.agg(F.max(F.when(~F.col("full"), F.abs(gap) / F.greatest("target", F.lit(1.0))))).first()[0]
        if off is None or off < tolerance:
            break
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - gap / F.greatest("slope", F.lit(1e-9))
        inside = (step > low) & (step < high)
        state = moved.select("source", "target", "mean", "full", F.when(F.col("got").isNull(), F.col("tilt")).when(inside, step).otherwise((low + high) / 2).alias("tilt"), low.alias("low"), high.alias("high"))
    return state.select("source", "mean", "full", "tilt")


def _rounded(rated: DataFrame, cap: int) -> DataFrame:
    """Adds copies, of all alike rows together (n), to rows of source, bucket, size, rate and n. Buckets are streamed, never held."""
    order = [F.desc("size"), "order", "doc_id", "row", "text_hash"]
    dealt = rated.repartition(shuffle_partitions(rated.sparkSession), "source", "bucket").sortWithinPartitions("source", "bucket", *order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, due = None, 0.0  # words due so far in a bucket, less those taken
        for batch in batches:
            copies = np.zeros(batch.num_rows, np.int64)
            cols = (batch.column(c).to_pylist() for c in ("source", "bucket", "size", "rate", "n"))
            for i, (source, bucket, size, rate, n) in enumerate(zip(*cols, strict=True)):
                if here != (source, bucket):
                    here, due = (source, bucket), 0.0
                if size:
                    due += rate * size * n
                    copies[i] = min(cap * n, max(0, math.floor(due / size + 0.5)))
                    due -= int(copies[i]) * size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copies)], names=[*batch.schema.names, "copies"])
        release_memory()

    return dealt.mapInArrow(work, T.StructType([*rated.schema.fields, T.StructField("copies", T.LongType())]))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2, rounds: int = 30, tolerance: float = 1e-7, row: Column | None = None) -> DataFrame:
    """How often each document enters a mix of ``share`` times all words, divided over sources by weight.

    Size: words of the text, null and empty 0. Sources in order of code points, null last, take ``weights`` in turn; no target passes
    ``cap`` (a whole number) times its source's size. Every row is a document, without a doc_id too: repeated rows and ties may differ in
    copies by one, in an order fixed by size, doc_id and text, so reruns agree. Texts without words are never taken. An empty table gives no
    rows; other columns than doc_id, text and source are not looked at.
    Returns doc_id, source, size, source_size, target, rate, copies and row, a long that the caller may give to tell rows apart.
    """
    row = (F.lit(0) if row is None else row).cast("long").alias("row")
    rows = docs.select(F.col("doc_id").cast("long"), row, F.col("source").cast("string"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    sizes = saved(rows, "mix-sizes")
    per_source = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "mix-sources")
    total = per_source.agg(F.sum("source_size")).first()[0] or 0
    weighted = saved(_indexed(per_source, weights), "mix-weights")
    level = _level(weighted, share * total, cap)
    target = F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(cap))
    sources = saved(weighted.select("source", "source_size", "n_docs", target.alias("target")), "mix-targets")
    tilts = _tilts(sizes, sources, cap, rounds, tolerance)
    known = sources.alias("s").join(tilts.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "mean", "full", "tilt")
    known = saved(known, "mix-known")
    n = known.count()  # one row a source; broadcast only where that is few
    small = F.broadcast(known) if n <= 10_000 else known
    alike = sizes.groupBy("doc_id", "row", "source", "size", "text_hash").agg(F.count("*").alias("n"))
    rated = alike.alias("d").join(small.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source")))
    rated = rated.select("doc_id", "row", "d.source", "size", "text_hash", "n", "source_size", "n_docs", "target", _rate(cap).alias("rate"))
    rated = rated.withColumn("order", F.xxhash64(F.lit(11), "doc_id", "row", "text_hash")).withColumn("bucket", F.pmod("order", F.ceil(F.col("n_docs") / BUCKET)))
    whole = _rounded(rated.drop("n_docs"), cap).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    each = F.expr("copies div n + if(nth <= copies % n, 1, 0)").cast("int")
    return whole.select("doc_id", "source", "size", "source_size", "target", "rate", each.alias("copies"), "row")


def op10(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")
