"""Connected components of a table of links: local forests, then smallest labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import release_memory, saved

#: Links that a task holds before it reduces them to a forest.
HELD = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) with the same components as those given, one fewer than a component has nodes.

    Each component becomes a binary tree over its sorted nodes with the smallest at the top, so no node keeps more than three links.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        lower = label.copy()
        np.minimum.at(lower, label[x], low)
        np.minimum.at(lower, label[y], low)
        while (lower[lower] != lower).any():
            lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    order = np.argsort(label, kind="stable")
    start = np.searchsorted(label[order], label[order])
    rank = np.arange(len(order)) - start
    child = np.flatnonzero(rank)
    return nodes[order[start[child] + (rank[child] - 1) // 2]], nodes[order[child]]


def spanned(links: DataFrame) -> DataFrame:
    """Reduces the links (a, b) of each task to a forest: a task with m nodes keeps m - 1 links at most, whatever it read. Null ends are left out."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = np.empty(0, np.int64), np.empty(0, np.int64), []
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) > HELD:
                (a, b), held = forest(*(np.concatenate([own, *(h[i] for h in held)]) for i, own in enumerate((a, b)))), []
        a, b = forest(*(np.concatenate([own, *(h[i] for h in held)]) for i, own in enumerate((a, b))))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        release_memory()

    return links.filter("a <> b").select("a", "b").mapInArrow(reduce, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for links (a, b); nodes without a link are not in the result.

    Null ends, repeated links and links of a node with itself add nothing; an empty table gives no rows. Links and labels stay in tables;
    each task's links become a forest first, so what is iterated grows with the nodes. A node's label falls to the smallest of its
    neighbours', then to its label's label, until none falls.
    """
    some = spanned(links)
    both = saved(some.select(F.col("a").alias("node"), F.col("b").alias("near")).union(some.select("b", "a")).distinct(), "links")
    labels = saved(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("near"), "label"), "near").groupBy("node").agg(F.min("label").alias("low"))
        lower = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jump = labels.filter("label < node").select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = saved(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        if moved.filter("label < old").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")
