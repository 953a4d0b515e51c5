"""Line dedup: lines found in many documents go from all of them.

Hashes of line keys are range-partitioned with document and position as secondary sort, so that a line found in a third
of all documents spreads over many tasks. Each task streams its sorted rows, counts the first occurrence of a line in each
document, and sends back only positions, which become sparse bitmaps per document; line text is never shuffled by key.
Runs that cross a partition border are settled from two summary rows per partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import BLANKS, NO_ID, checkpointed, lower_az, saved, shuffle_partitions

ORDER = ["h1", "h2", "doc", "copy", "pos"]


def line_key(line: Column) -> Column:
    return lower_az(F.btrim(line, F.lit(BLANKS)))


def _with_identity(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), *carry, text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("copy"))


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(ORDER))]


def _new_runs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(h1), bool)
    fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return fresh


def _border_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last run of a sorted partition: key, documents, first and last document."""
    first: list | None = None
    run: list | None = None  # h1, h2, documents, first document, last document
    runs = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, _, _ = _arrays(batch)
        fresh = _new_runs(h1, h2)
        head = fresh.copy()
        head[1:] |= doc[1:] != doc[:-1]
        joins = run is not None and (run[0], run[1]) == (h1[0], h2[0])
        if joins and run[4] == doc[0]:
            head[0] = False
        starts = np.flatnonzero(fresh)
        counts = np.add.reduceat(head, starts, dtype=np.int64)
        ends = np.append(starts[1:], len(h1)) - 1
        if joins:
            run[2] += int(counts[0])
            run[4] = int(doc[ends[0]])
        if not joins or len(starts) > 1:
            if run is not None and first is None:
                first = run
            at = 0 if not joins else 1
            if first is None and at < len(starts) - 1:
                first = [int(h1[starts[at]]), int(h2[starts[at]]), int(counts[at]), int(doc[starts[at]]), int(doc[ends[at]])]
            runs += len(starts) - at
            run = [int(h1[starts[-1]]), int(h2[starts[-1]]), int(counts[-1]), int(doc[starts[-1]]), int(doc[ends[-1]])]
    if run is not None:
        pid = TaskContext.get().partitionId()
        rows = [[pid, runs == 1, *run]] if runs == 1 else [[pid, False, *first], [pid, False, *run]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["pid", "alone", "h1", "h2", "n", "first_doc", "last_doc"])


def _crossing(rows: list) -> dict[tuple[int, int], int]:
    """Documents of each run that crosses a border; rows: two at most per partition, in order."""
    totals: dict[tuple[int, int], int] = {}
    last = None
    for r in rows:
        key = (r.h1, r.h2)
        if last is not None and (last.h1, last.h2) == key and last.pid != r.pid:
            totals[key] = totals.get(key, last.n) + r.n - (last.last_doc == r.first_doc)
        last = r
    return totals


def _frequent(min_docs: int, totals: dict[tuple[int, int], int]):
    """Streams a sorted partition and passes on the rows of lines that enough documents hold."""

    def rows(pieces: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for doc, copy, pos in pieces:
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(copy), pa.array(pos)], names=["doc", "copy", "pos"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None  # the last run: its documents so far, the last of them, its rows while it has too few
        n, last, held = 0, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, copy, pos = _arrays(batch)
            fresh = _new_runs(h1, h2)
            head = fresh.copy()
            head[1:] |= doc[1:] != doc[:-1]
            starts = np.flatnonzero(fresh)
            counts = np.add.reduceat(head, starts, dtype=np.int64)
            goes_on = key == (int(h1[0]), int(h2[0]))
            if goes_on:
                counts[0] += n - int(last == doc[0])
            drop = counts >= min_docs
            for at in {0, len(starts) - 1}:
                drop[at] |= totals.get((int(h1[starts[at]]), int(h2[starts[at]])), 0) >= min_docs
            if goes_on and drop[0]:
                yield from rows(held)
            if len(starts) > 1 or not goes_on or drop[0]:
                held = []
            if not drop[-1]:
                held.append([c[starts[-1] :] for c in (doc, copy, pos)])
            key, n, last = (int(h1[-1]), int(h2[-1])), int(counts[-1]), int(doc[-1])
            keep = np.repeat(drop, np.diff(np.append(starts, len(h1))))
            if keep.any():
                yield from rows([[c[keep] for c in (doc, copy, pos)]])

    return stream


def _bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc, copy, words: a keep bitmap, from word number to 64 bits, 1 for each line that stays.

    Words that are not there are all ones, and so are bits past the last line; documents that keep all lines have no row.
    """
    spark = docs.sparkSession
    lines = _with_identity(docs).select("doc", "copy", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    hashed = lines.filter(F.length("key") >= max(1, min_chars)).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc", "copy", "pos")
    hashed = saved(hashed, "lines")  # range partitioning reads its input twice; hashes are short, texts are not
    dealt = checkpointed(hashed.repartitionByRange(shuffle_partitions(spark), *ORDER).sortWithinPartitions(*ORDER))
    borders = dealt.mapInArrow(_border_runs, "pid long, alone boolean, h1 long, h2 long, n long, first_doc long, last_doc long").collect()  # two rows per partition
    # one row per partition comes first by its place in the partition: the runs of one partition are in hash order
    totals = _crossing(sorted(borders, key=lambda r: (r.pid, r.h1, r.h2)))
    gone = dealt.mapInArrow(_frequent(min_docs, totals), "doc long, copy long, pos int").distinct()
    words = gone.groupBy("doc", "copy", F.shiftright("pos", 6).alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
    return words.groupBy("doc", "copy").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """Drops every line whose key at least ``min_docs`` documents hold.

    A key is the line without ASCII white space at its ends, A-Z lower-cased; keys under ``min_chars`` code points stay. Rows with
    one doc_id are one document; a null doc_id is one document too. Null and empty texts: one empty line. An empty table gives no
    rows; repeated rows give repeated results; other columns than doc_id and text are not looked at.
    Returns doc_id, n_lines, n_dropped, kept_text and the columns named in ``carry``.
    """
    kept = _bitmaps(docs, min_docs, min_chars)
    # a bitmap has a bit for a line of the text beside it, so a task holds far less of bitmaps than it streams of texts
    joined = _with_identity(docs, carry).join(kept.hint("shuffle_hash"), ["doc", "copy"], "left")
    bit = "coalesce(shiftright(words[shiftright(i, 6)], i % 64) & 1L, 1L) = 1L"
    text = F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(F.expr(f"filter(split(text, '\n', -1), (l, i) -> {bit})"), "\n"))
    dropped = F.when(F.col("words").isNull(), F.lit(0)).otherwise(F.expr("aggregate(map_values(words), 0, (a, b) -> a + 64 - bit_count(b))"))
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    return joined.select("doc_id", n_lines.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), text.alias("kept_text"), *carry)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The bitmaps alone, without a text: doc_id and words, from word number to 64 bits, 1 for each line that stays. Words that are not
    there are all ones, and so are documents that are not there."""
    return _bitmaps(docs, min_docs, min_chars).select(F.when(F.col("doc") == NO_ID, None).otherwise(F.col("doc")).alias("doc_id"), "words")


def op2(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), gone AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, line, pos, k IN (SELECT k FROM gone) AS drop_it FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop_it) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop_it), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
