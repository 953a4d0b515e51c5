"""Stupid-backoff scores of documents under the bigram counts of the whole corpus.

The exploded n-grams of a batch of documents (neighbours in the input) travel once each, as sorted runs of 64-bit hashes dealt by hash, to the
part of the count table that holds them; there counts add up, and every batch gets back the counts of its own n-grams, in the order of their
hashes, which it knows. Joined to the batch's documents they give each word's score, summed per document. A frequent word or bigram is one
entry a batch, never a hot key.

What replaces a join and an aggregate of Spark's: the table of counts is partitioned by hash, but a partition's rows are packed runs that
are merged and looked up inside grouped and cogrouped functions. As rows of their own (hash, document, count) the exploded n-grams took
more disk than the operator may use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import shuffle_partitions, word_count
from wardline.llm.ngram_join import _from_planes, _mix, _planes, _rows, word_hashes

#: A batch has 2 ** BATCH_BITS documents at most; occurrences from which a bigram is known; the backoff factor.
BATCH_BITS, KNOWN, BACKOFF = 11, 2, 0.4
FLUSH = 1_500_000
#: Scores are summed as whole millionths, which is the same in any order.
UNIT = 1_000_000

_U = np.uint64


def _grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and bigrams of a document as 64-bit hashes."""
    return words, _mix(words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else np.empty(0, _U)


def _pack(keys: np.ndarray) -> bytes:
    """Seven bytes a key, by place; the part's number, of eight bits or more, has the highest one."""
    return keys.view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(7, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :7] = planes.T
    return out.view(_U).ravel()


def _distinct(docs: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of documents, given by their words."""
    found, held, size = np.empty(0, _U), [], 0
    for words in docs:
        held += _grams(words)
        size += len(words)
        if size >= FLUSH:
            found, held, size = np.unique(np.concatenate([found, *held])), [], 0
    return np.unique(np.concatenate([found, *held]))


def score(docs: DataFrame, batch_bits: int = BATCH_BITS, known: int = KNOWN, backoff: float = BACKOFF) -> DataFrame:
    """Sum over a document's words of log S(word | word before), S being stupid backoff.

    Words: runs without ASCII white space, A-Z lower-cased. S is the bigram's share of its first word's count if the bigram occurs at least
    ``known`` times in the corpus, else ``backoff`` times the word's share of all words; a first word has its share alone. Counts are over
    all rows, in 64 bits. Null and empty texts have no words and score 0; a null doc_id stays null; repeated rows count as often as they
    occur; an empty table gives no rows; other columns than doc_id and text are not looked at. 64-bit hashes stand for n-grams: with D
    different ones about D * D / 2^65 pairs share theirs.

    Batches are rows that follow each other in a part of the input, whatever their doc_ids. The input is read twice and must give its rows
    in the same parts and order, as a table does; if it does not, the sums of a batch's hashes differ and the query stops.
    Returns doc_id, n_words, score_micros (the sum, each word's log rounded to millionths).
    """
    spark = docs.sparkSession
    bits = max(10, (4 * shuffle_partitions(spark) - 1).bit_length())
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.shiftright(F.monotonically_increasing_id(), batch_bits).alias("batch"))
    total = rows.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    kinds = {"part": pa.int32(), "batch": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(number: int) -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held[number]), return_counts=True)
            ends = np.append(np.searchsorted(keys, np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits)), len(keys))
            return _rows(kinds, [(p, number, _pack(keys[a:b]), _planes(counts[a:b].astype(np.int64))) for p, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if b > a])

        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for rb in batches:
            for text, number in zip(rb.column(0), rb.column(1).to_pylist(), strict=True):
                words, pairs = _grams(word_hashes(text.as_py() or ""))
                if len(words):
                    held.setdefault(number, []).extend((words, pairs))
                    size += len(words)
                if size >= FLUSH:  # a batch that is cut here sends some entries twice
                    done = list(held) if len(held) == 1 else list(held)[:-1]
                    for n in done:
                        yield flush(n)
                        del held[n]
                    size = sum(len(a) for own in held.values() for a in own[::2])
        for n in held:
            yield flush(n)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpack(b) for b in pdf["keys"]]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, at, np.concatenate([_from_planes(b, np.int64) for b in pdf["counts"]]))
        own: dict[int, list[np.ndarray]] = {}
        ends = np.cumsum([len(k) for k in keys])
        for number, start, end in zip(pdf["batch"], [0, *ends[:-1]], ends, strict=True):
            own.setdefault(int(number), []).append(at[start:end])
        part = int(pdf["part"].iloc[0])
        own_keys = ((number, np.unique(np.concatenate(a)) if len(a) > 1 else a[0]) for number, a in own.items())
        out = [(part, number, _planes(sums[a]), int(every[a].sum(dtype=_U).astype(np.int64))) for number, a in own_keys]
        return pd.DataFrame(out, columns=["part", "batch", "counts", "mark"])

    sent = rows.select("text", "batch").mapInArrow(send, "part int, batch long, keys binary, counts binary")
    counted = sent.groupBy("part").applyInPandas(count, "part int, batch long, counts binary, mark long")

    def sums(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        docs = [word_hashes(text or "") for text in own["text"]]
        keys = _distinct(docs)
        counts = np.concatenate([np.empty(0, np.int64), *(_from_planes(b, np.int64) for b in replies.sort_values("part")["counts"])])
        marks = replies["mark"].to_numpy(np.int64).sum(dtype=np.int64) if len(replies) else 0
        if len(keys) != len(counts) or int((keys & _U(2**56 - 1)).sum(dtype=_U).astype(np.int64)) != marks:
            raise ValueError(f"{len(keys)} n-grams in a batch, {len(counts)} counts: the input did not read the same twice")

        def look(h: np.ndarray) -> np.ndarray:
            return counts[np.searchsorted(keys, h)]

        out = []
        for doc_id, words in zip(own["doc_id"], docs, strict=True):
            words, pairs = _grams(words)
            micros = 0
            if len(words):
                ones, twos = look(words), look(pairs)
                logs = np.log(ones / total)
                logs[1:] = np.where(twos >= known, np.log(twos / ones[:-1]), np.log(backoff * ones[1:] / total))
                micros = int(np.rint(logs * UNIT).astype(np.int64).sum())
            out.append((doc_id, len(words), micros))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "score_micros"]).astype({"doc_id": "Int64", "n_words": "int64", "score_micros": "int64"})

    return rows.groupBy("batch").cogroup(counted.groupBy("batch")).applyInPandas(sums, "doc_id long, n_words long, score_micros long")


def op7(docs: DataFrame) -> DataFrame:
    return score(docs)


ORACLE = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w
), pairs AS (
  SELECT doc_id, pos, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM words
), c1 AS (SELECT word, count(*) AS n FROM words GROUP BY word
), c2 AS (SELECT prev, word, count(*) AS n FROM pairs WHERE prev IS NOT NULL GROUP BY prev, word
), total AS (SELECT count(*) AS n FROM words
), scored AS (
  SELECT p.doc_id, CAST(round(ln(CASE WHEN p.prev IS NULL THEN a.n / t.n WHEN c2.n >= 2 THEN c2.n / b.n ELSE 0.4 * a.n / t.n END) * 1000000) AS BIGINT) AS micros
  FROM pairs p JOIN c1 a ON a.word = p.word LEFT JOIN c1 b ON b.word = p.prev LEFT JOIN c2 ON c2.prev = p.prev AND c2.word = p.word CROSS JOIN total t
), sums AS (SELECT doc_id, count(*) AS n_words, CAST(sum(micros) AS BIGINT) AS score_micros FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(s.score_micros, 0) AS score_micros FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id
"""
