"""Language identification: a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled rows, on the driver. It labels
every byte; a document's probabilities are the mean over its positions. Whole texts are read: they are laid out in windows
that run through the network side by side, each window starting from a learned-from-zero state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import release_memory, smallest

#: Hidden units in each direction; bytes of a window; windows that run side by side.
HIDDEN, WINDOW, LANES = 8, 160, 2048
#: Bounds of the training sample: rows, and characters of their whole texts together.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 24_000_000
TRAIN_WINDOW, TRAIN_LANES, TRAIN_STEPS = 48, 384, 280
UNKNOWN = "und"
#: Bytes that run through the network at once, about.
GROUP_BYTES = 2_000_000


@dataclass
class Network:
    """wx: (2, 256, 3h) input tables of both directions, biases included; wh: (2, 3h, h); out: (labels, 2h + 1). Gates: update, reset, candidate."""

    labels: list[str]
    wx: np.ndarray
    wh: np.ndarray
    out: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _run(wx: np.ndarray, wh: np.ndarray, x: np.ndarray, keep: bool = False):
    """States (T, h, B) of one direction for bytes x (T, B); with keep, the gates too."""
    steps, lanes = x.shape
    h3, h = wh.shape
    table = np.ascontiguousarray(wx.T)
    states = np.zeros((steps + 1, h, lanes), np.float32)
    kept = []
    zr_w, c_w = np.ascontiguousarray(wh[: 2 * h]), np.ascontiguousarray(wh[2 * h :])
    for t in range(steps):
        before = states[t]
        a = table.take(x[t], axis=1)
        zr = zr_w @ before
        zr += a[: 2 * h]
        np.clip(zr, -30, 30, out=zr)
        _sigmoid(zr)
        z, r = zr[:h], zr[h:]
        rc = r * before
        c = c_w @ rc
        c += a[2 * h :]
        np.tanh(c, out=c)
        now = states[t + 1]
        np.subtract(c, before, out=now)
        now *= z
        now += before
        if keep:
            kept.append((z, r, rc, c))
    return states, kept


def _back(wh: np.ndarray, x: np.ndarray, states: np.ndarray, kept: list, grad: np.ndarray):
    """Gradients for the input table and the recurrent weights; grad (T, h, B) arrives at each state."""
    h = wh.shape[1]
    d_wh, d_wx = np.zeros_like(wh), np.zeros((256, 3 * h), np.float32)
    carry = np.zeros_like(states[0])
    for t in range(len(x) - 1, -1, -1):
        z, r, rc, c = kept[t]
        before = states[t]
        g = grad[t] + carry
        dc = g * z * (1 - c * c)
        dz = g * (c - before) * z * (1 - z)
        d_rc = wh[2 * h :].T @ dc
        dr = d_rc * before * r * (1 - r)
        da = np.concatenate([dz, dr, dc])
        d_wh[: 2 * h] += da[: 2 * h] @ before.T
        d_wh[2 * h :] += dc @ rc.T
        carry = g * (1 - z) + d_rc * r + wh[: 2 * h].T @ da[: 2 * h]
        order = np.zeros((256, len(x[t])), np.float32)
        order[x[t], np.arange(len(x[t]))] = 1
        d_wx += order @ da.T
    return d_wx, d_wh


def train(samples: list[tuple[bytes, str]], seed: int = 5) -> Network:
    """Adam on the mean cross-entropy of every position; the same samples give the same network."""
    labels = sorted({lang for _, lang in samples})
    rng = np.random.default_rng(seed)
    h = HIDDEN
    params = [rng.normal(0, 0.3, (2, 256, 3 * h)), rng.normal(0, 0.4, (2, 3 * h, h)), rng.normal(0, 0.3, (max(1, len(labels)), 2 * h + 1))]
    params = [p.astype(np.float32) for p in params]
    net = Network(labels, *params)
    samples = [(s, labels.index(lang)) for s, lang in samples if s]
    if len(labels) < 2 or not samples:
        return net
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(TRAIN_STEPS):
        x, y = np.zeros((TRAIN_WINDOW, TRAIN_LANES), np.uint8), np.zeros(TRAIN_LANES, np.int64)
        for lane in range(TRAIN_LANES):
            s, y[lane] = samples[rng.integers(len(samples))]
            at = rng.integers(max(1, len(s) - TRAIN_WINDOW + 1))
            piece = s[at : at + TRAIN_WINDOW]
            x[:, lane] = np.frombuffer((piece * (TRAIN_WINDOW // len(piece) + 1))[:TRAIN_WINDOW], np.uint8)
        ahead, kept_a = _run(net.wx[0], net.wh[0], x, True)
        behind, kept_b = _run(net.wx[1], net.wh[1], x[::-1], True)
        both = np.concatenate([ahead[1:], behind[1:][::-1], np.ones((TRAIN_WINDOW, 1, TRAIN_LANES), np.float32)], 1)
        p = _softmax(net.out @ both)
        p[:, y, np.arange(TRAIN_LANES)] -= 1
        p /= TRAIN_WINDOW * TRAIN_LANES
        d_out = np.einsum("tkb,tjb->kj", p, both, optimize=True)
        d_both = net.out.T @ p
        wx_a, wh_a = _back(net.wh[0], x, ahead, kept_a, d_both[:, :h])
        wx_b, wh_b = _back(net.wh[1], x[::-1], behind, kept_b, d_both[::-1, h : 2 * h])
        rate = 0.03 * min(1.0, 2 * (1 - step / TRAIN_STEPS))
        for p_, g, (m, v) in zip(params, (np.stack([wx_a, wx_b]), np.stack([wh_a, wh_b]), d_out), moments, strict=True):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p_ -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)
    return net


def _softmax(a: np.ndarray) -> np.ndarray:
    """Over axis 1, in place."""
    a -= a.max(1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(1, keepdims=True)
    return a


def position_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """(T, labels, B) for bytes (T, B)."""
    ahead, _ = _run(net.wx[0], net.wh[0], x)
    behind, _ = _run(net.wx[1], net.wh[1], x[::-1])
    h = HIDDEN
    scores = net.out[:, :h] @ ahead[1:]
    scores += net.out[:, h : 2 * h] @ behind[1:][::-1]
    scores += net.out[:, 2 * h :]
    return _softmax(scores)


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over the positions of each text (non-empty), (texts, labels)."""
    sizes = np.array([len(t) for t in texts])
    windows = -(-sizes // WINDOW)
    padded = np.frombuffer(b"".join(t.ljust(w * WINDOW, b" ") for t, w in zip(texts, windows, strict=True)), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), windows)
    filled = np.full(len(owner), WINDOW)
    filled[np.cumsum(windows) - 1] = sizes - (windows - 1) * WINDOW
    sums = np.zeros((len(texts), len(net.labels)))
    order = np.argsort(-filled, kind="stable")  # short windows run together, and no longer than they are
    for at in range(0, len(order), LANES):
        own = order[at : at + LANES]
        steps = int(filled[own].max())
        p = position_probabilities(net, np.ascontiguousarray(padded[own, :steps].T))
        if filled[own].min() < steps:
            p *= (np.arange(steps)[:, None] < filled[own])[:, None, :]
        np.add.at(sums, owner[own], p.sum(0, dtype=np.float64).T)
    return sums / sizes[:, None]


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def training_sample(docs: DataFrame) -> list[tuple[bytes, str]]:
    """Whole texts of at most SAMPLE_ROWS labelled rows that are not held out, in the order of a hash.

    A text that would take the sample over SAMPLE_CHARS characters is left out of it, and the next one tried. Rows that agree in doc_id and
    text count once.
    """
    known = docs.filter(F.coalesce(~held_out(), F.lit(True)) & F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = known.select("lang", "text", F.xxhash64(F.lit(17), "doc_id", "text").alias("order"))
    chosen, chars = [], 0
    for r in smallest(rows.select("order", F.length("text").alias("n")), "order", SAMPLE_ROWS).collect():
        if chars + r.n <= SAMPLE_CHARS and (not chosen or chosen[-1] != r.order):
            chosen.append(r.order)
            chars += r.n
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame([(c,) for c in chosen], "order long")  # SAMPLE_ROWS at most
    taken = {r.order: (r.text.encode(), r.lang) for r in rows.join(F.broadcast(wanted), "order").groupBy("order").agg(F.min("lang").alias("lang"), F.first("text").alias("text")).collect()}
    return [taken[c] for c in chosen]


def has_letter():
    return F.col("text").rlike(r"\p{L}")


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """lang_pred and score of each document.

    lang_pred: a label of the training rows, ties to the first in code point order; score: its pooled probability. Null texts and texts
    without a letter, and all rows if no row is labelled, get ``und`` and score 0. lang, source and doc_id never enter a prediction.
    Repeated rows give repeated results; an empty table gives no rows; other columns are not looked at.
    Returns doc_id, held_out, lang_pred, score.
    """
    return _predict(docs.select("doc_id", "text", "lang"), net).select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "lang_pred", "score")


def labelled(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """The documents with all their columns, and lang_pred and score as in identify()."""
    return _predict(docs, net)


def _predict(docs: DataFrame, net: Network | None) -> DataFrame:
    net = net or train(training_sample(docs))
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            lang, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
            group, size = [], 0
            has = [i for i, t in enumerate(text) if t is not None] if net.labels else []
            for n, i in enumerate(has):
                group.append((i, text.iat[i].encode()))
                size += len(group[-1][1])
                if size > GROUP_BYTES or n == len(has) - 1:
                    p = pooled(net, [t for _, t in group])
                    for (j, _), k, top in zip(group, p.argmax(1), p.max(1), strict=True):
                        lang[j], score[j] = net.labels[k], min(1.0, top)
                    group, size = [], 0
            yield pd.DataFrame({"lang_pred": lang, "score": score})
        release_memory()

    lettered = F.when(has_letter(), F.col("text"))
    found = docs.withColumn("_found", predict.asNondeterministic()(lettered))  # else a filter on it runs the network twice
    return found.withColumn("lang_pred", F.col("_found.lang_pred")).withColumn("score", F.col("_found.score")).drop("_found")


def op6(docs: DataFrame) -> DataFrame:
    return identify(docs)
