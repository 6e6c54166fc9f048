"""Operator 4: a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of fixed length. Each passage is encoded by what
its bytes show (kinds of characters, how often its short strings repeat) and a
learned layer; gated attention weights, learned from document labels alone, say
which passages matter; the weighted mean is scored.

Training uses a bounded sample, about ``TRAIN_DOCS`` labelled documents, with every
passage of each. Prediction uses every passage of every whole text.

Defined results: a null or empty text is one blank passage and gets its score;
an empty table gives an empty table; without labelled rows, or with one class
only, every score is the share of label 1 (0.5 without rows). Equal labels of one
id count once, and of several texts with one id the first in order is learned;
repeated rows get equal scores. A column of ``score``'s input that has the name of
the score is replaced; all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm.common import id_fold, mix64, sent_whole, table
from lithos.llm.sharding import chance
from lithos.llm.windows import adam, windows

PASSAGE, TRAIN_DOCS, EPOCHS = 512, 4000, 30
HIDDEN, GATE = 24, 16
#: Groups of bytes counted: each ASCII punctuation mark and control byte by itself, letters and digits by kind.
KIND = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    KIND[_b] = 0 if 97 <= _b < 123 else 1 if 65 <= _b < 91 else 2 if 48 <= _b < 58 else 3 if _b >= 0xC0 else 4 if _b >= 0x80 else 5 if _b == 32 else 6 if _b == 10 else 7
_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
KIND[_marks] = 8 + np.arange(len(_marks))
KINDS = 8 + len(_marks)
#: Lengths of strings whose repeats are counted, over so many hash buckets.
SPANS, BUCKETS = (3, 6, 12), 512
FEATURES = KINDS + len(SPANS) + 3


def encode(x: np.ndarray) -> np.ndarray:
    """Features of each passage: shares of byte kinds, repeats of short strings, shape of words."""
    n, size = x.shape
    kinds = KIND[x]
    rows = np.arange(n)[:, None]
    out = np.empty((n, FEATURES), np.float32)
    counts = np.bincount((rows * KINDS + kinds).ravel(), minlength=n * KINDS).reshape(n, KINDS)
    filled = np.maximum(1, size - np.argmax((x != 32)[:, ::-1], axis=1))  # without the blanks at the end
    blank = ~(x != 32).any(1)
    filled[blank] = 1
    counts[:, 5] -= size - filled
    share = counts / filled[:, None]
    out[:, :KINDS] = np.sqrt(np.maximum(share, 0))
    word = x.astype(np.uint64)
    pos = np.arange(size)
    for i, span in enumerate(SPANS):
        h = np.zeros((n, size - span + 1), np.uint64)
        for k in range(span):
            h = h * np.uint64(0x100000001B3) + word[:, k : size - span + 1 + k]
        b = (mix64(h) >> np.uint64(55)).astype(np.int64)
        live = pos[: size - span + 1] < np.maximum(filled - span + 1, 1)[:, None]
        c = np.bincount((rows * BUCKETS + b)[live], minlength=n * BUCKETS).reshape(n, BUCKETS)
        m = np.maximum(live.sum(1), 1)
        out[:, KINDS + i] = np.log((c.astype(np.float64) ** 2).sum(1) / m / (1 + m / BUCKETS))
    blanks = (kinds == 5) | (kinds == 6)
    starts = blanks[:, :-1] & ~blanks[:, 1:]
    out[:, -3] = starts.sum(1) / filled
    out[:, -2] = (blanks[:, :-1] & (kinds[:, 1:] == 1)).sum(1) / np.maximum(1, starts.sum(1))
    out[:, -1] = np.log(filled)
    return out


class AttentionBags:
    """Passage layer, gated attention and score; ``fit`` on bags, ``score`` on bags."""

    def __init__(self, base: float = 0.5, seed: int = 5):
        r = np.random.default_rng(seed)
        n = lambda *s: r.normal(0, s[0] ** -0.5, s).astype(np.float32)
        self.base, self.fitted = base, False
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {"w": n(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": n(HIDDEN, GATE), "u": n(HIDDEN, GATE), "a": n(GATE, 1), "o": n(HIDDEN, 1), "c": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, first: np.ndarray, own: np.ndarray) -> tuple:
        p = self.p
        h = np.tanh(((x - self.mean) / self.scale) @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = ((t * s) @ p["a"])[:, 0]
        e = np.exp(e - np.maximum.reduceat(e, first)[own])
        att = e / np.add.reduceat(e, first)[own]
        bag = np.add.reduceat(att[:, None] * h, first, axis=0)
        return h, t, s, att, bag, 1 / (1 + np.exp(-((bag @ p["o"])[:, 0] + p["c"][0])))

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 3e-3) -> None:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-2
        step, r, p = adam(self.p, rate), np.random.default_rng(3), self.p
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(len(bags)), max(1, len(bags) // batch)):
                size = np.array([len(bags[k]) for k in rows])
                first, own = np.concatenate([[0], np.cumsum(size)[:-1]]), np.repeat(np.arange(len(rows)), size)
                x = np.concatenate([bags[k] for k in rows])
                h, t, s, att, bag, q = self.forward(x, first, own)
                d = ((q - y[rows]) / len(rows)).astype(np.float32)
                dbag = d[:, None] * p["o"].T
                dh = att[:, None] * dbag[own]
                de = (h * dbag[own]).sum(1)
                de = att * (de - np.add.reduceat(att * de, first)[own])
                dg = de[:, None] * p["a"].T
                dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
                dh += dt @ p["v"].T + ds @ p["u"].T
                dz = dh * (1 - h * h)
                step({"o": bag.T @ d[:, None], "c": d.sum(keepdims=True), "a": (t * s).T @ de[:, None], "v": h.T @ dt, "u": h.T @ ds, "w": ((x - self.mean) / self.scale).T @ dz, "b": dz.sum(0)})
        self.fitted = True

    def score(self, x: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        if not self.fitted:
            return np.full(n, self.base)
        first = np.searchsorted(own, np.arange(n))
        return self.forward(x, first, own)[-1].astype(np.float64)


def passages(rows: DataFrame) -> DataFrame:
    """(id, label, text) to (id, label, features) of all passages, for training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, n, x, own in windows(b.column(2), PASSAGE):
                first = np.searchsorted(own, np.arange(n + 1))
                features = encode(x).astype("<f4")
                out += [features[a:e].tobytes() for a, e in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["id", "label", "x"])

    return rows.mapInArrow(run, "id long, label int, x binary")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = TRAIN_DOCS) -> AttentionBags:
    """Fit to documents (doc_id, text) with a 0/1 label; the sample is bounded by ``most``."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return AttentionBags(float(next(iter(counts), 0.5)))
    # half of the sample from either class, so that a rare class is learned
    rate = F.when(F.col("label") == 1, most / 2 / counts[1]).otherwise(most / 2 / counts[0])
    drawn = sent_whole(known.where(chance("id", F.lit(21)) < rate), 4 * most)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(drawn, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    got = sorted((r["id"], r["label"], r["x"]) for r in passages(rows).collect())
    if len({g[1] for g in got}) < 2:
        return AttentionBags(counts[1] / (counts[0] + counts[1]))
    net = AttentionBags()
    net.fit([np.frombuffer(g[2], "<f4").reshape(-1, FEATURES) for g in got], np.array([g[1] for g in got], np.float32))
    return net


def score(df: DataFrame, net: AttentionBags, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with each whole text's score."""
    def run(text: pd.Series) -> pd.Series:
        out = [net.score(encode(x), own, n) for _, n, x, own in windows(pa.array(text, pa.string(), from_pandas=True), PASSAGE)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return df.withColumn(score_col, F.pandas_udf(run, "double")(F.col(text_col)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; learned from labels of the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(id_fold("doc_id", 3) != 1)
    net = train(docs, labels)
    return score(docs.withColumn("held_out", id_fold("doc_id", 3) == 1), net).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
