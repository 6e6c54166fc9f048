"""Operator 8: language identification by a byte convolutional network.

Filters of several widths over byte embeddings, max pooling over a window and a
softmax, trained in numpy on labelled text and applied to every window of every
whole text. A document's probabilities are the mean over its windows that hold
letters, weighted by the windows' letters.

Training uses a bounded sample of windows: of a language about ``TRAIN_DOCS``
documents are drawn (fewer where ``TRAIN_TOTAL`` of all languages would be passed),
and of each one window from anywhere in it. All languages are learned. For prediction the filters are folded into tables over
pairs of bytes, which gives the same sums as the convolution.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
an empty table gives an empty table; with no labelled row at all every text with
letters is ``und`` with score 0; repeated rows give equal rows. Columns of
``label``'s input that have the names of its results are replaced; all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm.common import hold, id_fold, sent_whole, table
from lithos.llm.sharding import chance
from lithos.llm.windows import BLANK, adam, windows

#: Bytes of a window; labelled documents drawn for a language, at most about so many; passes over them.
WINDOW, TRAIN_DOCS, EPOCHS = 256, 700, 12
WIDTHS, FILTERS, EMBED = (2, 3, 4), 12, 8
#: Windows drawn of all languages together, about.
TRAIN_TOTAL = 200_000
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


class ByteConv:
    """The network: ``fit`` on windows and class numbers, ``prepare`` and ``probabilities`` to predict."""

    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"emb": r.normal(0, 0.5, (256, EMBED)).astype(np.float32), "out": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32), "bias": np.zeros(len(classes), np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32)
        self.tables = None

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 5e-3) -> None:
        p, step, r = self.p, adam(self.p, rate), np.random.default_rng(11)
        if len(self.classes) < 2:
            return
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                xb, yb, n = x[rows], y[rows], len(rows)
                e = p["emb"][xb]
                best, feats = [], []
                for w in WIDTHS:
                    cols = np.concatenate([e[:, k : e.shape[1] - w + 1 + k] for k in range(w)], axis=2)
                    conv = cols @ p[f"w{w}"]
                    at = conv.argmax(axis=1)
                    best.append(at)
                    feats.append(np.take_along_axis(conv, at[:, None], 1)[:, 0])
                h = np.concatenate(feats, 1)
                live = h > 0
                z = (h * live) @ p["out"] + p["bias"]
                q = np.exp(z - z.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[np.arange(n), yb] -= 1
                q /= n
                g = {"out": (h * live).T @ q, "bias": q.sum(0), "emb": np.zeros_like(p["emb"])}
                dh = (q @ p["out"].T) * live
                for i, w in enumerate(WIDTHS):
                    at, d = best[i], dh[:, i * FILTERS : (i + 1) * FILTERS]
                    spans = xb[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]  # n, filters, w
                    near = p["emb"][spans].reshape(n, FILTERS, w * EMBED)
                    g[f"w{w}"] = np.einsum("nfk,nf->kf", near, d)
                    back = d[:, :, None] * p[f"w{w}"].T[None]
                    np.add.at(g["emb"], spans, back.reshape(n, FILTERS, w, EMBED))
                step(g)

    def prepare(self) -> None:
        """Tables over byte pairs: one row has the filters' sums over their first two bytes."""
        p, emb = self.p, self.p["emb"]
        part = lambda w, k: emb @ p[f"w{w}"][k * EMBED : (k + 1) * EMBED]
        pair = lambda w, k: (part(w, k)[:, None] + part(w, k + 1)[None]).reshape(65536, FILTERS)
        self.tables = np.concatenate([pair(w, 0) for w in WIDTHS], 1), part(3, 2), pair(4, 2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of each window."""
        heads, third, rest = self.tables
        out = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        for a in range(0, len(x), 64):
            b = x[a : a + 64]
            code = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
            c = heads[code]
            c[:, :-1, FILTERS : 2 * FILTERS] += third[b[:, 2:]]
            c[:, :-2, 2 * FILTERS :] += rest[code[:, 2:]]
            out[a : a + 64, :FILTERS] = c[:, :, :FILTERS].max(1)
            out[a : a + 64, FILTERS : 2 * FILTERS] = c[:, :-1, FILTERS : 2 * FILTERS].max(1)
            out[a : a + 64, 2 * FILTERS :] = c[:, :-2, 2 * FILTERS :].max(1)
        z = np.maximum(out, 0) @ self.p["out"] + self.p["bias"]
        q = np.exp(z - z.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)


def train(docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_class: int = TRAIN_DOCS) -> ByteConv | None:
    """A network fitted to a bounded sample of the rows of ``docs`` with a label and a letter."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    counts = rows.groupBy("label").count()  # a row a language
    langs = counts.count()
    if not langs:
        return None
    # one window of a drawn document, at a place its id decides
    each = min(float(per_class), TRAIN_TOTAL / langs)
    rows = rows.join(sent_whole(counts.select("label", (F.lit(each) / F.col("count")).alias("rate")), 1 << 20), "label")
    place = F.floor(chance("id", F.lit(3)) * F.greatest(F.length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    drawn = rows.where(chance("id", F.lit(1)) < F.col("rate")).select("id", "label", F.substring("text", place, F.lit(WINDOW)).alias("text")).collect()
    drawn = sorted((r["id"], r["label"], r["text"]) for r in drawn if LETTER.search(r["text"]))
    classes = sorted({r[1] for r in drawn})
    if not classes:
        return None
    x = np.full((len(drawn), WINDOW), BLANK, np.uint8)
    for k, (_, _, text) in enumerate(drawn):
        raw = np.frombuffer(text.encode()[:WINDOW], np.uint8)
        x[k, : len(raw)] = raw
    net = ByteConv(classes)
    net.fit(x, np.array([classes.index(r[1]) for r in drawn]))
    return net


IS_LETTER = np.zeros(256, np.float32)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = 1
FOUND = "lang_pred string, score double"


def predict(texts: pa.Array, net: ByteConv) -> tuple[list[str], list[float]]:
    hold("language")
    if net.tables is None:
        net.prepare()
    langs, scores = [], []
    for first, n, x, own in windows(texts, WINDOW):
        q = net.probabilities(x)
        weight = IS_LETTER[x].sum(1) + 1e-3
        total = np.zeros((n, len(net.classes)))
        np.add.at(total, own, q * weight[:, None])
        total /= total.sum(1, keepdims=True)
        best = total.argmax(1)
        for k in range(n):
            text = texts[first + k].as_py()
            ok = text is not None and LETTER.search(text) is not None
            langs.append(net.classes[best[k]] if ok else UNKNOWN)
            scores.append(float(total[k, best[k]]) if ok else 0.0)
    return langs, scores


def label(df: DataFrame, net: ByteConv | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``df`` with the predicted language and its probability."""
    if net is None:
        return df.withColumn(lang_col, F.lit(UNKNOWN)).withColumn(score_col, F.lit(0.0))

    def run(text: pd.Series) -> pd.DataFrame:
        langs, scores = predict(pa.array(text, pa.string(), from_pandas=True), net)
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    # a filter on the columns found stays above them: pushed below, it would run the network a second time
    found = F.pandas_udf(run, FOUND).asNondeterministic()(F.col(text_col))
    mark = "_found_language"
    return df.withColumn(mark, found).withColumn(lang_col, F.col(f"{mark}.lang_pred")).withColumn(score_col, F.col(f"{mark}.score")).drop(mark)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; learned from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", id_fold("doc_id", 4) == 2)
    net = train(docs.where("not held_out"))
    return label(docs.select("doc_id", "held_out", "text"), net).select("doc_id", "held_out", "lang_pred", "score")
