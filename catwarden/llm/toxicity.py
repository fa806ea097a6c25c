"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with ``<`` and ``>`` at its ends)
and itself, hashed into a table of embeddings; its vector is their mean. A
document is the mean of its words' vectors, and a linear softmax over that mean
gives the two classes. Embeddings and softmax are trained jointly by gradient
steps in numpy, so a misspelling never seen shares most of its vector with the
word it is made from.

As mean and softmax are linear, a word adds one number to a document's margin;
workers keep these numbers for words they have met.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import is_held_out, kept_in_worker, labelled_sample, unused

BUCKETS = 1 << 17
DIM = 4
MIN_N, MAX_N = 3, 5
#: Bound of the training sample: documents of each class, and characters of a document.
TRAIN_PER_CLASS = (1_600, 1_000)  # clean, toxic
TRAIN_CHARS = 6_000
EPOCHS = 80
STEP = 0.2
SIGMAS = 6.0
MEMO = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def subwords(word: str) -> np.ndarray:
    """Buckets of a word: the whole word and its n-grams."""
    raw = f"<{word}>"
    grams = [raw] + [raw[i:i + n] for n in range(MIN_N, MAX_N + 1) for i in range(len(raw) - n + 1)]
    return np.array([zlib.crc32(g.encode()) % BUCKETS for g in grams], dtype=np.int64)


@dataclass
class Model:
    margin: np.ndarray  # of each bucket: embedding . (softmax weights of toxic - of clean)
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def word(self, w: str) -> float:
        got = self.memo.get(w)
        if got is None:
            got = float(self.model.margin[subwords(w)].mean())
            if len(w) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[w] = got
        return got

    def score(self, text: str | None) -> float:
        words = words_of(text)
        z = self.model.bias
        if words:
            z += sum(map(self.word, words)) / len(words)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(texts: list[str | None], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Joint gradient descent on embeddings and softmax (cross entropy, full
    batch, Adagrad). Without both classes the score is the share of toxic rows
    (0 with no rows at all)."""
    y = np.asarray(labels, dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    vocab: dict[str, int] = {}
    doc_w, doc_n, doc_ptr = [], [], [0]
    for t in texts:
        known = np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], dtype=np.int64)  # none in a text without words
        ids, counts = np.unique(known, return_counts=True)
        doc_w.append(ids)
        doc_n.append((counts / max(1, counts.sum())).astype(np.float32))
        doc_ptr.append(doc_ptr[-1] + len(ids))
    if not vocab:
        share = float(y.mean())
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    doc_w, doc_n = np.concatenate(doc_w).astype(np.int64), np.concatenate(doc_n)
    doc_of = np.repeat(np.arange(len(texts)), np.diff(doc_ptr))
    grams = [subwords(w) for w in vocab]
    size = np.array([len(g) for g in grams])
    w_ptr = np.concatenate(([0], np.cumsum(size)))[:-1]
    w_idx = np.concatenate(grams)
    del grams
    # compact the buckets in use, so that vectors of unused ones stay zero and cost nothing
    used, w_idx = np.unique(w_idx, return_inverse=True)
    w_idx = w_idx.astype(np.int32)
    order = np.argsort(w_idx, kind="stable")
    entry_word = np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
    b_ptr = np.concatenate(([0], np.cumsum(np.bincount(w_idx, minlength=len(used)))))[:-1]
    inv_size = (1 / size).astype(np.float32)
    # squared weight that each bucket has had over the documents: gradients are divided by its root, so that
    # a bucket moves by the strength of its evidence and not by its frequency
    seen = np.bincount(doc_w, doc_n * doc_n, minlength=len(size)).astype(np.float32) * inv_size * inv_size
    scale = 1 / np.sqrt(np.add.reduceat(seen[entry_word], b_ptr) + 1e-12)

    rng = np.random.default_rng(seed)
    U = np.zeros((DIM, len(used)), np.float32)  # embeddings divided by scale
    W = (rng.standard_normal((2, DIM)) * 0.5).astype(np.float32)
    b = np.log(np.array([1 - y.mean(), y.mean()], dtype=np.float32))
    cU, cW, cb = 0.0, np.zeros_like(W), np.zeros_like(b)
    target = np.stack([1 - y, y])
    n = len(y)
    chosen = None
    for epoch in range(epochs):
        V = np.stack([np.add.reduceat((U[d] * scale)[w_idx], w_ptr) * inv_size for d in range(DIM)])  # word vectors
        D = np.stack([np.bincount(doc_of, V[d][doc_w] * doc_n, minlength=n) for d in range(DIM)]).astype(np.float32)
        z = W @ D + b[:, None]
        z -= z.max(axis=0)
        p = np.exp(z)
        p /= p.sum(axis=0)
        g = (p - target) / n
        gD = W.T @ g
        gW, gb = g @ D.T, g.sum(axis=1)
        gU = np.empty_like(U)
        for d in range(DIM):
            gV = np.bincount(doc_w, gD[d][doc_of] * doc_n, minlength=len(size)).astype(np.float32) * inv_size
            gU[d] = np.add.reduceat(gV[entry_word], b_ptr) * scale
        cU = 0.9 * cU + 0.1 * float(np.sqrt((gU * gU).sum(axis=0)).max())
        step = STEP / (cU + 1e-20)
        if epoch == epochs // 2:
            chosen = U.any(axis=0)
        U -= step * gU
        if chosen is not None:  # the buckets that were found settle, without shrinkage
            U *= chosen
        else:  # evidence below SIGMAS standard errors is taken for chance and shrunk away
            chance = SIGMAS * np.sqrt(np.mean(g[1] ** 2)) * np.linalg.norm(W[1] - W[0])
            U *= np.maximum(0, 1 - step * chance / np.maximum(np.sqrt((U * U).sum(axis=0)), 1e-20))
        cW += gW * gW
        cb += gb * gb
        W -= 0.5 * gW / np.sqrt(cW + 1e-12)
        b -= 0.5 * gb / np.sqrt(cb + 1e-12)
    E = U * scale
    margin = np.zeros(BUCKETS, np.float32)
    margin[used] = (W[1] - W[0]) @ E
    return Model(margin, float(b[1] - b[0]))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic",
                  per_class=TRAIN_PER_CLASS, chars: int = TRAIN_CHARS) -> DataFrame:
    """The bounded training sample: by hash order, at most ``per_class`` rows of
    each class outside the held-out fold, of texts up to ``chars`` characters."""
    known = (labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("y"))
             .where(F.col("y").isin(0, 1) & ~is_held_out(F.col("_id")))
             .groupBy("_id").agg(F.max("y").alias("y")))
    return labelled_sample(docs, known, {0: per_class[0], 1: per_class[1]}, chars)


def fit(docs: DataFrame, labels: DataFrame, **kw) -> Model:
    rows = training_rows(docs, labels, **kw).toPandas()  # bounded: rows and characters
    return train(rows["text"].tolist(), rows["y"].to_numpy(dtype=np.float32))


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` with the probability of the toxic class for each whole text.
    Null and empty texts get the bias alone. Other columns pass through."""
    import uuid

    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = kept_in_worker(key, lambda: shared.value.scorer())
        for texts in batches:
            yield pd.Series([s.score(t) for t in texts], dtype="float64")

    return df.withColumn(out_col, F.pandas_udf(run, "double")(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; learns only
    from the labels of the training fold and only from texts. Repeated rows get
    equal scores; with no labels every score is about 0."""
    model = fit(docs, labels)
    rows = docs.select("doc_id", F.col("text").alias("text"))
    return score(rows, model).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents scored at ``threshold`` or more, columns unchanged, whatever they are called."""
    name = unused("score", docs.columns)
    return score(docs, model, out_col=name).where(F.col(name) < threshold).select(*docs.columns)
