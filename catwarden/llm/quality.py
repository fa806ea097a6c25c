"""Quality: cumulative-link (proportional odds) regression on graded ratings.

A text is a bag of hashed features (words, pairs of neighbouring words, word
shapes, repeats of the word before), scaled to unit length. All grades share one
weight vector; ordered thresholds cut the line into grades:

    P(grade > k) = sigmoid(w . x - theta_k),  theta_0 <= theta_1 <= ...

which gives the expected grade and, for selection, the tail probability of a
grade or better. Trained in numpy on a bounded sample of rated rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import is_held_out, labelled_sample

BUCKETS = 1 << 17
#: Bound of the training sample: rows of each grade, and characters of a text.
TRAIN_PER_GRADE = 1_000
TRAIN_CHARS = 6_000
EPOCHS = 200
L2 = 1e-5
MEMO = 300_000

_TOKEN = re.compile(r"\S+")
# linear in the token, so that long ones are taken whole
_SHAPES = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "9"))

SCORE_SCHEMA = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType())])

_memo: dict[str, tuple[int, int]] = {}


def _token(tok: str) -> tuple[int, int]:
    """Buckets of a token's lower-cased form and of its shape."""
    got = _memo.get(tok)
    if got is None:
        shape = tok
        for rx, to in _SHAPES:
            shape = rx.sub(to, shape)
        got = zlib.crc32(tok.lower().encode()) % BUCKETS, zlib.crc32(b"\0" + shape.encode()) % BUCKETS
        if len(tok) <= 64:
            if len(_memo) >= MEMO:
                _memo.clear()
            _memo[tok] = got
    return got


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets and their weights (log counts, unit length)."""
    toks = _TOKEN.findall(text) if text else []
    if not toks:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    pair = np.array([_token(t) for t in toks], dtype=np.int64)
    word, shape = pair[:, 0], pair[:, 1]
    again = word[1:] == word[:-1]
    both = (word[:-1] * 1_000_003 + word[1:]) % BUCKETS
    # shape and repetition are shares of the text, so they count by their number and not by their variety
    ids, counts = np.unique(np.concatenate((word, both)), return_counts=True)
    sid, scount = np.unique(np.concatenate((shape, np.full(int(again.sum()), 7))), return_counts=True)
    w = np.log1p(counts)
    w = w / np.sqrt((w * w).sum())
    share = 4.0 * scount / len(toks)
    all_ids = np.concatenate((ids, sid))
    all_w = np.concatenate((w, share))
    uniq, inv = np.unique(all_ids, return_inverse=True)
    return uniq, np.bincount(inv, all_w).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def over(self, x: float) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(-np.clip(x - self.thresholds, -500, 500)))

    def line(self, text: str | None) -> float:
        ids, w = features(text)
        return float(self.weights[ids] @ w) if len(ids) else 0.0


def train(texts: list[str | None], grades: np.ndarray, n_grades: int, epochs: int = EPOCHS) -> Model:
    """Maximum likelihood by Adam on the shared weights and on the thresholds
    (first one and logs of the gaps, so they stay ordered). Grades that have no
    rows keep a threshold next to their neighbour's; with no rows at all every
    tail probability is 0.5."""
    k = n_grades - 1
    grades = np.asarray(grades, dtype=np.int64)
    if len(grades) == 0:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(k))
    feats = [features(t) for t in texts]
    doc = np.repeat(np.arange(len(feats)), [len(i) for i, _ in feats])
    ids = np.concatenate([i for i, _ in feats])
    val = np.concatenate([w for _, w in feats])
    used, ids = np.unique(ids, return_inverse=True)
    n = len(grades)
    share = np.array([np.clip((grades > j).mean(), 1e-3, 1 - 1e-3) for j in range(k)])
    first = -np.log(share / (1 - share))
    a = np.concatenate(([first[0]], np.log(np.maximum(np.diff(first), 1e-2))))  # threshold, log gaps
    w = np.zeros(len(used))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)]
    for t in range(1, epochs + 1):
        theta = a[0] + np.concatenate(([0.0], np.cumsum(np.exp(a[1:]))))
        x = np.bincount(doc, w[ids] * val, minlength=n)
        over = 1 / (1 + np.exp(-np.clip(x[:, None] - theta, -500, 500)))  # n x k
        full = np.concatenate((np.ones((n, 1)), over, np.zeros((n, 1))), axis=1)
        p = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-9)
        slope = full * (1 - full)
        up, down = slope[np.arange(n), grades] / p, slope[np.arange(n), grades + 1] / p
        gx = -(up - down) / n
        gtheta = np.zeros(k + 2)
        np.add.at(gtheta, grades, up / n)
        np.add.at(gtheta, grades + 1, -down / n)
        gtheta = gtheta[1:-1]
        ga = np.concatenate(([gtheta.sum()], [np.exp(a[j]) * gtheta[j:].sum() for j in range(1, k)]))
        gw = np.bincount(ids, gx[doc] * val, minlength=len(used)) + L2 * w
        for v, g, m, s, lr in ((w, gw, state[0], state[1], 0.05), (a, ga, state[2], state[3], 0.05)):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= lr * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    theta = a[0] + np.concatenate(([0.0], np.cumsum(np.exp(a[1:]))))
    return Model(weights, theta)


def training_rows(docs: DataFrame, ratings: DataFrame, n_grades: int,
                  per_grade: int = TRAIN_PER_GRADE, chars: int = TRAIN_CHARS) -> DataFrame:
    """The bounded training sample from ``ratings`` (doc_id, grade): by hash
    order, at most ``per_grade`` rows of each grade outside the held-out fold."""
    known = (ratings.select(F.col("doc_id").alias("_id"), F.col("grade").cast("int").alias("grade"))
             .where(F.col("grade").between(0, n_grades - 1) & ~is_held_out(F.col("_id")))
             .groupBy("_id").agg(F.max("grade").alias("y")))
    return labelled_sample(docs, known, dict.fromkeys(range(n_grades), per_grade), chars)


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, **kw) -> Model:
    rows = training_rows(docs, ratings, n_grades, **kw).toPandas()  # bounded: rows and characters
    return train(rows["text"].tolist(), rows["y"].to_numpy(dtype=np.int64), n_grades)


def grade(df: DataFrame, model: Model, min_grade: int, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """``df`` with a struct: expected_grade and tail = P(grade >= min_grade) of
    each whole text. Null and empty texts get the values of an empty bag. Other
    columns pass through."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            x = np.array([m.line(t) for t in texts], dtype=np.float64)
            over = 1 / (1 + np.exp(-np.clip(x[:, None] - m.thresholds, -500, 500)))
            yield pd.DataFrame({"expected_grade": over.sum(axis=1), "tail": over[:, min_grade - 1]})

    return df.withColumn(out_col, F.pandas_udf(run, SCORE_SCHEMA)(F.col(text_col)))


def ratings_of(labels: DataFrame) -> DataFrame:
    """Three grades from the label table: 0 low quality, 1 of good quality but
    toxic, 2 of good quality and clean."""
    return labels.where(F.col("quality").isin(0, 1)).select(
        "doc_id", (F.col("quality") * (F.lit(2) - F.coalesce("toxic", F.lit(0)))).alias("grade"))


def quality(docs: DataFrame, labels: DataFrame, min_grade: int = 1, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, score (P(grade >= min_grade)) and kept
    for each row of ``docs``. Repeated rows get equal values."""
    model = fit(docs, ratings_of(labels), 3)
    graded = grade(docs.select("doc_id", "text"), model, min_grade)
    return graded.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("quality.expected_grade").alias("expected_grade"),
        F.col("quality.tail").alias("score"), (F.col("quality.tail") >= threshold).alias("kept"))
