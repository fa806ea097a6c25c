"""Language of words and texts: a linear-chain conditional random field.

Every word is labelled with a language. Its emission is the sum of the learned
weights of its features: character n-grams of the word between start and end
marks (those that hold a mark are its affixes), the word as a whole, and whether
it is in the lexicon of a language. A learned transition matrix joins the words
of a line. Marginals come from forward-backward, scaled, for all lines of a
batch at once; the language of a text is the one with the highest sum of its
words' marginals, so code-switched texts keep their word labels
(``word_runs``) and go to their main language.

Training (numpy, on the driver, over a bounded sample: ``TEXTS`` texts a
language of up to ``CHARS`` characters, chosen by hash order outside the
held-out fold): the words of a text carry the text's language; sequences of 32
words are cut, and in a quarter of them the second half comes from another
text, so that transitions learn that languages switch. Gradients are observed
minus expected counts, steps are Adagrad.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if no language was learned. The score is the mean marginal of
the predicted language over the words; ties go to the language first in order.
Repeated rows get equal results, and an id given several times counts once in
training (smallest text and language). Other columns pass through; columns
called as the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import is_held_out, kept_in_worker, unused, written

TEXTS = 250
CHARS = 6_000
BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
LEXICON = 3  # occurrences in the sample that put a word into a language's lexicon
SPAN = 32
EPOCHS = 20
MEMO = 300_000
BATCH_CHARS = 2_000_000
FEW_LANGUAGES = 10_000  # so many counts are broadcast; more are joined by a shuffle
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, start of each word's features): hashes of the n-grams
    of ``^word$`` and of the whole word, for all words at once."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    room = ends[owner] - np.arange(len(codes))  # characters from here to the word's end
    ids, own = [], []
    mixed = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        step = np.zeros_like(codes)
        step[:len(codes) - n + 1] = codes[n - 1:]
        mixed = (mixed ^ step) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if n in GRAMS:
            fits = room >= n
            ids.append(mixed[fits] + np.uint64(n))
            own.append(owner[fits])
    place = np.arange(len(codes)) - (ends - size)[owner]
    odd = place.astype(np.uint64) * np.uint64(2) + np.uint64(1)
    whole = np.add.reduceat((codes + np.uint64(1)) * (odd * np.uint64(0xD6E8FEB86659FD93)), ends - size)
    ids.append(whole ^ (whole >> np.uint64(32)))
    own.append(np.arange(len(words)))
    ids, own = np.concatenate(ids), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[order], np.arange(len(words)))
    ids = (ids[order] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(buckets).bit_length() + 1)
    return ids.astype(np.int64), starts


class Lines:
    """Word sequences of different lengths, time by time: at time t the rows of
    all lines longer than t stand together, the longest lines first."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), dtype=np.int64)
        rank[order] = np.arange(len(lengths))
        top = int(lengths.max()) if len(lengths) else 0
        self.live = len(lengths) - np.cumsum(np.bincount(lengths, minlength=top + 1))[:top] if top else np.zeros(0, dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.live)]).astype(np.int64)
        time = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.at[time] + np.repeat(rank, lengths)  # of each word, in order


def forward_backward(lines: Lines, emit: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """(marginals, expected transitions, log partition) of words given in time
    order. ``emit``: log weights of each word and label."""
    k = emit.shape[1]
    high = emit.max(axis=1, keepdims=True) if len(emit) else emit[:, :1]
    e, m = np.exp(emit - high), np.exp(trans)
    fwd, bwd, scale = np.empty_like(e), np.ones_like(e), np.empty(len(e))
    at = lines.at
    for t, n in enumerate(lines.live):
        now = slice(at[t], at[t] + n)
        a = e[now] * (np.exp(start) if t == 0 else fwd[at[t - 1]:at[t - 1] + n] @ m)
        s = a.sum(axis=1)
        scale[now] = s
        fwd[now] = a / s[:, None]
    expected = np.zeros((k, k))
    for t in range(len(lines.live) - 1, 0, -1):
        n = lines.live[t]
        now, before = slice(at[t], at[t] + n), slice(at[t - 1], at[t - 1] + n)
        right = e[now] * bwd[now] / scale[now][:, None]
        bwd[before] = right @ m.T
        expected += fwd[before].T @ right
    return fwd * bwd, expected * m, float((np.log(scale) + high[:, 0]).sum()) if len(e) else 0.0


@dataclass
class Model:
    """``weights``: (buckets, languages); ``lexicon``: word to a bit set of languages."""

    langs: list[str]
    weights: np.ndarray
    lex_weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]
    memo: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)
    table: np.ndarray | None = None

    def emissions(self, words: list[str]) -> np.ndarray:
        ids, starts = features(words, len(self.weights))
        out = np.add.reduceat(self.weights[ids], starts, axis=0) if len(words) else np.zeros((0, len(self.langs)))
        return out.astype(np.float64) + self.known(words) @ self.lex_weights

    def known(self, words: list[str]) -> np.ndarray:
        bits = np.array([self.lexicon.get(w, 0) for w in words], dtype=object)
        return np.array([[b >> j & 1 for j in range(len(self.langs))] for b in bits], dtype=np.float64).reshape(len(words), len(self.langs))

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Rows of ``self.table`` of each word; -1: it has no letter."""
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.table = None
        memo = self.memo
        got = list(map(memo.get, words))
        if None in got:
            new = list(dict.fromkeys(w for w, at in zip(words, got) if at is None))
            told = [w for w in new if any(map(str.isalpha, w))]
            have = 0 if self.table is None else len(self.table)
            memo.update((w, -1) for w in new)
            memo.update(zip(told, range(have, have + len(told))))
            parts = [self.emissions(told[i:i + 20_000]) for i in range(0, len(told), 20_000)]
            self.table = np.concatenate([*([] if self.table is None else [self.table]), *parts, np.zeros((0, len(self.langs)))])
            got = list(map(memo.__getitem__, words))
        return np.array(got, dtype=np.int64)

    def marginals(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of all words that have a letter, which words those are)."""
        words = [w for line in lines for w in line]
        rows = self.word_rows(words)
        told = rows >= 0
        owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        by_time = Lines(np.bincount(owner[told], minlength=len(lines)).astype(np.int64))
        emit = np.empty((int(told.sum()), len(self.langs)))
        if len(emit):
            emit[by_time.place] = self.table[rows[told]]
        got, _, _ = forward_backward(by_time, emit, self.trans, self.start)
        return got[by_time.place], told

    def languages(self, texts: list[str | None]) -> list[tuple[str, float]]:
        lines, owner = [], []
        for i, t in enumerate(texts):
            for line in (t or "").lower().split("\n"):
                found = _WORD.findall(line)
                if found:
                    lines.append(found)
                    owner.append(i)
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not lines or not self.langs:
            return out
        got, told = self.marginals(lines)
        text = np.repeat(np.array(owner), [len(x) for x in lines])[told]
        n = np.bincount(text, minlength=len(texts))
        sums = np.stack([np.bincount(text, weights=got[:, j], minlength=len(texts)) for j in range(len(self.langs))], axis=1)
        best = sums.argmax(axis=1)
        for i in np.flatnonzero(n):
            out[i] = (self.langs[best[i]], float(min(1.0, sums[i, best[i]] / n[i])))
        return out

    def runs(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) of runs of words of one language."""
        spots, lines, at = [], [], 0
        for line in (text or "").split("\n"):
            found = list(_WORD.finditer(line))
            if found:
                lines.append([m[0].lower() for m in found])
                spots += [(m.start() + at, m.end() + at) for m in found]
            at += len(line) + 1
        if not lines or not self.langs:
            return []
        got, told = self.marginals(lines)
        out: list[tuple[int, int, str]] = []
        for (a, b), j in zip([s for s, x in zip(spots, told) if x], got.argmax(axis=1)):
            if out and out[-1][2] == self.langs[j]:
                out[-1] = (out[-1][0], b, self.langs[j])
            else:
                out.append((a, b, self.langs[j]))
        return out


def train(texts: list[tuple[str, str]], epochs: int = EPOCHS, rate: float = 0.3, l2: float = 1e-4, seed: int = 11) -> Model:
    """A field from (text, language) rows."""
    langs = sorted({y for _, y in texts})
    k = len(langs)
    empty = Model(langs, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros((k, k)), np.zeros(k), {})
    docs = [(w, langs.index(y)) for t, y in texts if (w := [x for x in _WORD.findall(t.lower()) if any(map(str.isalpha, x))])]
    if not docs:
        return empty
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in words]) for words, _ in docs]
    seen = np.zeros((len(vocab), k), dtype=np.int64)
    for w, (_, y) in zip(ids, docs):
        np.add.at(seen[:, y], w, 1)
    names = list(vocab)
    lexicon = {names[i]: sum(1 << int(j) for j in np.flatnonzero(row >= LEXICON)) for i, row in enumerate(seen) if (row >= LEXICON).any()}
    model = Model(langs, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros((k, k)), np.zeros(k), lexicon)

    rng = np.random.default_rng(seed)
    spans = [(w[i:i + SPAN], y) for w, (_, y) in zip(ids, docs) for i in range(0, len(w), SPAN)]
    words, tags = [], []
    for w, y in spans:
        if len(w) == SPAN and rng.random() < 0.25:
            other, z = spans[rng.integers(len(spans))]
            w, tag = np.concatenate([w[:SPAN // 2], other[:SPAN // 2]]), np.array([y] * (SPAN // 2) + [z] * len(other[:SPAN // 2]))
        else:
            tag = np.full(len(w), y)
        words.append(w)
        tags.append(tag)
    lines = Lines(np.array([len(w) for w in words]))
    word, tag = np.empty(len(lines.place), dtype=np.int64), np.empty(len(lines.place), dtype=np.int64)
    word[lines.place], tag[lines.place] = np.concatenate(words), np.concatenate(tags)
    first = slice(0, int(lines.live[0]))
    observed = np.zeros((k, k))
    for t in range(1, len(lines.live)):
        n, at, before = lines.live[t], lines.at[t], lines.at[t - 1]
        np.add.at(observed, (tag[before:before + n], tag[at:at + n]), 1)

    feats, starts = features(names)
    owner = np.repeat(np.arange(len(names)), np.diff(np.append(starts, len(feats))))
    lex = model.known(names)
    total = len(word)
    steps = [np.full_like(x, 1e-8) for x in (model.weights, model.lex_weights, model.trans, model.start)]
    for _ in range(epochs):
        by_word = np.add.reduceat(model.weights[feats], starts, axis=0) + lex @ model.lex_weights
        got, expected, _ = forward_backward(lines, by_word[word], model.trans, model.start)
        got = -got
        got[np.arange(total), tag] += 1
        per_word = np.stack([np.bincount(word, weights=got[:, j], minlength=len(names)) for j in range(k)], axis=1)
        g = [np.stack([np.bincount(feats, weights=per_word[owner, j], minlength=BUCKETS) for j in range(k)], axis=1),
             lex.T @ per_word, observed - expected, got[first].sum(axis=0)]
        for x, dx, s in zip((model.weights, model.lex_weights, model.trans, model.start), g, steps):
            dx = dx / total - l2 * x
            s += dx * dx
            x += rate * dx / np.sqrt(s)
    return model


def sample(docs: DataFrame, texts: int = TEXTS, chars: int = CHARS) -> DataFrame:
    """(text, lang): at most ``texts`` documents of each language outside the
    held-out fold, of up to ``chars`` characters, in hash order of their ids.
    Ids are chosen on (id, language) alone; the chosen ones are broadcast."""
    fit = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text").alias("_text")).where(
        F.col("_lang").isNotNull() & (F.length("_text") <= chars) & ~is_held_out(F.col("_id")))
    ids = written(fit.groupBy("_id").agg(F.min("_lang").alias("_lang")), "lang-ids")
    # hashes are even, so those below four times the wanted share hold the smallest `texts` of a language, and
    # no task gets more than that of a language that most documents have
    counts = written(ids.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")), "lang-counts")
    few = counts.count() <= FEW_LANGUAGES
    share = (F.xxhash64("_id").cast("double") + 2.0 ** 63) / 2.0 ** 64
    near = ids.join(F.broadcast(counts) if few else counts, "_lang").where(share * F.col("_n") <= 4.0 * max(texts, 50)).select("_id", "_lang")
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    picked = written(near.withColumn("_k", rank).where(F.col("_k") <= texts).drop("_k"), "lang-sample")
    return (fit.join(F.broadcast(picked), ["_id", "_lang"]).groupBy("_id", "_lang").agg(F.min("_text").alias("text"))
            .orderBy("_id").select("text", F.col("_lang").alias("lang")))


def fit(docs: DataFrame, texts: int = TEXTS, chars: int = CHARS) -> Model:
    return train([(r["text"], r["lang"]) for r in sample(docs, texts, chars).collect()])


FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def _shared(df: DataFrame, model: Model):
    parts = (model.langs, model.weights.astype(np.float32), model.lex_weights, model.trans, model.start, model.lexicon)
    digest = hashlib.sha256(model.weights.tobytes() + model.trans.tobytes() + repr(model.langs).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast(parts), digest


def _bounded(texts, chars: int = BATCH_CHARS) -> Iterator[list]:
    part, n = [], 0
    for t in texts:
        if part and n + len(t or "") > chars:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t or "")
    if part:
        yield part


def identify(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``df`` with the language of each whole text and its score."""
    shared, key = _shared(df, model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = kept_in_worker(key, lambda: Model(*shared.value))
        for texts in batches:
            yield pd.DataFrame([x for part in _bounded(texts) for x in m.languages(part)], columns=["lang_pred", "score"])

    made = unused("found", [*df.columns, lang_col, score_col])
    return (df.withColumn(made, F.pandas_udf(run, FOUND)(F.col(text_col)))
            .withColumn(lang_col, F.col(made)["lang_pred"]).withColumn(score_col, F.col(made)["score"]).drop(made))


def word_runs(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "runs") -> DataFrame:
    """``df`` with the runs of words of one language (start, end exclusive, in
    code points): where a code-switched text changes its language."""
    shared, key = _shared(df, model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = kept_in_worker(key, lambda: Model(*shared.value))
        for texts in batches:
            yield pd.Series([m.runs(t) for t in texts], dtype=object)

    return df.withColumn(out_col, F.pandas_udf(run, RUNS)(F.col(text_col)))
