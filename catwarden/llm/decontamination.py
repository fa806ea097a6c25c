"""Benchmark decontamination with one Aho-Corasick automaton.

Test items (questions and answers) and documents are normalised alike: A-Z
lower-cased, words are runs of letters, digits and non-ASCII characters. Every
window of ``window`` consecutive item words (the whole item if it is shorter)
is a pattern; all patterns of a block go into one automaton, and each text is
scanned once. Match ends are mapped to words and from there to offsets in the
original text.

The patterns are bounded: test items are gathered block by block, each block at
most ``block_bytes`` of item text (one block for any ordinary benchmark), and a
benchmark of several blocks is scanned once for each and its hits are united
word by word, so the number of blocks changes nothing in the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import kept_in_worker, unused

WINDOW = 13
BLOCK_BYTES = 8 << 20

# bytes that belong to words after lower-casing: 0-9, a-z and all of UTF-8's non-ASCII bytes
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

HIT_SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def item_windows(text: str | None, window: int = WINDOW) -> set[bytes]:
    words = normal_words(text)
    if not words:
        return set()
    return {b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))}


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW):
    """Automaton over the windows; a pattern's value: (its words, ids of its items, None among them)."""
    import ahocorasick

    owners: dict[bytes, set[str | None]] = {}
    for item, text in items:
        for w in item_windows(text, window):
            owners.setdefault(w, set()).add(item)
    a = ahocorasick.Automaton()
    for w, ids in owners.items():
        # latin-1 gives each byte a character, so offsets are byte offsets
        a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(ids)))
    if owners:
        a.make_automaton()
    return a if owners else None


def scan(automaton, text: str | None) -> tuple[int, np.ndarray, set[str | None]]:
    """Number of words, the indexes of hit words, items with an occurring window."""
    words = normal_words(text)
    none = np.zeros(0, dtype=np.int64)
    if automaton is None or not words:
        return len(words), none, set()
    joined = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(joined.decode("latin-1")))
    if not found:
        return len(words), none, set()
    # a match ends on the blank after its last word: as many blanks before it as words up to there
    blanks = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    last = np.searchsorted(blanks, np.array([end for end, _ in found])) - 1
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(mark, last - np.array([v[0] for _, v in found]) + 1, 1)
    np.add.at(mark, last + 1, -1)
    return len(words), np.flatnonzero(np.cumsum(mark)[:-1] > 0), {i for _, v in found for i in v[1]}


def word_points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, in code points of the original text."""
    raw = text.encode()
    byte = np.frombuffer(raw, dtype=np.uint8)
    word = np.frombuffer(raw.translate(_TABLE), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    point = np.concatenate(([0], np.cumsum((byte & 0xC0) != 0x80)))  # code points before each byte
    return point[np.flatnonzero(edge == 1)], point[np.flatnonzero(edge == -1)]


def word_spans(text: str, wanted: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end) in code points of the original text."""
    starts, ends = word_points(text)
    runs = np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1)
    return [(int(starts[r[0]]), int(ends[r[-1]])) for r in runs if len(r)]


def _blocks(spark: SparkSession, items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The items, each block at most about ``block_bytes`` of text on the driver."""
    it = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = it.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(total) * 2 // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        part = it if n == 1 else it.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in part.collect()]


def _scanner(shared, key: str, window: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = kept_in_worker(key, lambda: build(shared.value, window))
        for texts in batches:
            rows = []
            for t in texts:
                n, where, ids = scan(automaton, t)
                spans = word_spans(t, where) if len(where) else []
                rows.append((n, len(where), len(ids), sorted(ids - {None}), [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items", "spans"])

    return F.pandas_udf(run, HIT_SCHEMA)


def hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, out_col: str = "hit") -> DataFrame:
    """``docs`` with a struct column ``out_col``: n_words, n_hit, n_items, items
    (ids as strings, sorted), spans of the original text.

    Null and empty texts have no words and no hits; items without words give
    no pattern; repeated items count once by id. Items without an id hit like
    all others and count as one item in n_items, but add no id to items. Other
    columns of ``docs`` pass through; a column ``out_col`` of its own is replaced.
    """
    spark = docs.sparkSession
    out = docs
    parts = []
    for block in _blocks(spark, items, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        key = hashlib.sha256(repr((window, sorted(block, key=repr))).encode()).hexdigest()

        parts.append(_scanner(shared, key, window))
    if len(parts) == 1:
        return out.withColumn(out_col, parts[0](F.col(text_col)))
    names = [unused(f"hit{k}", docs.columns) for k in range(len(parts))]
    for name, udf in zip(names, parts):
        out = out.withColumn(name, udf(F.col(text_col)))
    return _united(out, names, text_col, out_col)


def _united(out: DataFrame, names: list[str], text_col: str, out_col: str) -> DataFrame:
    """Hits of several blocks as one: ids united, hit words united and then joined to spans."""
    cols = [F.col(name) for name in names]

    @F.pandas_udf(HIT_SCHEMA)
    def unite(texts: pd.Series, spans: pd.Series, items: pd.Series, unnamed: pd.Series) -> pd.DataFrame:
        rows = []
        for t, sp, it, more in zip(texts, spans, items, unnamed):
            ids, wanted = sorted(set(it)), np.zeros(0, dtype=np.int64)
            if len(sp):
                starts, ends = word_points(t)
                mark = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(mark, np.searchsorted(starts, [x["start"] for x in sp]), 1)
                np.add.at(mark, np.searchsorted(ends, [x["end"] for x in sp]) + 1, -1)
                wanted = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            merged = word_spans(t, wanted) if len(wanted) else []
            rows.append((len(normal_words(t)), len(wanted), len(ids) + int(more), ids, [{"start": a, "end": b} for a, b in merged]))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items", "spans"])

    spans = F.concat(*[c["spans"] for c in cols])
    items = F.concat(*[c["items"] for c in cols])
    unnamed = F.greatest(*[c["n_items"] - F.size(c["items"]) for c in cols])  # 1 if an item without an id hits
    return out.withColumn(out_col, unite(F.col(text_col), spans, items, unnamed)).drop(*[n for n in names if n != out_col])


def contaminated(hit=None):
    """At least one hit word, and at least 5 % of the words hit."""
    h = F.col("hit") if hit is None else hit
    return (h["n_hit"] > 0) & (20 * h["n_hit"] >= h["n_words"])


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, columns unchanged, whatever they are called."""
    name = unused("hit", docs.columns)
    return hits(docs, items, text_col, out_col=name).where(~contaminated(F.col(name))).select(*docs.columns)
