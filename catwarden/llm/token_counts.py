"""Token counts from an exact length histogram.

Each whole text is encoded once (byte-level BPE ranks of a vocabulary file);
documents are then aggregated by encoded length. The histogram has one row for
each distinct length, however many documents there are, and suffix sums over it
answer, for every context limit L at once and exactly: how many documents are
longer, how many tokens they hold, how many tokens remain when every document
is truncated to L, and which length is a given quantile.

The sums over the histogram are two-level (buckets of lengths, then lengths
inside a bucket), so no task has to hold all lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import written

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUCKET = 256

_encoders: dict = {}


def _encoder(raw: bytes, pattern: str, key: str):
    if key not in _encoders:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        _encoders.clear()
        _encoders[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def with_token_counts(df: DataFrame, ranks: str = DEFAULT_RANKS, pattern: str | None = None,
                      text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each whole text. Null and empty
    texts have 0. Other columns pass through; ``out_col`` is replaced if there."""
    import hashlib

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    raw = open(ranks, "rb").read()
    shared, key = df.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw + pattern.encode()).hexdigest()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(shared.value, pattern, key)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return df.withColumn(out_col, F.pandas_udf(run, "bigint")(F.col(text_col)))


def histogram(counted: DataFrame, col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs): a partial aggregate, one row for each length and task in the shuffle."""
    return counted.groupBy(F.col(col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L of the histogram:

    ``n_docs``, ``docs_over`` (documents longer than L), ``tokens_upto`` (all
    tokens of documents of at most L), ``tokens_over`` (of longer ones),
    ``truncated`` (tokens left when each document is cut to L) and
    ``docs_upto``. Lengths between two rows need no rows of their own: with L0
    the next smaller length present, truncated(L) = truncated(L0) + (L - L0) *
    docs_over(L0). An empty histogram gives no rows.
    """
    h = hist.withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    falling = Window.orderBy(F.col("bucket").desc())
    after = falling.rowsBetween(Window.unboundedPreceding, -1)
    everything = falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_bucket = (h.groupBy("bucket").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
                  # one row for each 256 lengths: the longest text's length / 256 rows
                  .select("bucket", F.sum("bd").over(everything).alias("all_docs"), F.sum("bt").over(everything).alias("all_tokens"),
                          F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("bd_over"),
                          F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("bt_over")))
    inside = Window.partitionBy("bucket").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    s = (h.join(per_bucket, "bucket")
         .withColumn("docs_over", F.col("bd_over") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
         .withColumn("tokens_over", F.col("bt_over") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))))
    return s.select(
        "n_tokens", "n_docs", "docs_over", "tokens_over",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_upto"),
        (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_upto"),
        (F.col("all_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share ``q`` of the documents do not exceed (one row, null if empty)."""
    return (sums.where(F.col("docs_upto") >= F.ceil(F.lit(q) * (F.col("docs_upto") + F.col("docs_over"))))
            .agg(F.min("n_tokens").alias("n_tokens")))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut to ``limit`` (one row)."""
    return sums.agg(F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated"))


def token_report(counted: DataFrame, col: str = "n_tokens") -> DataFrame:
    """One row for each distinct length, with its suffix sums. The histogram is
    written, as the sums read it twice and texts should be encoded once."""
    return suffix_sums(written(histogram(counted, col), "histogram"))
