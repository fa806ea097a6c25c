"""Exact dedup: a heavy-hitter split in front of an ordinary shuffle.

Texts are equal when identical after lower-casing A-Z. The text is read once
and reduced to (doc_id, SHA-256 digest); the rest works on that narrow table:

1. A Misra-Gries summary (Spark's frequent-items sketch: at most ``counters``
   counters a task, merged in two levels) names the digests that may hold more
   than one in ``heavy`` of all rows.
2. The candidates are verified: exact count and largest doc_id of each, by a
   partial aggregate that ships one row per candidate and task.
3. These verified winners, at most ``heavy`` rows and so of a fixed size, are
   broadcast; rows of the hot digests are settled map-side, without a shuffle.
4. The remaining digests are aggregated and joined in an ordinary shuffle. No
   remaining digest holds more than a sliver of the rows, so none is hot.

Every row is returned, dropped ones too. Nothing is sampled: the summary only
routes rows, both routes give exact answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, hex_sha256, unused, written

COUNTERS = 16_384
HEAVY = 1_024
GROUPS = 256


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id (largest doc_id among equal
    texts), group_size, kept, text_sha256.

    Null text counts as empty, and empty texts are equal to each other. A row
    given twice under one doc_id is two rows of its group and both are marked
    kept if that id is the largest. A null doc_id never wins over a number; a
    group of only null ids keeps all its rows (keep_id null). An empty table
    gives an empty result. Other columns of the input are not looked at.
    """
    narrow = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.unhex(hex_sha256(normalised(F.col(text_col)))).alias("digest"))
    d = written(narrow, "exact-digests")

    # Frequent-items sketches (Misra-Gries with purging) of every task, merged in GROUPS groups and then into one;
    # a summary of m counters errs by at most 3.5 n / m. The 16-character heads only route rows: two digests
    # that share one merely travel together.
    head = F.substring(F.base64(F.col("digest")), 1, 16)
    states = (d.select(head.alias("head"), (F.spark_partition_id() % GROUPS).alias("part"))
              .groupBy("part").agg(F.expr(f"approx_top_k_accumulate(head, {counters})").alias("state")))
    # a grouping key, as tasks without rows have no sketch to give
    top = states.groupBy(F.col("part") >= 0).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(state, {counters}), {heavy})").alias("top"))
    floor = max(2, d.count() // heavy)
    frequent = top.select(F.explode("top").alias("t")).where(F.col("t.count") >= floor).select(F.col("t.item").alias("head"))
    candidates = F.broadcast(written(frequent, "exact-frequent"))  # at most `heavy` rows of 16 characters

    winners = written(
        d.withColumn("head", head).join(candidates, "head", "left_semi")
        .groupBy("head", "digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= floor // 2)
        .select("digest", "keep_id", "group_size"), "exact-winners")
    # every winner holds at least floor / 2 rows, so there are at most 2 n / floor (about 2 * heavy) of them
    settled = d.join(F.broadcast(winners), "digest", "left").withColumn("hot", F.col("group_size").isNotNull())

    hot = settled.where("hot").select("doc_id", "digest", "keep_id", "group_size")
    rest = settled.where("not hot").select("doc_id", "digest")
    groups = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    cold = rest.join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size")

    return hot.unionByName(cold).select(
        "doc_id", "keep_id", "group_size",
        F.expr("doc_id <=> keep_id").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay (those that ``exact_groups`` marks kept),
    with all their columns, whatever their names. A row is found again by its id
    and its text's digest: an id that is given with a kept and a dropped text
    keeps the former only, and a null id stays only where its group has no
    other. Null and empty texts are equal; rows repeated under the id that
    stays all stay."""
    key, mark, same = (unused(x, docs.columns) for x in ("kept_id", "kept_digest", "digest"))
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(mark)).distinct()
    marked = docs.withColumn(same, hex_sha256(normalised(F.col(text_col))))
    return marked.join(kept, (F.col(same) == F.col(mark)) & F.col(id_col).cast("bigint").eqNullSafe(F.col(key)), "left_semi").drop(same)
