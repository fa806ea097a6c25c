"""A corpus pipeline of the operators in ``catwarden.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; between stages the rows are written as Parquet and reread, so a lost
executor costs at most the stage it was in. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catwarden.llm import decontamination, line_dedup, minhash_dedup, sentencepiece_codec, toxicity
from catwarden.llm.common import unused, written
from catwarden.llm.queries import prepare, table

SHINGLE_WORDS = 4  # of near_dedup: as in op5_near_dedup


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the model is trained on the labelled documents of the corpus."""
    prepare(spark)
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.remove_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted from the texts; n_chars follows. A document that is left
    without a word was a copy as a whole and goes; one that had no word before stays."""
    prepare(spark)
    lines, gone = unused("line_count", docs.columns), unused("lines_deleted", docs.columns)
    left = line_dedup.dedup_lines(docs, count_col=lines, gone_col=gone)
    emptied = (F.col(gone) > 0) & (F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")) == "")
    return left.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("bigint"))
                           .otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    prepare(spark)
    return minhash_dedup.keep_one(docs, size=SHINGLE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    prepare(spark)
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each text, checked by decoding them."""
    prepare(spark)
    coded = sentencepiece_codec.encode_checked(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: The classifier and the tokenizer have no SQL form; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
