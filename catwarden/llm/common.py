"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(c, UPPER, LOWER)


def unused(name: str, taken: list[str]) -> str:
    """``name``, or with underscores in front if a column of ``taken`` is called so (case aside)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def hex_sha256(c: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(c, 256)


def is_held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: crc32(doc_id as text) mod 5 = 0
    (a null id counts as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/catwarden-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared checkpoint
    folder (computed once, readable by every executor, pruned on reread) and
    return the reread table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no later step reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/catwarden-llm/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


_kept: dict = {}


def kept_in_worker(key: str, make: Callable[[], object]):
    """What ``make`` gives, kept for later tasks of this worker process. Only
    the value last asked for is kept: a worker that runs one operator after
    another holds the tables of one."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Rows of an Arrow batch, for texts of very different lengths: lowered
    where the session asks for more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def labelled_sample(docs: DataFrame, known: DataFrame, classes: dict[int, int], chars: int) -> DataFrame:
    """(text, y): a bounded sample of the labelled documents, by hash order: at
    most ``classes[y]`` ids of each class, of texts up to ``chars`` characters.

    Ids are chosen on (id, length) alone, so no text is shuffled; the chosen
    ids, whose number is bounded by ``classes``, are then broadcast.
    ``known``: (_id, y), one row an id. An id given several times has its
    smallest text taken.
    """
    sized = (docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
             .where(F.col("size") <= chars).select("_id").distinct().join(known, "_id"))
    picked = None
    for y, most in classes.items():
        part = sized.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= chars)
    return (texts.join(F.broadcast(written(picked, "sample")), "_id")
            .groupBy("_id", "y").agg(F.min("text").alias("text")).orderBy("_id").select("text", "y"))
