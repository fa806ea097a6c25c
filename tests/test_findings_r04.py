"""Findings of round 4 on size: the text of a schema is sorted some sections at a time, numbered where it lies, and
neither shuffles nor unsorted copies stay behind."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from catwarden.operators import schema_text as T
from catwarden.sources import fixtures as X

from .catalog_builder import DDL, build


def _fleet(spark):
    """A database over many ranges, names that come twice, one without tables, one without a number."""
    big, twice, none, lost = DDL(1), DDL(2), DDL(3), DDL(None)
    for i in range(300):
        big.table(f"t{i}" if i % 2 else f"T{i}", ("ID", "BOOLEAN"), ("N", f"VARCHAR({i + 1})")).pk(f"T{i}", f"PK{i}", "ID").index(f"T{i}", f"IX{i}", ["N"])
        big.routine("PROCEDURE", f"P{i}", f"AS BEGIN EXECUTE PROCEDURE P{i // 2}(1); END").routine("FUNCTION", f"F{i}", "" if i % 5 else "AS BEGIN END")
    for kind in ("BOOLEAN", "INT128", "BOOLEAN"):
        twice.table("A", ("X", kind)).index("A", "IX", ["X"]).routine("TRIGGER", "TR", f"AS BEGIN /* {kind} */ END")
    lost.table("A", ("X", "INTEGER"))
    twice.rows["databases"] *= 2
    return build(spark, big, twice, none, lost)


def _files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}


def _copies(spark) -> set[str]:
    at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {d for d in os.listdir(f"{at}/catwarden-rows") if sum(len(f) for _, _, f in os.walk(f"{at}/catwarden-rows/{d}"))} if os.path.isdir(f"{at}/catwarden-rows") else set()


def test_numbers_of_the_schema_text_are_places_in_its_order(spark):
    cat = _fleet(spark)
    rows = [r for r in T.schema_statements(cat).collect() if r.db_id is not None]
    want, number = [], {}
    for r in sorted(rows, key=lambda r: (r.db_id, r.section, r.part, r.level, *(r[c].encode() for c in ("table_key", "name_key", "sub", "sql")))):
        number[r.db_id] = number.get(r.db_id, 0) + 1
        want.append((r.db_id, number[r.db_id], r.section, r.sql))
    assert number[1] > 1_500 and number[2] > 10 and number[3] == 6 and set(number) == {1, 2, 3}
    df = T.render_schema(cat)
    assert df.columns == ["db_id", "seq", "section", "sql"] and sorted(map(tuple, df.collect())) == want


def test_sorted_text_is_not_moved_again(spark):
    df = T.render_schema(_fleet(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # read from the sorted files: neither a checkpoint of rows nor a shuffle by database
    assert "Exchange" not in plan and "ExistingRDD" not in plan and "Sort [" not in plan


def test_a_sort_leaves_neither_shuffle_nor_unsorted_copy(spark):
    rows = spark.range(5_000).select((F.col("id") % 7).alias("db_id"), F.lit(1).alias("section"), F.concat(F.lit("x"), F.hash("id")).alias("sql"))
    files, copies = _files(spark), _copies(spark)
    kept = X.keep_ranges([rows.where("id % 2 = 0"), rows.where("id % 2 = 1")], ["db_id", "section", "sql"], ["db_id", "section", "sql"])
    X.keep_rows([rows.repartition("sql")])
    until = time.time() + 20
    while _files(spark) - files and time.time() < until:
        time.sleep(0.2)
    assert not _files(spark) - files
    assert len(_copies(spark) - copies) == 1  # that of keep_rows
    got = [(r.db_id, r.section, r.sql) for r in sorted(kept.collect(), key=lambda r: (r.range_no, r.place))]
    assert got == sorted((r.db_id, r.section, r.sql) for r in rows.collect())
    ranges = kept.groupBy("range_no").agg(F.count_distinct("range_key").alias("keys"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n")).collect()
    assert len(ranges) > 1 and all(r.n == r.last + 1 and r["keys"] == 1 for r in ranges)
    # a range is a bucket: groups of it shuffle nothing
    assert "Exchange" not in kept.groupBy("range_key", "db_id").count()._jdf.queryExecution().executedPlan().toString()
