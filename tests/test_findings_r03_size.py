"""Findings of round 3 on size: snapshots are parsed once and compared without a shuffle of rows, statements of the
schema text are made once, Python workers hold a few megabytes of scripts."""

from __future__ import annotations

import json

import pandas as pd

from catwarden.operators import schema_text as T
from catwarden.operators import script_chunks as C
from catwarden.operators import scripts as S
from catwarden.plans.schema import compared
from catwarden.sources import snapshots as SN

from .catalog_builder import DDL, build

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _catalog(spark):
    return build(spark, DDL().table("A", ("ID", "INTEGER"), ("N", "VARCHAR(10)")).table("B", ("ID", "INTEGER")))


def test_tables_of_a_snapshot_are_parsed_once(spark, tmp_path):
    cat = _catalog(spark)
    was = spark.conf.get(SN.SORTED_GROUPS)
    SN.write_objects(cat, str(tmp_path / "objects"))
    assert spark.conf.get(SN.SORTED_GROUPS) == was
    back = SN.catalog_from_objects(SN.read_objects(spark, str(tmp_path / "objects")))
    for name in ("tables", "columns", "indexes", "fk_cols"):
        assert "json" not in _plan(getattr(back, name)), name
    cols = ["db_id", "table_name", "ordinal", "column_name", "sql_type"]
    want = sorted(map(tuple, cat.columns.select(*cols).collect()))
    assert want and sorted(map(tuple, back.columns.select(*cols).collect())) == want


def test_rows_are_compared_as_multisets(spark):
    def frame(*rows):
        return spark.createDataFrame(rows, "a string, b string, c array<string>")
    x = frame(("1", None, ["p", "q"]), (None, "1", ["pq"]), ("2", "2", None), ("2", "2", None), ("3", "3", []))
    y = frame((None, "1", ["p", "q"]), (None, "1", ["pq"]), ("2", "2", None), ("3", "3", None))
    got = {r.kind: (r.n, r.lost, r.added) for r in compared({"same": x, "other": x, "gone": x, "empty": x.limit(0)},
                                                            {"same": x, "other": y, "gone": x.limit(0), "empty": x.limit(0)}).collect()}
    assert got == {"same": (5, 0, 0), "other": (4, 3, 2), "gone": (0, 5, 0), "empty": (0, 0, 0)}
    # equal sides: only sums of parts were shuffled
    assert "h1" not in _plan(compared({"same": x}, {"same": x}))


def test_statements_of_the_schema_are_made_once(spark):
    df = T.schema_statements(_catalog(spark))
    assert "Join" not in _plan(df)
    assert sum(r.sql.startswith("CREATE TABLE") for r in df.collect()) == 2


def test_frames_of_statements_are_bounded_by_bytes():
    file = "".join(f"INSERT INTO T VALUES ('{'x' * (S.BATCH_BYTES // 8)}{i}');\n" for i in range(20))
    frames = list(S._split_batches([pd.DataFrame({"path": ["a"], "content": [file.encode()], "charset": ["UTF8"]})]))
    assert sum(map(len, frames)) == 20 and max(f["sql_text"].str.len().sum() for f in frames) <= 1.25 * S.BATCH_BYTES
    chunk = pd.DataFrame({"path": ["a"], "chunk": [0], "content": [file.encode()], "charset": ["UTF8"], "marked": [False],
                          "entry": [json.dumps(C.START)], "last": [True]})
    pieces = list(C._cut([chunk]))
    assert sum(map(len, pieces)) == 21 and max(p["text"].dropna().str.len().sum() for p in pieces) <= 1.25 * S.BATCH_BYTES


def test_workers_get_scripts_in_small_batches(spark):
    was = spark.conf.get(ARROW_BYTES)
    files = spark.createDataFrame([("a", bytearray(b"SELECT 1;\n"))], "path string, content binary")
    chunks = files.selectExpr("path", "CAST(0 AS BIGINT) AS chunk", "content")
    try:
        for run, df in ((S.script_statements, files), (C.chunk_statements, chunks)):
            spark.conf.set(ARROW_BYTES, "64m")
            assert [r.sql_text for r in run(df).collect()] == ["SELECT 1"]
            assert int(spark.conf.get(ARROW_BYTES).removesuffix("b")) <= S.BATCH_BYTES
            spark.conf.set(ARROW_BYTES, "1m")
            run(df)
            assert spark.conf.get(ARROW_BYTES) in ("1m", "1048576b")
    finally:
        spark.conf.set(ARROW_BYTES, was)
