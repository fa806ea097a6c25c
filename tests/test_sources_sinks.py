"""File-level sources and sinks: glob inputs, script parts, partitioned results."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from catwarden.operators import scripts as S
from catwarden.operators import transfer as X
from catwarden.sources import sinks


def test_read_scripts_glob_and_missing(spark):
    d = tempfile.mkdtemp(prefix="catwarden-scripts-", dir="/tmp")
    for name, body in (("a.sql", "INSERT INTO T VALUES (1);"), ("b.sql", "INSERT INTO T VALUES (2);\nINSERT INTO T VALUES (3);"),
                       ("c.txt", "ignored;")):
        with open(os.path.join(d, name), "w") as fh:
            fh.write(body)
    files = S.read_scripts(spark, os.path.join(d, "*.sql"))
    st = S.script_statements(files)
    assert st.where(F.col("sql_text").isNotNull()).count() == 3
    with pytest.raises(FileNotFoundError):
        S.read_scripts(spark, os.path.join(d, "*.nothing"))


def test_write_script_parts(spark):
    d = tempfile.mkdtemp(prefix="catwarden-parts-", dir="/tmp")
    rows = spark.range(1, 501).select(F.col("id").alias("k"), F.lit("x" * 300).alias("v"))
    rendered = X.render_insert(rows, "T", keep=["k"])
    lines = sinks.script_lines(X.global_row_number(rendered, ["k"]), 100)
    header = sinks.header_lines(None, force_win1252=True)
    assert header == ["SET SQL DIALECT 3;", "SET NAMES WIN1252;", ""]
    parted = sinks.with_headers(sinks.assign_parts(lines, 64 * 1024, header), header)
    sinks.write_script(parted, d)
    parts = sorted(p for p in os.listdir(d) if p.startswith("part_no="))
    assert len(parts) >= 3
    back = spark.read.text(os.path.join(d, parts[0]))
    assert back.first().value == "SET SQL DIALECT 3;"
    total = spark.read.text(d).where(F.col("value").startswith("INSERT")).count()
    assert total == 500


def test_write_results_partitioned(spark):
    d = tempfile.mkdtemp(prefix="catwarden-results-", dir="/tmp")
    df = spark.createDataFrame([(1, "X", "a"), (2, "Y", "b")], "db_id long, code string, scope string")
    sinks.write_results(df, d, fmt="json")
    assert sorted(p for p in os.listdir(d) if p.startswith("db_id=")) == ["db_id=1", "db_id=2"]
