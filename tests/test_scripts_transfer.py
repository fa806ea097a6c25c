"""Reference unit cases for script splitting, arity, rendering and loading."""

import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catwarden.operators import scripts as S
from catwarden.operators import transfer as X
from catwarden.sources import sinks

SPLITTER_SCRIPT = """SET SQL DIALECT 3;
SET NAMES UTF8;

-- comment with ; inside
INSERT INTO T (ID, NOME) VALUES (1, 'texto com ; no meio');
/* block ; comment */
INSERT INTO T (ID, NOME)
VALUES (2, 'two');
SET TERM ^ ;
EXECUTE BLOCK AS BEGIN INSERT INTO T (ID, NOME) VALUES (3, 'three'); END^
SET TERM ; ^
"""


def test_split_script_strings_comments_and_set_term():
    script = S.split_script(SPLITTER_SCRIPT)
    rows = script.statements
    assert [r[0] for r in rows] == [1, 2, 3]
    assert rows[0] == (1, 5, "INSERT INTO T (ID, NOME) VALUES (1, 'texto com ; no meio')")
    assert rows[1] == (2, 7, "INSERT INTO T (ID, NOME)\nVALUES (2, 'two')")
    assert rows[2][2] == "EXECUTE BLOCK AS BEGIN INSERT INTO T (ID, NOME) VALUES (3, 'three'); END"
    assert (script.lines_read, script.lines_processed) == (11, 6)


def test_split_script_flushes_unterminated_tail():
    rows = S.split_script("INSERT INTO T VALUES (1);\nINSERT INTO T VALUES (2)").statements
    assert [r[2] for r in rows] == ["INSERT INTO T VALUES (1)", "INSERT INTO T VALUES (2)"]
    assert S.split_script("") == ([], 0, 0) and S.split_script(" \n\n;") == ([], 3, 1)


def test_split_script_quotes_terminators_and_lines():
    text = ("SET NAMES UTF8; INSERT INTO T VALUES ('a\r\n;b');  \n\nSELECT \"x;'y\" /* c\n; */FROM U -- z;\nWHERE 1=1;\n"
            "SET TERM !! ;\nCREATE PROCEDURE P AS BEGIN A = 'SET TERM ; !!'; END!!\nSET TERM ; !!\nSELECT 5-3/1")
    got = S.split_script(text)
    assert got.statements == [
        (1, 1, "INSERT INTO T VALUES ('a\r\n;b')"), (2, 4, "SELECT \"x;'y\" FROM U \nWHERE 1=1"),
        (3, 8, "CREATE PROCEDURE P AS BEGIN A = 'SET TERM ; !!'; END"), (4, 10, "SELECT 5-3/1")]
    assert (got.lines_read, got.lines_processed) == (10, 7)


def test_insert_arity_three_reference_cases():
    assert S.parse_insert_text("INSERT INTO T (ID, NOME, OBS) VALUES (1,'ANA','TEXTO');")[3:6] == (3, 3, None)
    assert S.parse_insert_text("INSERT INTO T (ID, OBS) VALUES (1,'A, B, C');")[3:6] == (2, 2, None)
    bad = S.parse_insert_text("INSERT INTO T (ID, NOME, OBS) VALUES (1,'ANA');")
    assert bad[3:5] == (3, 2) and "differs" in bad[5]
    nested = S.parse_insert_text("INSERT INTO T (A, B) VALUES (COALESCE(1, 2), 'x''y, z');")
    assert nested[2] == ["COALESCE(1, 2)", "'x''y, z'"]


def test_charset_sniff_and_decode(spark):
    rows = [("a.sql", bytearray("SET NAMES win1252;\nINSERT INTO T VALUES ('ação');".encode("cp1252"))),
            ("b.sql", bytearray(b"INSERT INTO T VALUES (1);")),
            ("c.sql", bytearray(b"\xef\xbb\xbfSET NAMES ISO8859_1 ;\n"))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r.cs for r in df.select("path", S.script_charset(F.col("content")).alias("cs")).collect()}
    assert got == {"a.sql": "WIN1252", "b.sql": "UTF8", "c.sql": "ISO8859_1"}
    st = {r.path: r.sql_text for r in S.script_statements(df).collect() if r.sql_text}
    assert st["a.sql"] == "INSERT INTO T VALUES ('ação')"


def test_target_table_detection_fixes_upsert_quirk(spark):
    df = spark.createDataFrame([("UPDATE OR INSERT INTO clientes (ID) VALUES (1)",), ("insert into T(ID) values (1)",),
                                ("DELETE FROM \"Mixed\" WHERE 1=1",), ("SELECT 1 FROM X",)], "sql string")
    got = [r.t for r in df.select(S.target_table(F.col("sql")).alias("t")).collect()]
    assert got == ["CLIENTES", "T", '"MIXED"', None]


def test_quarantine_keeps_good_rows(spark):
    stmts = [(i, f"INSERT INTO T (ID, NOME) VALUES ({i}, 'n{i}');") for i in range(1, 401)]
    stmts.append((401, "INSERT INTO T (ID, COLUNA_X) VALUES (401, 'x');"))
    stmts += [(i, f"INSERT INTO T (ID, NOME) VALUES ({i}, 'n{i}');") for i in range(402, 802)]
    df = spark.createDataFrame(stmts, "stmt_no long, sql_text string")
    good, bad = S.load_inserts(df, "T", T.StructType([T.StructField("ID", T.LongType()), T.StructField("NOME", T.StringType())]))
    assert good.count() == 800
    b = bad.collect()
    assert len(b) == 1 and b[0].stmt_no == 401 and "COLUNA_X" in b[0].error


NINE = {
    "INSERT INTO T (ID, NOME VALUES (1, 'x')": "quarantined",
    "INSERT INTO T VALUES (2, 'x')": "loaded",
    "UPDATE T SET NOME = 'x'": "not_applicable",
    "DELETE FROM T": "not_applicable",
    "INSERT INTO T (ID, NOME) SELECT 1, 'x' FROM U": "not_applicable",
    "INSERT INTO T (ID, ID) VALUES (1, 2)": "quarantined",
    "INSERT INTO \"MY TABLE\" (ID) VALUES (3)": "not_applicable",
    "UPDATE OR INSERT INTO T (ID, NOME) VALUES (4, 'a\nb') MATCHING (ID)": "merged",
    "INSERT INTO T (ID, NOME) VALUES (5, 'it''s\nok')": "loaded",
    "INSERT INTO T (ID, NOME) VALUES (6, 'x)": "quarantined",
    "INSERT INTO T (ID) VALUES (7))": "quarantined",
    "INSERT INTO T VALUES (8)": "quarantined",
    "INSERT INTO T (ID) VALUES ('eight')": "quarantined",
    "UPDATE OR INSERT INTO T (ID, NOME) VALUES (9, 'n') MATCHING (NOME)": "quarantined",
    "INSERT INTO T (NOME) VALUES ('no key')": "quarantined",
    "()": "quarantined",
    "": "quarantined",
}
T_SCHEMA = T.StructType([T.StructField("ID", T.LongType()), T.StructField("NOME", T.StringType())])


def test_each_statement_has_one_fate(spark):
    df = spark.createDataFrame(list(enumerate(NINE)), "stmt_no long, sql_text string")
    got = S.settle_keys(S.replay(df, "t", T_SCHEMA, key=["ID"]), ["ID"], ["stmt_no"]).collect()
    assert {r.sql_text: r.fate for r in got} == NINE and len(got) == len(NINE)
    assert all((r.reason is None) == (r.fate in ("loaded", "merged")) for r in got)
    rows = {r.sql_text: r.row for r in got}
    assert rows["INSERT INTO T (ID, NOME) VALUES (5, 'it''s\nok')"].NOME == "it's\nok"
    assert rows["INSERT INTO T VALUES (2, 'x')"].ID == 2
    own = spark.createDataFrame([(1, 'INSERT INTO "MY TABLE" (ID) VALUES (3)')], "stmt_no long, sql_text string")
    assert S.load_inserts(own, "my table", T_SCHEMA)[0].collect()[0].ID == 3


def test_replay_applies_statements_in_order(spark):
    stmts = ["INSERT INTO T (ID, NOME) VALUES (1, 'a')", "UPDATE OR INSERT INTO T (ID) VALUES (1) MATCHING (ID)",
             "INSERT INTO T (ID, NOME) VALUES (1, 'late')", "UPDATE OR INSERT INTO T (ID, NOME) VALUES (2, 'm')",
             "UPDATE OR INSERT INTO T (NOME, ID) VALUES (NULL, 2) MATCHING (ID)", "INSERT INTO T (ID) VALUES (3)"]
    df = spark.createDataFrame(list(enumerate(stmts)), "stmt_no long, sql_text string")
    settled = S.settle_keys(S.replay(df, "T", T_SCHEMA, key=["ID"]), ["ID"], ["stmt_no"])
    fates = [r.fate for r in settled.orderBy("stmt_no").collect()]
    assert fates == ["loaded", "merged", "quarantined", "merged", "merged", "loaded"]
    table = sorted(tuple(r) for r in S.replay_table(settled, T_SCHEMA, ["ID"], ["stmt_no"]).collect())
    assert table == [(1, "a"), (2, None), (3, None)]


def test_fail_fast_stops_at_a_bad_statement(spark):
    df = spark.createDataFrame([(1, "INSERT INTO T (ID) VALUES (1)"), (2, "INSERT INTO T (NOPE) VALUES (1)")], "stmt_no long, sql_text string")
    assert S.replay(df.where("stmt_no = 1"), "T", T_SCHEMA, fail_fast=True).count() == 1
    with pytest.raises(Exception, match="Column unknown: NOPE"):
        S.replay(df, "T", T_SCHEMA, fail_fast=True).collect()


def test_bytes_that_do_not_decode_are_put_aside(spark):
    df = spark.createDataFrame([("a.sql", bytearray(b"INSERT INTO T (ID) VALUES (1);\nINSERT INTO T (ID, NOME) VALUES (2, 'a\xe3o');"))],
                               "path string, content binary")
    got = S.replay(S.script_statements(df), "T", T_SCHEMA).orderBy("stmt_no").collect()
    assert [r.fate for r in got] == ["loaded", "quarantined"]
    assert got[1].sql_text.endswith("'a\\xe3o')") and "not valid" in got[1].reason


def test_call_sites():
    from catwarden.operators.graph import _call_sites
    src = ("BEGIN EXECUTE PROCEDURE P1(1, 'a, (b', F(2, 3)); SELECT X FROM \"p 2\"() JOIN P3 (:A, (SELECT 1 FROM P4(1))) ON 1 = 1;"
           " /* FROM P5(1) */ -- FROM P6(1)\n A = 'FROM P7(1)'; EXECUTE PROCEDURE P8(1")
    assert sorted(_call_sites(src)) == [("P 2", 0), ("P1", 3), ("P3", 2), ("P4", 1)]


def test_render_literals_by_type(spark):
    import datetime as dt
    df = spark.createDataFrame(
        [(1, decimal.Decimal("12.50"), dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 600000),
          "it's\r\nok €", bytearray(b"\x01\xab"), None)],
        "id int, v decimal(10,2), d date, ts timestamp_ntz, s string, b binary, n string")
    sql = X.render_insert(df, "DEST", sanitize=True, escape_newlines_=True).collect()[0].sql
    assert sql == ("INSERT INTO DEST (id, v, d, ts, s, b, n) VALUES (1, 12.50, '2024-01-02', '2024-01-02 03:04:05', "
                   "'it''s\\r\\nok ', x'01AB', NULL);")
    up = X.render_insert(df.select("id", "s"), "DEST", mode="upsert", matching=["id"]).collect()[0].sql
    assert up.startswith("UPDATE OR INSERT INTO DEST (id, s) VALUES (1, ") and up.endswith(" MATCHING (id);")
    b64 = df.select(X.blob_literal(F.col("b"), "base64").alias("x")).collect()[0].x
    assert b64 == "'Aas='"


def test_user_filter_normalisation():
    assert X.normalize_filter("WHERE  ID > 1") == "ID > 1"
    assert X.normalize_filter("WHEREX = 1") == "WHEREX = 1"
    for bad in ("WHERE", "ID = 1; DROP TABLE T", "ID = 1 -- x", "/* x */ ID = 1"):
        try:
            X.normalize_filter(bad)
            raise AssertionError(bad)
        except X.TransferError:
            pass
    assert X.normalize_select("  select * from t ;") == "select * from t"


def test_commit_pacing_1200_rows_every_500(spark):
    df = spark.range(1, 1201).select(F.col("id").alias("k"), F.concat(F.lit("INSERT "), F.col("id").cast("string")).alias("sql"))
    numbered = X.global_row_number(df, ["k"])
    assert [r.row_no for r in numbered.orderBy("k").select("row_no").collect()][:3] == [1, 2, 3]
    lines = sinks.script_lines(numbered, 500)
    assert lines.where(F.col("line") == "COMMIT;").count() == 3
    batches = X.commit_batches(numbered, 500).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in batches] == [500, 500, 200]


def test_greedy_parts_repeat_header_and_respect_limit(spark):
    line = "x" * 4000
    df = spark.range(1, 2001).select(F.col("id").alias("row_no"), F.lit(0).alias("sub"), F.lit(line).alias("line"))
    header = sinks.header_lines("UTF8")
    parted = sinks.assign_parts(df, 1024 * 1024, header, partitions=1)
    summary = sinks.part_summary(sinks.with_headers(parted, header)).collect()
    assert len(summary) > 1
    assert all(r.bytes <= 1024 * 1024 for r in summary)
    assert sum(r.n_lines for r in summary) == 2000 + 3 * len(summary)


def test_upsert_last_statement_wins(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changes = spark.createDataFrame([(2, "b1", 1), (2, "b2", 5), (3, "c", 2)], "id long, v string, stmt long")
    got = sorted(tuple(r) for r in X.apply_upsert(target, changes, ["id"], "stmt").collect())
    assert got == [(1, "a"), (2, "b2"), (3, "c")]


def test_roundtrip_difference_is_empty(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id long, v string")
    assert X.roundtrip_diff(a, a.orderBy(F.desc("id"))).count() == 0
    b = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    assert X.roundtrip_diff(a, b).count() == 1
