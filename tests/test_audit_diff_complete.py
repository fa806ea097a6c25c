"""Operational findings in the audit; constraints of created tables and objects by name in the diff."""

import datetime as dt

from catwarden.operators import diff as D
from catwarden.operators import extract as E
from catwarden.operators.findings import analyze
from tests.catalog_builder import DDL, build, clean_sample


def test_audit_holds_operational_findings(spark):
    cat = build(spark, clean_sample(3))
    at = dt.datetime(2024, 5, 4, 12, 0)
    samples = spark.createDataFrame(
        [(3, 1, at - dt.timedelta(days=3), 10, 20, 30, 1, 7),            # active for three days
         (3, 2, at, 1, 60_001, 60_002, 0, 7),                            # the newest sample: a gap of 60,000
         (9, 3, at, 1, 900_000, 900_000, 0, 7)],                         # no such database in the catalog
        "db_id bigint, sample_id bigint, ts timestamp, oit bigint, oat bigint, ost bigint, tx_state int, attachment_id bigint")
    own = spark.createDataFrame([(3, 99)], "db_id bigint, own_attachment_id bigint")
    cat.extras.update(samples=samples, own_attachments=own)
    got = {(r.db_id, r.code, r.severity) for r in analyze(cat).collect()}
    assert got == {(3, "OPERACIONAL_GAP_OIT_OAT_ACIMA_DO_ESPERADO", "high"),
                   (3, "OPERACIONAL_TRANSACAO_ATIVA_LONGA_CRITICA", "critical")}


def test_constraints_of_created_tables_and_convergence(spark):
    src, tgt = build(spark, DDL().table("A", ("ID", "INTEGER")).table("B", ("ID", "INTEGER"))), build(
        spark, DDL().table("B", ("ID", "INTEGER")))
    uq, ck = "db_id bigint, table_name string, name string, cols array<string>", "db_id bigint, table_name string, name string, check_sql string"
    src.extras.update(uniques=spark.createDataFrame([(1, "A", "UQ_A", ["ID"]), (1, "B", "INTEG_7", ["ID"])], uq),
                      checks=spark.createDataFrame([(1, "A", "CK_A", "ID > 0")], ck))
    tgt.extras.update(uniques=spark.createDataFrame([], uq), checks=spark.createDataFrame([], ck))
    sql = {(r["class"], r.sql) for r in D.diff(src, tgt).commands.collect() if r["class"] in (42, 43)}
    assert sql == {(42, 'ALTER TABLE "A" ADD CONSTRAINT "UQ_A" UNIQUE ("ID");'), (42, 'ALTER TABLE "B" ADD UNIQUE ("ID");'),
                   (43, 'ALTER TABLE "A" ADD CONSTRAINT "CK_A" CHECK (ID > 0);')}
    assert D.convergence(src, tgt).count() == 0


def test_check_text(spark):
    df = spark.createDataFrame([(s,) for s in ("check (A > 0)", "/* x */ CHECK\n(A > 0)", "BEGIN END", "A > 0", " ", None)], "s string")
    assert [r[0] for r in df.select(E.check_text(df.s)).collect()] == [
        "check (A > 0)", "CHECK (A > 0)", None, "CHECK (A > 0)", None, None]
