"""Golden artifacts: the published risk sample and the three-database fleet summary."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from catwarden.operators import findings as fnd
from catwarden.operators import fleet
from tests.catalog_builder import build, clean_sample, plain_sample, rich_sample

G1 = {
    ("critical", 90, "P0", "FK_CARDINALIDADE_INVALIDA", "PEDIDOS.FK_PEDIDOS_CARD"),
    ("critical", 90, "P0", "FK_COLUNA_LOCAL_INEXISTENTE", "PEDIDOS.FK_PEDIDOS_LOCAL_MISSING"),
    ("critical", 90, "P0", "FK_COLUNA_REFERENCIA_INEXISTENTE", "PEDIDOS.FK_PEDIDOS_REF_COLUMN_MISSING"),
    ("critical", 90, "P0", "FK_TABELA_REFERENCIA_INEXISTENTE", "PEDIDOS.FK_PEDIDOS_REF_TABLE_MISSING"),
    ("critical", 90, "P0", "PK_REFERENCIA_COLUNA_INEXISTENTE", "PEDIDOS"),
    ("critical", 90, "P0", "TABELA_SEM_COLUNAS", "LOG_EVENTOS"),
    ("high", 70, "P1", "INDICE_COLUNA_INEXISTENTE", "PEDIDOS.IND_PEDIDOS_COLUNA_INEXISTENTE"),
    ("high", 70, "P1", "INDICE_SEM_COLUNAS", "PEDIDOS.IND_PEDIDOS_SEM_COLUNA"),
    ("high", 70, "P1", "TABELA_SEM_PK", "CLIENTES"),
    ("high", 70, "P1", "TABELA_SEM_PK", "ITENS_PEDIDO"),
    ("high", 70, "P1", "TABELA_SEM_PK", "LOG_EVENTOS"),
    ("high", 70, "P1", "TIPO_DESCONHECIDO", "CLIENTES.TIPO_INVALIDO"),
    ("medium", 40, "P3", "INDICE_REDUNDANTE_PREFIXO", "PEDIDOS"),
    ("low", 17, "P3", "FK_DUPLICADA", "PEDIDOS"),
    ("low", 17, "P3", "INDICE_DUPLICADO", "PEDIDOS"),
}


def test_rich_sample_sixteen_findings(spark):
    cat = build(spark, rich_sample())
    rows = fnd.analyze(cat).collect()
    got = Counter((r.severity, r.score, r.priority, r.code, r.scope) for r in rows)
    assert sum(got.values()) == 16
    assert set(got) == G1
    assert got[("medium", 40, "P3", "INDICE_REDUNDANTE_PREFIXO", "PEDIDOS")] == 2
    tot = fnd.severity_totals(fnd.analyze(cat)).collect()[0]
    assert (tot.total, tot.critical, tot.high, tot.medium, tot.low) == (16, 6, 6, 2, 2)


def test_rich_sample_summary_by_table(spark):
    cat = build(spark, rich_sample())
    s = {r.table_name: (r.n, r.percent) for r in fnd.summary_by_table(fnd.analyze(cat)).collect()}
    assert s == {"PEDIDOS": (11, 68.75), "CLIENTES": (2, 12.5), "LOG_EVENTOS": (2, 12.5), "ITENS_PEDIDO": (1, 6.25)}


def test_rich_sample_order_and_object_counts(spark):
    cat = build(spark, rich_sample())
    ordered = fnd.order_findings(fnd.analyze(cat)).collect()
    assert [r.code for r in ordered[:2]] == ["FK_CARDINALIDADE_INVALIDA", "FK_COLUNA_LOCAL_INEXISTENTE"]
    assert ordered[-1].code == "INDICE_DUPLICADO"
    oc = fnd.object_counts(cat).collect()[0]
    assert (oc.tables, oc.indexes, oc.pks, oc.fks) == (4, 5, 1, 7)


def test_fleet_summary_three_databases(spark):
    cat = build(spark, rich_sample(1), plain_sample(2), clean_sample(3))
    scored = fnd.analyze(cat)
    by_db = {r.db_id: r for r in fleet.fleet_by_database(cat, scored).collect()}
    assert by_db[1].highest_severity == "critical"
    assert by_db[1].top_codes == "TABELA_SEM_PK (3), INDICE_REDUNDANTE_PREFIXO (2), FK_CARDINALIDADE_INVALIDA (1)"
    assert by_db[2].highest_severity == "high"
    assert by_db[2].top_codes == "TABELA_SEM_PK (2), INDICE_DUPLICADO (1)"
    assert by_db[3].highest_severity == "none" and by_db[3].total == 0
    t = fleet.fleet_totals(fleet.fleet_by_database(cat, scored)).collect()[0]
    assert (t.databases, t.with_findings, t.with_criticals, t.tables, t.total) == (3, 2, 1, 8, 19)
    assert (t.critical, t.high, t.medium, t.low) == (6, 8, 2, 3)
    codes = {r.code: (r.n, r.percent) for r in fleet.fleet_by_code(scored).collect()}
    assert codes["TABELA_SEM_PK"] == (5, 26.32)


def test_overrides_change_severity_and_score(spark):
    from catwarden.functions.scoring import normalize_overrides, valid_overrides
    cat = build(spark, rich_sample())
    raw = spark.createDataFrame([("TABLE_WITHOUT_PK", "low"), ("table_without_pk", " Critical"), ("DUPLICATED_INDEX", "medium"),
                                 ("NOPE", "high"), ("UNKNOWN_TYPE", "urgent")], "code string, severity string")
    norm = normalize_overrides(raw, spark)
    errors = {r.input_code: r.error for r in norm.collect()}
    assert errors["NOPE"] == "unknown code" and errors["UNKNOWN_TYPE"] == "invalid severity"
    with pytest.raises(Exception, match="unknown code|invalid severity"):
        valid_overrides(norm).collect()
    good = valid_overrides(norm.where(F.col("error").isNull()))
    rows = fnd.analyze(cat, overrides=good).collect()
    nopk = [r for r in rows if r.code == "TABELA_SEM_PK"]
    assert all(r.severity == "critical" and r.score == 90 and r.priority == "P0" for r in nopk)
    dup = [r for r in rows if r.code == "INDICE_DUPLICADO"][0]
    assert (dup.severity, dup.score, dup.priority) == ("medium", 37, "P3")
