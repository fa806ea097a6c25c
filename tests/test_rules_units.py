"""Reference unit cases for individual rules, re-expressed on small catalogs."""

from catwarden.operators import findings as fnd
from catwarden.operators import rules
from tests.catalog_builder import DDL, build


def codes(df):
    return sorted((r.code, r.scope) for r in df.collect())


def test_pk_missing_column_one_finding_per_column(spark):
    d = DDL().table("T", ("A", "INTEGER")).pk("T", "PK_T", "A", "B", "C")
    assert codes(rules.rule_pk_missing_column(build(spark, d))) == [("PK_REFERENCIA_COLUNA_INEXISTENTE", "T")] * 2


def test_fk_without_covering_index_only_when_blank_support_and_no_prefix(spark):
    d = (DDL().table("P", ("ID", "INTEGER")).table("C", ("ID", "INTEGER"), ("P_ID", "INTEGER"), ("X", "INTEGER"))
         .fk("C", "FK_BLANK", ["P_ID"], "P", ["ID"], support="")
         .fk("C", "FK_COVERED", ["X"], "P", ["ID"], support=" ")
         .index("C", "IX_X_P", ["x", "P_ID"])
         .fk("C", "FK_NAMED", ["P_ID"], "P", ["ID"], support="RDB$FOREIGN1"))
    got = codes(rules.rule_fk_without_covering_index(build(spark, d)))
    assert got == [("FK_SEM_INDICE_COBERTURA", "C.FK_BLANK")]
    score = fnd.score_findings(rules.rule_fk_without_covering_index(build(spark, d))).collect()[0]
    assert (score.score, score.priority) == (50, "P2")


def test_fk_without_columns_stops_other_fk_checks(spark):
    d = DDL().table("T", ("A", "INTEGER")).fk("T", "FK_E", [], "NOWHERE", ["ID"])
    cat = build(spark, d)
    assert codes(rules.rule_fk_without_columns(cat)) == [("FK_SEM_COLUNAS", "T.FK_E")]
    assert rules.rule_fk_missing_referenced_table(cat).count() == 0


def test_duplicated_index_groups_empty_column_lists(spark):
    d = DDL().table("T", ("A", "INTEGER")).index("T", "I1", []).index("T", "I2", []).index("T", "I3", ["a"]) \
        .index("T", "I4", ["A"], unique=True)
    assert codes(rules.rule_duplicated_index(build(spark, d))) == [("INDICE_DUPLICADO", "T")]


def test_expression_index_is_not_a_missing_column(spark):
    d = (DDL().table("T", ("A", "INTEGER"))
         .index("T", "I_EXPR", ["UPPER(A)"]).index("T", "I_OP", ["A || B"]).index("T", "I_KW", ["CASE"])
         .index("T", "I_MISSING", ["ZZ"]))
    assert codes(rules.rule_index_missing_column(build(spark, d))) == [("INDICE_COLUNA_INEXISTENTE", "T.I_MISSING")]


def test_redundant_prefix_first_longer_by_name(spark):
    d = (DDL().table("T", ("A", "INTEGER"), ("B", "INTEGER"), ("C", "INTEGER"))
         .index("T", "I_A", ["A"]).index("T", "I_ZAB", ["A", "B"]).index("T", "I_MAB", ["a", "b", "c"])
         .index("T", "I_A_DESC", ["A"], desc=True).index("T", "I_UA", ["A"], unique=True))
    pairs = sorted((r.short_name, r.long_name) for r in rules.redundant_prefix_pairs(build(spark, d)).collect())
    assert pairs == [("I_A", "I_MAB"), ("I_ZAB", "I_MAB")]


def test_prefix_filter_hides_tables_and_skips_refs_to_them(spark):
    d = (DDL().table("TMP_X", ("ID", "INTEGER")).table("ORD", ("ID", "INTEGER"), ("X_ID", "INTEGER"))
         .pk("ORD", "PK_ORD", "ID").fk("ORD", "FK_X", ["X_ID"], "tmp_x", ["ID"]))
    cat = build(spark, d)
    assert codes(rules.rule_table_without_pk(cat, [" tmp_ ", "TMP_"])) == []
    assert codes(rules.rule_fk_missing_referenced_table(cat, ["tmp_"])) == []
    assert codes(rules.rule_table_without_pk(cat)) == [("TABELA_SEM_PK", "TMP_X")]


def test_psql_bodies(spark):
    d = (DDL().routine("PROCEDURE", "P_EMPTY", "AS BEGIN /* nothing */ END")
         .routine("PROCEDURE", "P_SKIP", "", ignore_body=True)
         .routine("FUNCTION", "F_NO_BEGIN", "RETURNS INT AS")
         .routine("TRIGGER", "T_SUSPEND", "AS BEGIN -- x\n  suspend ;\nEND")
         .routine("PROCEDURE", "P_STR", "AS BEGIN x = '/* not a comment */'; END")
         .routine("PROCEDURE", "P_OK", "AS BEGIN SUSPEND; X = 1; END"))
    cat = build(spark, d)
    assert codes(rules.rule_routine_without_body(cat)) == [("FUNCTION_SEM_CORPO", "F_NO_BEGIN"),
                                                            ("PROCEDURE_SEM_CORPO", "P_EMPTY")]
    assert codes(rules.rule_routine_only_suspend(cat)) == [("TRIGGER_SOMENTE_SUSPEND", "T_SUSPEND")]


def test_field_compatibility_by_version(spark):
    d2 = DDL(db_id=1, major=2).table("T", ("B", "BOOLEAN"), ("N", "NUMERIC(20,2)"), ("V", "VARCHAR(20000)"),
                                      ("Z", "NUMERIC(40,2)"), ("E", ""))
    d4 = DDL(db_id=2, major=4).table("T", ("B", "BOOLEAN"), ("N", "NUMERIC(20,2)"), ("I", "INT128"))
    rows = {(r.db_id, r.scope): r.code for r in rules.field_audit(build(spark, d2, d4)).collect()}
    assert rows == {(1, "T.B"): "CAMPO_TIPO_INCOMPATIVEL_VERSAO", (1, "T.N"): "CAMPO_PRECISAO_NUMERICA_INCOMPATIVEL",
                    (1, "T.Z"): "CAMPO_PRECISAO_NUMERICA_INVALIDA", (1, "T.E"): "CAMPO_TIPO_VAZIO"}


def test_text_size_uses_bytes_per_char(spark):
    d = DDL(major=None)
    d.rows["tables"].append((1, "T"))
    d.rows["columns"].append((1, "T", 1, "V", "VARCHAR(10000)", 4, True, None, None))
    d.rows["columns"].append((1, "T", 2, "W", "VARCHAR(10000)", 3, True, None, None))
    rows = {r.scope: r.code for r in rules.field_audit(build(spark, d)).collect()}
    assert rows == {"T.V": "CAMPO_TAMANHO_EFETIVO_EXCEDIDO"}


def test_risk_by_table_half_even(spark):
    d = DDL().table("T", ("A", "TYPE_1"))  # TABELA_SEM_PK 70 + TIPO_DESCONHECIDO 70
    r = fnd.risk_by_table(fnd.analyze(build(spark, d))).collect()[0]
    assert (r.n, r.risk_index, r.priority) == (2, 65, "P2")  # 35 + 28 + 2
