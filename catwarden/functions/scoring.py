"""Severity, risk score and priority as Catalyst column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severity levels, base scores, per-code adjustments, priority cut-offs.
SEVERITY_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SEVERITY_BASE = {"critical": 90, "high": 70, "medium": 45, "low": 25}
CODE_ADJUST = {
    "FK_SEM_INDICE_COBERTURA": 5,
    "INDICE_REDUNDANTE_PREFIXO": -5,
    "INDICE_DUPLICADO": -8,
    "FK_DUPLICADA": -8,
}
PRIORITY_CUTS = ((85, "P0"), (70, "P1"), (45, "P2"))

# English alias -> internal finding code.
CODE_ALIASES = {
    "TABLE_WITHOUT_PK": "TABELA_SEM_PK",
    "FK_WITHOUT_COVERING_INDEX": "FK_SEM_INDICE_COBERTURA",
    "DUPLICATED_INDEX": "INDICE_DUPLICADO",
    "TABLE_WITHOUT_COLUMNS": "TABELA_SEM_COLUNAS",
    "DUPLICATED_COLUMN": "COLUNA_DUPLICADA",
    "UNKNOWN_TYPE": "TIPO_DESCONHECIDO",
    "PK_WITHOUT_COLUMNS": "PK_SEM_COLUNAS",
    "PK_REFERENCES_MISSING_COLUMN": "PK_REFERENCIA_COLUNA_INEXISTENTE",
    "FK_WITHOUT_COLUMNS": "FK_SEM_COLUNAS",
    "FK_INVALID_CARDINALITY": "FK_CARDINALIDADE_INVALIDA",
    "FK_MISSING_LOCAL_COLUMN": "FK_COLUNA_LOCAL_INEXISTENTE",
    "FK_MISSING_REFERENCED_TABLE": "FK_TABELA_REFERENCIA_INEXISTENTE",
    "FK_MISSING_REFERENCED_COLUMN": "FK_COLUNA_REFERENCIA_INEXISTENTE",
    "INDEX_WITHOUT_COLUMNS": "INDICE_SEM_COLUNAS",
    "INDEX_MISSING_COLUMN": "INDICE_COLUNA_INEXISTENTE",
    "REDUNDANT_PREFIX_INDEX": "INDICE_REDUNDANTE_PREFIXO",
    "DUPLICATED_FK": "FK_DUPLICADA",
    "PROCEDURE_WITHOUT_BODY": "PROCEDURE_SEM_CORPO",
    "FUNCTION_WITHOUT_BODY": "FUNCTION_SEM_CORPO",
    "TRIGGER_WITHOUT_BODY": "TRIGGER_SEM_CORPO",
    "PROCEDURE_ONLY_SUSPEND": "PROCEDURE_SOMENTE_SUSPEND",
    "FUNCTION_ONLY_SUSPEND": "FUNCTION_SOMENTE_SUSPEND",
    "TRIGGER_ONLY_SUSPEND": "TRIGGER_SOMENTE_SUSPEND",
    "OPERATIONAL_OIT_OAT_GAP_CRITICAL": "OPERACIONAL_GAP_OIT_OAT_ELEVADO",
    "OPERATIONAL_OIT_OAT_GAP_HIGH": "OPERACIONAL_GAP_OIT_OAT_ACIMA_DO_ESPERADO",
    "OPERATIONAL_OIT_OAT_GAP_MEDIUM": "OPERACIONAL_GAP_OIT_OAT_MODERADO",
    "OPERATIONAL_OAT_OST_GAP_HIGH": "OPERACIONAL_GAP_OAT_OST_ELEVADO",
    "OPERATIONAL_OAT_OST_GAP_MEDIUM": "OPERACIONAL_GAP_OAT_OST_ACIMA_DO_ESPERADO",
    "OPERATIONAL_LONG_ACTIVE_TRANSACTION_CRITICAL": "OPERACIONAL_TRANSACAO_ATIVA_LONGA_CRITICA",
    "OPERATIONAL_LONG_ACTIVE_TRANSACTION_HIGH": "OPERACIONAL_TRANSACAO_ATIVA_LONGA",
    "OPERATIONAL_LONG_ACTIVE_TRANSACTION_MEDIUM": "OPERACIONAL_TRANSACAO_ATIVA_ACIMA_DO_ESPERADO",
}


def _case(col: Column, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def severity_weight(sev: Column) -> Column:
    return _case(sev, SEVERITY_WEIGHT, 1)


def risk_score(sev: Column, code: Column) -> Column:
    raw = _case(sev, SEVERITY_BASE, 25) + _case(code, CODE_ADJUST, 0)
    return F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("bigint")


def priority(score: Column) -> Column:
    expr = None
    for cut, label in PRIORITY_CUTS:
        expr = F.when(score >= cut, F.lit(label)) if expr is None else expr.when(score >= cut, F.lit(label))
    return expr.otherwise(F.lit("P3"))


def normalize_severity(sev: Column) -> Column:
    """lower/trim to one of the four levels, else NULL (rejected)."""
    v = F.lower(F.trim(sev))
    return F.when(v.isin(*SEVERITY_WEIGHT.keys()), v)


def alias_table(spark: SparkSession) -> DataFrame:
    """The 31-row alias table; a fixed, proven-small broadcast side."""
    return spark.createDataFrame(sorted(CODE_ALIASES.items()), "alias string, code string")


def normalize_overrides(raw: DataFrame, spark: SparkSession) -> DataFrame:
    """F11 over a DataFrame of ``(code, severity[, position])`` overrides: alias
    -> code, severity normalised; adds ``error`` for rejected rows and keeps
    the position (that of the row where the input has none)."""
    aliases = F.broadcast(alias_table(spark))
    if "position" not in raw.columns:
        raw = raw.withColumn("position", F.monotonically_increasing_id())
    r = raw.withColumn("_alias", F.upper(F.trim(F.coalesce(F.col("code"), F.lit("")))))
    return (r.join(aliases, r["_alias"] == aliases["alias"], "left")
             .select(
                 r["code"].alias("input_code"),
                 aliases["code"].alias("code"),
                 normalize_severity(F.coalesce(r["severity"], F.lit(""))).alias("severity"),
                 r["position"])
             .withColumn("error", F.when(F.col("input_code").isNull() | (F.trim(F.col("input_code")) == ""),
                                         F.lit("empty code"))
                                   .when(F.col("code").isNull(), F.lit("unknown code"))
                                   .when(F.col("severity").isNull(), F.lit("invalid severity"))))


def valid_overrides(normalized: DataFrame) -> DataFrame:
    """(code, severity, position) of normalised overrides; a rejected one
    ends the job with its reason."""
    stop = F.raise_error(F.concat(F.lit("Override "), F.coalesce("input_code", F.lit("")), F.lit(": "), F.col("error")))
    return normalized.select("code", F.when(F.col("error").isNotNull(), stop.cast("string")).otherwise(F.col("severity"))
                             .alias("severity"), "position")
