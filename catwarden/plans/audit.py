"""Audit queries: rules, scored findings, per-database and fleet summaries."""

from __future__ import annotations

import uuid

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fleet as fleet_ops
from ..operators import findings as fnd
from ..operators import rules
from ..operators.catalog import fixture_catalog
from ..functions.scoring import normalize_overrides, valid_overrides
from ..sources.fixtures import keep_rows, keep_table
from .monitor import GAP_SQL
from .registry import register

# ---------------------------------------------------------------- SQL pieces

SCORE_SQL = """
SELECT db_id, severity, score,
       CASE WHEN score >= 85 THEN 'P0' WHEN score >= 70 THEN 'P1' WHEN score >= 45 THEN 'P2' ELSE 'P3' END AS priority,
       code, scope
FROM (
  SELECT db_id, severity, code, scope,
         CAST(GREATEST(0, LEAST(100,
           CASE severity WHEN 'critical' THEN 90 WHEN 'high' THEN 70 WHEN 'medium' THEN 45 ELSE 25 END
           + CASE code WHEN 'FK_SEM_INDICE_COBERTURA' THEN 5 WHEN 'INDICE_REDUNDANTE_PREFIXO' THEN -5
                       WHEN 'INDICE_DUPLICADO' THEN -8 WHEN 'FK_DUPLICADA' THEN -8 ELSE 0 END)) AS BIGINT) AS score
  FROM ({inner}) raw_findings
) scored_findings
"""


def scored(inner: str) -> str:
    return SCORE_SQL.format(inner=inner)


FK_CTE = """
fk_counts AS (
  SELECT db_id, table_name, fk_name, count(column_name) AS n_local, count(ref_column) AS n_ref
  FROM fx_fk_col GROUP BY db_id, table_name, fk_name),
fkx AS (
  SELECT f.*, coalesce(c.n_local, 0) AS n_local, coalesce(c.n_ref, 0) AS n_ref,
         coalesce(c.n_local, 0) > 0 AND coalesce(c.n_ref, 0) > 0 AS valid
  FROM fx_fk f LEFT JOIN fk_counts c USING (db_id, table_name, fk_name)),
fk_local AS (
  SELECT db_id, table_name, fk_name, list(upper(column_name) ORDER BY ordinal) AS cols
  FROM fx_fk_col WHERE column_name IS NOT NULL GROUP BY db_id, table_name, fk_name),
fk_ref AS (
  SELECT db_id, table_name, fk_name, list(upper(ref_column) ORDER BY ordinal) AS cols
  FROM fx_fk_col WHERE ref_column IS NOT NULL GROUP BY db_id, table_name, fk_name),
ix_cols AS (
  SELECT db_id, table_name, index_name, list(upper(column_name) ORDER BY ordinal) AS cols
  FROM fx_index_col GROUP BY db_id, table_name, index_name),
ixs AS (
  SELECT i.db_id, i.table_name, i.index_name, i.is_unique, i.is_desc,
         coalesce(c.cols, CAST([] AS VARCHAR[])) AS cols
  FROM fx_index i LEFT JOIN ix_cols c USING (db_id, table_name, index_name))
"""

PSQL_CTE = r"""
rt AS (
  SELECT db_id, kind, name, ignore_body,
         regexp_replace(coalesce(source, ''),
           '(''[^'']*(?:''''[^'']*)*(?:''|$))|--[^\r\n]*|/\*[\s\S]*?(?:\*/|$)', '\1', 'g') AS clean
  FROM fx_routine
  WHERE kind IN ('PROCEDURE', 'FUNCTION', 'TRIGGER') AND NOT (kind = 'PROCEDURE' AND coalesce(ignore_body, false))),
rb AS (
  SELECT db_id, kind, name,
         CASE WHEN regexp_matches(clean, '(?is)\bBEGIN\b.*\bEND\b')
              THEN regexp_extract(clean, '(?is)\bBEGIN\b(.*)\bEND\b', 1) END AS body
  FROM rt)
"""

FIELD_SQL = r"""
SELECT db_id, object_type, scope, sql_type, code FROM (
  SELECT c.db_id, c.object_type, c.scope, c.sql_type,
    CASE
      WHEN c.sql_type IS NULL OR trim(c.sql_type) = '' THEN 'CAMPO_TIPO_VAZIO'
      WHEN regexp_matches(upper(trim(c.sql_type)), '^(CHAR|VARCHAR)\s*\(\s*\d+\s*\)') THEN
        CASE WHEN CAST(regexp_extract(upper(trim(c.sql_type)), '^(CHAR|VARCHAR)\s*\(\s*(\d+)\s*\)', 2) AS BIGINT)
                  * greatest(1, coalesce(c.bytes_per_char, 1)) > 32765
             THEN 'CAMPO_TAMANHO_EFETIVO_EXCEDIDO' END
      WHEN regexp_matches(upper(trim(c.sql_type)), '^(NUMERIC|DECIMAL)\s*\(\s*\d+\s*(,\s*\d+\s*)?\)') THEN
        CASE WHEN CAST(regexp_extract(upper(trim(c.sql_type)), '^(NUMERIC|DECIMAL)\s*\(\s*(\d+)', 2) AS BIGINT) NOT BETWEEN 1 AND 38
               OR coalesce(TRY_CAST(regexp_extract(upper(trim(c.sql_type)), '^(NUMERIC|DECIMAL)\s*\(\s*\d+\s*,\s*(\d+)', 2) AS BIGINT), 0)
                  > CAST(regexp_extract(upper(trim(c.sql_type)), '^(NUMERIC|DECIMAL)\s*\(\s*(\d+)', 2) AS BIGINT)
             THEN 'CAMPO_PRECISAO_NUMERICA_INVALIDA'
             WHEN d.major < 4 AND CAST(regexp_extract(upper(trim(c.sql_type)), '^(NUMERIC|DECIMAL)\s*\(\s*(\d+)', 2) AS BIGINT) > 18
             THEN 'CAMPO_PRECISAO_NUMERICA_INCOMPATIVEL' END
      WHEN upper(trim(c.sql_type)) = 'BOOLEAN' AND d.major < 3 THEN 'CAMPO_TIPO_INCOMPATIVEL_VERSAO'
      WHEN upper(trim(c.sql_type)) IN ('DECFLOAT(16)', 'DECFLOAT(34)', 'INT128', 'TIME WITH TIME ZONE',
                                      'TIMESTAMP WITH TIME ZONE') AND d.major < 4 THEN 'CAMPO_TIPO_INCOMPATIVEL_VERSAO'
    END AS code
  FROM (SELECT db_id, 'column' AS object_type, table_name || '.' || column_name AS scope, sql_type, bytes_per_char FROM fx_column
        UNION ALL SELECT db_id, 'domain', 'DOMINIO.' || name, sql_type, bytes_per_char FROM fx_f_domain) c LEFT JOIN fx_database d USING (db_id)
) x
"""

RULE_SQL = {
    "table_without_columns": """
SELECT db_id, 'TABELA_SEM_COLUNAS' AS code, 'critical' AS severity, table_name AS scope FROM fx_table t
WHERE NOT EXISTS (SELECT 1 FROM fx_column c WHERE c.db_id = t.db_id AND c.table_name = t.table_name)""",
    "duplicated_column": """
SELECT db_id, 'COLUNA_DUPLICADA' AS code, 'critical' AS severity, table_name || '.' || arg_min(column_name, ordinal) AS scope
FROM fx_column GROUP BY db_id, table_name, upper(column_name) HAVING count(*) > 1""",
    "unknown_type": """
SELECT db_id, 'TIPO_DESCONHECIDO' AS code, 'high' AS severity, table_name || '.' || column_name AS scope
FROM fx_column WHERE starts_with(upper(sql_type), 'TYPE_')""",
    "table_without_pk": """
SELECT db_id, 'TABELA_SEM_PK' AS code, 'high' AS severity, table_name AS scope FROM fx_table t
WHERE NOT EXISTS (SELECT 1 FROM fx_pk p WHERE p.db_id = t.db_id AND p.table_name = t.table_name)""",
    "pk_without_columns": """
SELECT db_id, 'PK_SEM_COLUNAS' AS code, 'critical' AS severity, table_name AS scope FROM fx_pk p
WHERE NOT EXISTS (SELECT 1 FROM fx_pk_col c WHERE c.db_id = p.db_id AND c.table_name = p.table_name AND c.pk_name = p.pk_name)""",
    "pk_missing_column": """
SELECT db_id, 'PK_REFERENCIA_COLUNA_INEXISTENTE' AS code, 'critical' AS severity, table_name AS scope FROM fx_pk_col p
WHERE EXISTS (SELECT 1 FROM fx_pk k WHERE k.db_id = p.db_id AND k.table_name = p.table_name AND k.pk_name = p.pk_name)
  AND NOT EXISTS (SELECT 1 FROM fx_column c WHERE c.db_id = p.db_id AND c.table_name = p.table_name
                  AND upper(c.column_name) = upper(p.column_name))""",
    "fk_without_columns": f"""
WITH {FK_CTE}
SELECT db_id, 'FK_SEM_COLUNAS' AS code, 'critical' AS severity, table_name || '.' || fk_name AS scope FROM fkx WHERE NOT valid""",
    "fk_invalid_cardinality": f"""
WITH {FK_CTE}
SELECT db_id, 'FK_CARDINALIDADE_INVALIDA' AS code, 'critical' AS severity, table_name || '.' || fk_name AS scope
FROM fkx WHERE valid AND n_local <> n_ref""",
    "fk_missing_local_column": f"""
WITH {FK_CTE}
SELECT fc.db_id, 'FK_COLUNA_LOCAL_INEXISTENTE' AS code, 'critical' AS severity, fc.table_name || '.' || fc.fk_name AS scope
FROM fx_fk_col fc JOIN fkx f USING (db_id, table_name, fk_name)
WHERE f.valid AND fc.column_name IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM fx_column c WHERE c.db_id = fc.db_id AND c.table_name = fc.table_name
                  AND upper(c.column_name) = upper(fc.column_name))""",
    "fk_missing_referenced_table": f"""
WITH {FK_CTE}
SELECT db_id, 'FK_TABELA_REFERENCIA_INEXISTENTE' AS code, 'critical' AS severity, table_name || '.' || fk_name AS scope
FROM fkx f WHERE valid
  AND NOT EXISTS (SELECT 1 FROM fx_table t WHERE t.db_id = f.db_id AND upper(t.table_name) = upper(f.ref_table))""",
    "fk_missing_referenced_column": f"""
WITH {FK_CTE}
SELECT fc.db_id, 'FK_COLUNA_REFERENCIA_INEXISTENTE' AS code, 'critical' AS severity, fc.table_name || '.' || fc.fk_name AS scope
FROM fx_fk_col fc JOIN fkx f USING (db_id, table_name, fk_name)
WHERE f.valid AND fc.ref_column IS NOT NULL
  AND EXISTS (SELECT 1 FROM fx_table t WHERE t.db_id = f.db_id AND upper(t.table_name) = upper(f.ref_table))
  AND NOT EXISTS (SELECT 1 FROM fx_column c WHERE c.db_id = f.db_id AND upper(c.table_name) = upper(f.ref_table)
                  AND upper(c.column_name) = upper(fc.ref_column))""",
    "fk_without_covering_index": f"""
WITH {FK_CTE}
SELECT f.db_id, 'FK_SEM_INDICE_COBERTURA' AS code, 'medium' AS severity, f.table_name || '.' || f.fk_name AS scope
FROM fkx f JOIN fk_local l USING (db_id, table_name, fk_name)
WHERE f.valid AND trim(coalesce(f.support_index, '')) = ''
  AND NOT EXISTS (SELECT 1 FROM ixs i WHERE i.db_id = f.db_id AND i.table_name = f.table_name
                  AND len(i.cols) >= len(l.cols) AND i.cols[1:len(l.cols)] = l.cols)""",
    "duplicated_fk": f"""
WITH {FK_CTE}
SELECT db_id, 'FK_DUPLICADA' AS code, 'low' AS severity, table_name AS scope FROM (
  SELECT f.db_id, f.table_name,
         array_to_string(coalesce(l.cols, CAST([] AS VARCHAR[])), '|') || '->' || upper(f.ref_table) || '('
         || array_to_string(coalesce(r.cols, CAST([] AS VARCHAR[])), '|') || ')[' || upper(coalesce(f.update_rule, ''))
         || '|' || upper(coalesce(f.delete_rule, '')) || ']' AS sig
  FROM fx_fk f LEFT JOIN fk_local l USING (db_id, table_name, fk_name) LEFT JOIN fk_ref r USING (db_id, table_name, fk_name)
) s GROUP BY db_id, table_name, sig HAVING count(*) > 1""",
    "index_without_columns": """
SELECT db_id, 'INDICE_SEM_COLUNAS' AS code, 'high' AS severity, table_name || '.' || index_name AS scope FROM fx_index i
WHERE NOT EXISTS (SELECT 1 FROM fx_index_col c WHERE c.db_id = i.db_id AND c.table_name = i.table_name AND c.index_name = i.index_name)""",
    "index_missing_column": r"""
SELECT db_id, 'INDICE_COLUNA_INEXISTENTE' AS code, 'high' AS severity, table_name || '.' || index_name AS scope
FROM fx_index_col ic
WHERE NOT EXISTS (SELECT 1 FROM fx_column c WHERE c.db_id = ic.db_id AND c.table_name = ic.table_name
                  AND upper(c.column_name) = upper(ic.column_name))
  AND regexp_full_match(trim(ic.column_name), '(?i)[A-Z_][A-Z0-9_$]*')
  AND NOT regexp_matches(trim(ic.column_name), '[()'']')
  AND NOT regexp_matches(trim(ic.column_name), '\s[+\-*/]\s|\|\||<>|<=|>=|=|<|>')
  AND NOT regexp_matches(trim(ic.column_name), '(?i)\b(CASE|WHEN|THEN|ELSE|END|FROM|AS|IS|NULL|NOT|AND|OR)\b')""",
    "duplicated_index": f"""
WITH {FK_CTE}
SELECT db_id, 'INDICE_DUPLICADO' AS code, 'low' AS severity, table_name AS scope FROM (
  SELECT db_id, table_name, CASE WHEN is_unique THEN 'U' ELSE 'N' END || '|' || CASE WHEN is_desc THEN 'D' ELSE 'A' END
         || '|' || array_to_string(cols, '|') AS sig FROM ixs
) s GROUP BY db_id, table_name, sig HAVING count(*) > 1""",
    "redundant_prefix_index": f"""
WITH {FK_CTE}
SELECT s.db_id, 'INDICE_REDUNDANTE_PREFIXO' AS code, 'medium' AS severity, s.table_name AS scope FROM ixs s
WHERE NOT s.is_unique AND len(s.cols) > 0
  AND EXISTS (SELECT 1 FROM ixs l WHERE l.db_id = s.db_id AND l.table_name = s.table_name AND l.index_name <> s.index_name
              AND NOT l.is_unique AND l.is_desc = s.is_desc AND len(l.cols) > len(s.cols)
              AND l.cols[1:len(s.cols)] = s.cols)""",
    "psql_without_body": f"""
WITH {PSQL_CTE}
SELECT db_id, kind || '_SEM_CORPO' AS code, 'critical' AS severity, name AS scope FROM rb
WHERE body IS NULL OR NOT regexp_matches(body, '[^\\s;]')""",
    "psql_only_suspend": f"""
WITH {PSQL_CTE}
SELECT db_id, kind || '_SOMENTE_SUSPEND' AS code, 'high' AS severity, name AS scope FROM rb
WHERE upper(regexp_replace(body, '[\\s;]', '', 'g')) = 'SUSPEND'""",
    "field_compat": f"""
SELECT db_id, code, 'critical' AS severity, scope FROM ({FIELD_SQL}) fa WHERE code IS NOT NULL""",
}

RULE_FNS = {
    "table_without_columns": rules.rule_table_without_columns,
    "duplicated_column": rules.rule_duplicated_column,
    "unknown_type": rules.rule_unknown_type,
    "table_without_pk": rules.rule_table_without_pk,
    "pk_without_columns": rules.rule_pk_without_columns,
    "pk_missing_column": rules.rule_pk_missing_column,
    "fk_without_columns": rules.rule_fk_without_columns,
    "fk_invalid_cardinality": rules.rule_fk_invalid_cardinality,
    "fk_missing_local_column": rules.rule_fk_missing_local_column,
    "fk_missing_referenced_table": rules.rule_fk_missing_referenced_table,
    "fk_missing_referenced_column": rules.rule_fk_missing_referenced_column,
    "fk_without_covering_index": rules.rule_fk_without_covering_index,
    "duplicated_fk": rules.rule_duplicated_fk,
    "index_without_columns": rules.rule_index_without_columns,
    "index_missing_column": rules.rule_index_missing_column,
    "duplicated_index": rules.rule_duplicated_index,
    "redundant_prefix_index": rules.rule_redundant_prefix_index,
    "psql_without_body": rules.rule_routine_without_body,
    "psql_only_suspend": rules.rule_routine_only_suspend,
    "field_compat": rules.rule_field_compat,
}


def _register_rule(key: str):
    fn = RULE_FNS[key]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fnd.score_findings(fn(fixture_catalog(spark, sf_dir)).select(*rules.FINDING_COLS))

    register(f"rule_{key}", scored(RULE_SQL[key]))(run)


for _k in RULE_SQL:
    _register_rule(_k)

OPERATIONAL_SQL = f"""
WITH newest AS (SELECT db_id, oit, oat, ost, ts AS as_of FROM (
    SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY ts DESC, sample_id DESC) AS rn FROM fx_monitor) m WHERE rn = 1),
oldest AS (
  SELECT m.db_id, (epoch_us(max(n.as_of)) - epoch_us(min(m.ts))) / 6e7 AS age FROM fx_monitor m JOIN newest n USING (db_id)
  WHERE m.tx_state = 1 AND m.attachment_id <> m.db_id AND m.ts <= n.as_of GROUP BY m.db_id)
SELECT db_id, code, severity, scope FROM ({GAP_SQL.format(src="(SELECT *, 0 AS sample_id FROM newest) ns")}) gaps
WHERE db_id IN (SELECT db_id FROM fx_database)
UNION ALL
SELECT db_id, CASE WHEN age >= 720 THEN 'OPERACIONAL_TRANSACAO_ATIVA_LONGA_CRITICA'
                   WHEN age >= 120 THEN 'OPERACIONAL_TRANSACAO_ATIVA_LONGA'
                   ELSE 'OPERACIONAL_TRANSACAO_ATIVA_ACIMA_DO_ESPERADO' END,
       CASE WHEN age >= 720 THEN 'critical' WHEN age >= 120 THEN 'high' ELSE 'medium' END, 'OPERACIONAL.TRANSACTIONS'
FROM oldest WHERE age >= 30 AND db_id IN (SELECT db_id FROM fx_database)"""

ALL_FINDINGS_SQL = scored("\nUNION ALL\n".join(f"SELECT db_id, code, severity, scope FROM ({sql}) r_{i}"
                                               for i, sql in enumerate([*RULE_SQL.values(), OPERATIONAL_SQL])))


_scored: WeakKeyDictionary[SparkSession, dict] = WeakKeyDictionary()


def all_findings(spark: SparkSession, sf_dir: str, prefixes=(), overrides=None) -> DataFrame:
    """Scored findings of every rule, as a plan that nothing keeps but the
    catalog's columns by name and column lists of indexes, which several rules
    read (``rules.keep_shared``)."""
    cat = fixture_catalog(spark, sf_dir)
    rules.keep_shared(cat, keep_shared_table)
    return fnd.analyze(cat, prefixes, overrides)


def keep_shared_table(df: DataFrame, *order: str) -> DataFrame:
    # the frame is in its buckets already
    return df.sparkSession.table(keep_table(df, *order)).hint("merge")


def kept_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings written once per session and folder as parquet in the
    checkpoint folder, for summaries that read them more than once: a sort or a
    second aggregate does not run the rules again, and no memory is held."""
    known = _scored.setdefault(spark, {})
    if sf_dir not in known:
        known[sf_dir] = keep_rows([all_findings(spark, sf_dir)])
    return known[sf_dir]


register("all_findings", ALL_FINDINGS_SQL)(lambda spark, sf: all_findings(spark, sf))

FINDINGS_CTE = f"findings AS ({ALL_FINDINGS_SQL})"


@register("severity_totals", f"""
WITH {FINDINGS_CTE}
SELECT db_id, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical,
       count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
       count(*) FILTER (WHERE severity = 'low') AS low
FROM findings GROUP BY db_id""")
def q_severity_totals(spark, sf_dir):
    return fnd.severity_totals(all_findings(spark, sf_dir))


# exact half-to-even percentage in integers: q = floor(n*10000/t), r = remainder
PCT_SQL = """(CASE WHEN 2 * ((n * 10000) % t) > t OR (2 * ((n * 10000) % t) = t AND ((n * 10000) // t) % 2 = 1)
      THEN (n * 10000) // t + 1 ELSE (n * 10000) // t END)"""


@register("summary_by_code", f"""
WITH {FINDINGS_CTE},
per AS (SELECT db_id, min(code) AS code, count(*) AS n FROM findings GROUP BY db_id, upper(code)),
tot AS (SELECT db_id, sum(n) AS t FROM per GROUP BY db_id)
SELECT db_id, code, n, CAST({PCT_SQL} AS DOUBLE) / 100 AS percent FROM per JOIN tot USING (db_id)""")
def q_summary_by_code(spark, sf_dir):
    return fnd.summary_by_code(kept_findings(spark, sf_dir))


@register("summary_by_table", f"""
WITH {FINDINGS_CTE},
per AS (SELECT db_id, min(CASE WHEN trim(scope) = '' THEN '?' ELSE split_part(scope, '.', 1) END) AS table_name,
               count(*) AS n
        FROM findings GROUP BY db_id, upper(CASE WHEN trim(scope) = '' THEN '?' ELSE split_part(scope, '.', 1) END)),
tot AS (SELECT db_id, sum(n) AS t FROM per GROUP BY db_id)
SELECT db_id, table_name, n, CAST({PCT_SQL} AS DOUBLE) / 100 AS percent FROM per JOIN tot USING (db_id)""")
def q_summary_by_table(spark, sf_dir):
    return fnd.summary_by_table(kept_findings(spark, sf_dir))


@register("risk_by_table", f"""
WITH {FINDINGS_CTE},
g AS (SELECT db_id, min(split_part(scope, '.', 1)) AS table_name, count(*) AS n, max(score) AS mx, avg(score) AS av
      FROM findings GROUP BY db_id, upper(split_part(scope, '.', 1))),
r AS (SELECT *, LEAST(100, CAST(round_even(CAST(mx AS DOUBLE) * CAST(0.5 AS DOUBLE) + av * CAST(0.4 AS DOUBLE)
                                            + LEAST(10, n), 0) AS BIGINT)) AS risk_index FROM g)
SELECT db_id, table_name, n, risk_index,
       CASE WHEN risk_index >= 85 THEN 'P0' WHEN risk_index >= 70 THEN 'P1' WHEN risk_index >= 45 THEN 'P2' ELSE 'P3' END AS priority
FROM r""")
def q_risk_by_table(spark, sf_dir):
    return fnd.risk_by_table(all_findings(spark, sf_dir))


@register("top5_with_others", f"""
WITH {FINDINGS_CTE},
per AS (SELECT db_id, min(code) AS code, count(*) AS n FROM findings GROUP BY db_id, upper(code)),
tot AS (SELECT db_id, sum(n) AS t FROM per GROUP BY db_id),
pc AS (SELECT db_id, code, n, {PCT_SQL} AS p100 FROM per JOIN tot USING (db_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY n DESC, upper(code)) AS rn FROM pc)
SELECT db_id, CASE WHEN rn <= 5 THEN code ELSE 'OTHERS' END AS code, CAST(sum(n) AS BIGINT) AS n,
       CAST(sum(p100) AS DOUBLE) / 100 AS percent, min(rn) AS rank
FROM rk GROUP BY db_id, CASE WHEN rn <= 5 THEN code ELSE 'OTHERS' END""")
def q_top5(spark, sf_dir):
    return fnd.top5_with_others(kept_findings(spark, sf_dir))


@register("object_counts", """
SELECT d.db_id,
  (SELECT count(*) FROM fx_table t WHERE t.db_id = d.db_id) AS tables,
  (SELECT count(*) FROM fx_index i WHERE i.db_id = d.db_id) AS indexes,
  (SELECT count(*) FROM fx_pk p WHERE p.db_id = d.db_id) AS pks,
  (SELECT count(*) FROM fx_fk f WHERE f.db_id = d.db_id) AS fks,
  (SELECT count(*) FROM fx_routine r WHERE r.db_id = d.db_id AND r.kind = 'TRIGGER') AS triggers,
  (SELECT count(*) FROM fx_routine r WHERE r.db_id = d.db_id AND r.kind = 'PROCEDURE') AS procedures,
  (SELECT count(*) FROM fx_routine r WHERE r.db_id = d.db_id AND r.kind = 'FUNCTION') AS functions
FROM fx_database d""")
def q_object_counts(spark, sf_dir):
    return fnd.object_counts(fixture_catalog(spark, sf_dir))


# ---------------------------------------------------------------- fleet

def _fleet_sql(select: str) -> str:
    return f"""
WITH {FINDINGS_CTE},
tot AS (SELECT db_id, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical,
               count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
               count(*) FILTER (WHERE severity = 'low') AS low FROM findings GROUP BY db_id),
per AS (SELECT db_id, min(code) AS code, count(*) AS n FROM findings GROUP BY db_id, upper(code)),
top3 AS (SELECT db_id, string_agg(code || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY rn) AS top_codes
         FROM (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY n DESC, upper(code)) AS rn FROM per) r
         WHERE rn <= 3 GROUP BY db_id),
tabs AS (SELECT db_id, count(*) AS tables FROM fx_table GROUP BY db_id),
by_db AS (
  SELECT d.db_id, coalesce(tabs.tables, 0) AS tables, coalesce(tot.total, 0) AS total,
         coalesce(tot.critical, 0) AS critical, coalesce(tot.high, 0) AS high, coalesce(tot.medium, 0) AS medium,
         coalesce(tot.low, 0) AS low,
         CASE WHEN coalesce(tot.total, 0) = 0 THEN 'none' WHEN tot.critical > 0 THEN 'critical'
              WHEN tot.high > 0 THEN 'high' WHEN tot.medium > 0 THEN 'medium' ELSE 'low' END AS highest_severity,
         coalesce(top3.top_codes, '') AS top_codes
  FROM fx_database d LEFT JOIN tabs USING (db_id) LEFT JOIN tot USING (db_id) LEFT JOIN top3 USING (db_id))
{select}"""


def _fleet(spark, sf_dir):
    return fleet_ops.fleet_by_database(fixture_catalog(spark, sf_dir), kept_findings(spark, sf_dir))


register("fleet_by_database", _fleet_sql("SELECT * FROM by_db"))(_fleet)

register("fleet_totals", _fleet_sql("""
SELECT count(*) AS databases, count(*) FILTER (WHERE total > 0) AS with_findings,
       count(*) FILTER (WHERE critical > 0) AS with_criticals, CAST(sum(tables) AS BIGINT) AS tables,
       CAST(sum(total) AS BIGINT) AS total, CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high,
       CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low FROM by_db"""))(
    lambda spark, sf: fleet_ops.fleet_totals(_fleet(spark, sf)))

register("top3_codes", _fleet_sql("SELECT db_id, top_codes FROM top3"))(
    lambda spark, sf: fleet_ops.top_codes(all_findings(spark, sf)))

register("fleet_by_code", f"""
WITH {FINDINGS_CTE},
per AS (SELECT min(code) AS code, count(*) AS n FROM findings GROUP BY upper(code)),
tot AS (SELECT sum(n) AS t FROM per)
SELECT code, n, CASE WHEN t = 0 THEN 0.0 ELSE CAST({PCT_SQL} AS DOUBLE) / 100 END AS percent FROM per, tot""")(
    lambda spark, sf: fleet_ops.fleet_by_code(all_findings(spark, sf)))


# ---------------------------------------------------------------- prefixes, overrides, filters

DEMO_PREFIXES = ("T1", " t2 ", "t1")


@register("ignore_prefixes", f"""
WITH vis AS (SELECT db_id, table_name FROM fx_table
             WHERE NOT (starts_with(upper(table_name), 'T1') OR starts_with(upper(table_name), 'T2'))),
ign AS (SELECT db_id, upper(table_name) AS tkey FROM fx_table
        WHERE starts_with(upper(table_name), 'T1') OR starts_with(upper(table_name), 'T2')),
{FK_CTE}
SELECT db_id, 'TABELA_SEM_PK' AS code, 'high' AS severity, table_name AS scope FROM vis t
WHERE NOT EXISTS (SELECT 1 FROM fx_pk p WHERE p.db_id = t.db_id AND p.table_name = t.table_name)
UNION ALL
SELECT db_id, 'FK_TABELA_REFERENCIA_INEXISTENTE', 'critical', table_name || '.' || fk_name FROM fkx f
WHERE valid AND EXISTS (SELECT 1 FROM vis v WHERE v.db_id = f.db_id AND v.table_name = f.table_name)
  AND NOT EXISTS (SELECT 1 FROM ign i WHERE i.db_id = f.db_id AND i.tkey = upper(f.ref_table))
  AND NOT EXISTS (SELECT 1 FROM vis t WHERE t.db_id = f.db_id AND upper(t.table_name) = upper(f.ref_table))
UNION ALL
SELECT db_id, 'INDICE_SEM_COLUNAS', 'high', table_name || '.' || index_name FROM fx_index i
WHERE EXISTS (SELECT 1 FROM vis v WHERE v.db_id = i.db_id AND v.table_name = i.table_name)
  AND NOT EXISTS (SELECT 1 FROM fx_index_col c WHERE c.db_id = i.db_id AND c.table_name = i.table_name
                  AND c.index_name = i.index_name)""")
def q_ignore_prefixes(spark, sf_dir):
    """Tables named by ignored prefixes are skipped, and FKs pointing
    at them skip the reference checks."""
    cat = fixture_catalog(spark, sf_dir)
    p = DEMO_PREFIXES
    return (rules.rule_table_without_pk(cat, p)
            .unionByName(rules.rule_fk_missing_referenced_table(cat, p))
            .unionByName(rules.rule_index_without_columns(cat, p)))


# override configuration (English aliases, as a user writes it)
DEMO_OVERRIDES = [("TABLE_WITHOUT_PK", "low"), ("TABLE_WITHOUT_PK", "Critical "), ("fk_without_covering_index", "high"),
                  ("DUPLICATED_INDEX", "medium")]


def demo_overrides(spark):
    raw = spark.createDataFrame([(*o, k) for k, o in enumerate(DEMO_OVERRIDES)], "code string, severity string, position int")
    return valid_overrides(normalize_overrides(raw, spark))


_OVERRIDE_FINDINGS = f"""SELECT db_id, code,
  CASE code WHEN 'TABELA_SEM_PK' THEN 'critical' WHEN 'FK_SEM_INDICE_COBERTURA' THEN 'high'
            WHEN 'INDICE_DUPLICADO' THEN 'medium' ELSE severity END AS severity, scope
FROM ({ALL_FINDINGS_SQL}) a"""

register("override_lookup", scored(_OVERRIDE_FINDINGS))(
    lambda spark, sf: all_findings(spark, sf, overrides=demo_overrides(spark)))


@register("filter_findings", f"""
WITH {FINDINGS_CTE}
SELECT * FROM findings WHERE severity = 'high' AND code = 'INDICE_COLUNA_INEXISTENTE'
  AND contains(lower(concat_ws(' ', scope, code)), 'ix_1')""")
def q_filter_findings(spark, sf_dir):
    # not the persisted findings: the plan keeps only the rules of the code
    return fnd.filter_findings(fnd.analyze(fixture_catalog(spark, sf_dir)), severity="high",
                               code="INDICE_COLUNA_INEXISTENTE", text="IX_1")


@register("order_findings", f"WITH {FINDINGS_CTE} SELECT * FROM findings")
def q_order_findings(spark, sf_dir):
    return fnd.order_findings(kept_findings(spark, sf_dir))


@register("ranked_findings", f"""
WITH {FINDINGS_CTE}
SELECT db_id, row_number() OVER (PARTITION BY db_id ORDER BY score DESC,
         CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, upper(code), upper(scope), code, scope) AS rank,
       severity, score, priority, code, scope FROM findings""")
def q_ranked_findings(spark, sf_dir):
    """The order itself, as a rank."""
    return fnd.ranked_findings(kept_findings(spark, sf_dir))


@register("first_longer_index", f"""
WITH {FK_CTE}
SELECT s.db_id, s.table_name, s.index_name AS short_name, arg_min(l.index_name, upper(l.index_name)) AS long_name
FROM ixs s JOIN ixs l ON l.db_id = s.db_id AND l.table_name = s.table_name AND l.index_name <> s.index_name
WHERE NOT s.is_unique AND NOT l.is_unique AND l.is_desc = s.is_desc AND len(s.cols) > 0
  AND len(l.cols) > len(s.cols) AND l.cols[1:len(s.cols)] = s.cols
GROUP BY s.db_id, s.table_name, s.index_name""")
def q_first_longer_index(spark, sf_dir):
    return rules.redundant_prefix_pairs(fixture_catalog(spark, sf_dir))


# ---------------------------------------------------------------- signatures and duplicate groups

@register("signatures", f"""
WITH {FK_CTE},
pk_l AS (SELECT db_id, table_name, pk_name, list(upper(column_name) ORDER BY ordinal) AS cols
         FROM fx_pk_col WHERE column_name IS NOT NULL GROUP BY ALL)
SELECT p.db_id, p.table_name, 'PK' AS kind, p.pk_name AS name,
       array_to_string(coalesce(l.cols, CAST([] AS VARCHAR[])), '|') AS signature
FROM fx_pk p LEFT JOIN pk_l l USING (db_id, table_name, pk_name)
UNION ALL
SELECT f.db_id, f.table_name, 'FK', f.fk_name,
       array_to_string(coalesce(l.cols, CAST([] AS VARCHAR[])), '|') || '->' || upper(f.ref_table) || '('
       || array_to_string(coalesce(r.cols, CAST([] AS VARCHAR[])), '|') || ')[' || upper(f.update_rule)
       || '|' || upper(f.delete_rule) || ']'
FROM fx_fk f LEFT JOIN fk_local l USING (db_id, table_name, fk_name) LEFT JOIN fk_ref r USING (db_id, table_name, fk_name)
UNION ALL
SELECT db_id, table_name, 'INDEX', index_name,
       CASE WHEN is_unique THEN 'U' ELSE 'N' END || '|' || CASE WHEN is_desc THEN 'D' ELSE 'A' END || '|'
       || array_to_string(cols, '|') FROM ixs""")
def q_signatures(spark, sf_dir):
    from ..operators.catalog import ordered_names
    cat = fixture_catalog(spark, sf_dir)
    keys = ["db_id", "table_name", "pk_name"]
    pk_l = ordered_names(cat.pk_cols, keys, "column_name", "cols")
    pk = (cat.pks.join(pk_l, keys, "left")
                 .select("db_id", "table_name", F.lit("PK").alias("kind"), F.col("pk_name").alias("name"),
                         F.array_join(F.coalesce("cols", F.array().cast("array<string>")), "|").alias("signature")))
    fk = rules.fk_signatures(cat).select("db_id", "table_name", F.lit("FK").alias("kind"),
                                         F.col("fk_name").alias("name"), "signature")
    ix = rules.index_signatures(cat).select("db_id", "table_name", F.lit("INDEX").alias("kind"),
                                            F.col("index_name").alias("name"), "signature")
    return pk.unionByName(fk).unionByName(ix)


@register("duplicate_groups", f"""
WITH {FK_CTE}
SELECT db_id, table_name, 'COLUMN' AS kind, upper(column_name) AS signature, count(*) AS n
FROM fx_column GROUP BY db_id, table_name, upper(column_name) HAVING count(*) > 1
UNION ALL
SELECT db_id, table_name, 'FK', sig, count(*) FROM (
  SELECT f.db_id, f.table_name,
         array_to_string(coalesce(l.cols, CAST([] AS VARCHAR[])), '|') || '->' || upper(f.ref_table) || '('
         || array_to_string(coalesce(r.cols, CAST([] AS VARCHAR[])), '|') || ')[' || upper(f.update_rule)
         || '|' || upper(f.delete_rule) || ']' AS sig
  FROM fx_fk f LEFT JOIN fk_local l USING (db_id, table_name, fk_name) LEFT JOIN fk_ref r USING (db_id, table_name, fk_name)
) s GROUP BY db_id, table_name, sig HAVING count(*) > 1
UNION ALL
SELECT db_id, table_name, 'INDEX', sig, count(*) FROM (
  SELECT db_id, table_name, CASE WHEN is_unique THEN 'U' ELSE 'N' END || '|' || CASE WHEN is_desc THEN 'D' ELSE 'A' END
         || '|' || array_to_string(cols, '|') AS sig FROM ixs
) s GROUP BY db_id, table_name, sig HAVING count(*) > 1""")
def q_duplicate_groups(spark, sf_dir):
    """Groups with more than one member, by name or signature."""
    cat = fixture_catalog(spark, sf_dir)
    keys = ["db_id", "table_name"]
    cols = (cat.columns.groupBy(*keys, F.upper("column_name").alias("signature"))
            .agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("kind", F.lit("COLUMN")))
    fk = (rules.fk_signatures(cat).groupBy(*keys, "signature").agg(F.count(F.lit(1)).alias("n"))
          .where("n > 1").withColumn("kind", F.lit("FK")))
    ix = (rules.index_signatures(cat).groupBy(*keys, "signature").agg(F.count(F.lit(1)).alias("n"))
          .where("n > 1").withColumn("kind", F.lit("INDEX")))
    return cols.unionByName(fk).unionByName(ix).select(*keys, "kind", "signature", "n")


# ---------------------------------------------------------------- field audit

@register("field_audit", f"""
SELECT db_id, object_type, scope, sql_type, code, 'critical' AS status
FROM ({FIELD_SQL}) fa WHERE code IS NOT NULL""")
def q_field_audit(spark, sf_dir):
    """S13 input: problem items only (the default)."""
    return rules.field_audit(fixture_catalog(spark, sf_dir)).select(
        "db_id", "object_type", "scope", "sql_type", "code", "status")


@register("field_audit_totals", f"""
SELECT db_id, count(*) AS items, count(*) FILTER (WHERE code IS NULL) AS ok,
       count(*) FILTER (WHERE code IS NOT NULL) AS problems
FROM ({FIELD_SQL}) fa GROUP BY db_id""")
def q_field_audit_totals(spark, sf_dir):
    """A10: items, ok, problems per database."""
    items = rules.field_audit(fixture_catalog(spark, sf_dir), include_ok=True)
    return items.groupBy("db_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") != "ok").alias("problems"))


# ---------------------------------------------------------------- S04 snapshot documents

@register("snapshot_roundtrip", """
SELECT 'tables' AS kind, count(*) AS n FROM fx_table UNION ALL SELECT 'columns', count(*) FROM fx_column
UNION ALL SELECT 'pks', count(*) FROM fx_pk UNION ALL SELECT 'pk_cols', count(*) FROM fx_pk_col
UNION ALL SELECT 'fks', count(*) FROM fx_fk UNION ALL SELECT 'fk_cols', count(*) FROM fx_fk_col
UNION ALL SELECT 'indexes', count(*) FROM fx_index UNION ALL SELECT 'index_cols', count(*) FROM fx_index_col
UNION ALL SELECT 'routines', count(*) FROM fx_routine""")
def q_snapshot_roundtrip(spark, sf_dir):
    """Fleet catalog -> one JSON row for each object (shared checkpoint folder)
    -> read back with explicit schemas -> catalog tables."""
    from ..sources import snapshots as SN
    path = SN.snapshot_dir(spark, f"snapshots-{uuid.uuid4().hex}")
    SN.write_objects(fixture_catalog(spark, sf_dir), path)
    back = SN.catalog_from_objects(SN.read_objects(spark, path))
    parts = [("tables", back.tables), ("columns", back.columns), ("pks", back.pks), ("pk_cols", back.pk_cols),
             ("fks", back.fks), ("fk_cols", back.fk_cols), ("indexes", back.indexes),
             ("index_cols", back.index_cols), ("routines", back.routines)]
    out = None
    for kind, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = c if out is None else out.unionByName(c)
    return out
