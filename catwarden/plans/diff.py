"""Diff queries (D01-D14, U02, W06) and dependency graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import graph as G
from ..operators.catalog import fixture_catalog
from ..sources.fixtures import fixture, keep_buckets, keep_rows
from .registry import register

def _sides(spark, sf_dir):
    return fixture_catalog(spark, sf_dir, "source"), fixture_catalog(spark, sf_dir, "target")


def _full(spark, sf_dir):
    """The whole diff. Nothing is persisted: a query of one bucket or object
    type is planned over the parts that can give it. Commands are written by
    object kind before they are ordered."""
    return D.diff(*_sides(spark, sf_dir), include_domains=True, keep=keep_rows)


# ---------------------------------------------------------------- oracle SQL

def q(x: str) -> str:
    return f"""('"' || replace({x}, '"', '""') || '"')"""


def ql(x: str) -> str:
    return f"""array_to_string(list_transform({x}, lambda v: '"' || replace(v, '"', '""') || '"'), ', ')"""


def blank(x: str) -> str:
    return f"""({x} IS NULL OR regexp_replace({x}, '\\s', '', 'g') = '')"""


def trim_ws(x: str) -> str:
    return f"""regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"""


COLDEF = f"""CASE WHEN {blank('computed_sql')} THEN {q('column_name')} || ' ' || sql_type
  || CASE WHEN {blank('default_sql')} THEN '' ELSE ' ' || default_sql END
  || CASE WHEN coalesce(nullable, true) THEN '' ELSE ' NOT NULL' END
  ELSE {q('column_name')} || ' COMPUTED BY ' || computed_sql END"""

DIFF_CTE = f"""
s_tab AS (SELECT db_id, table_name, upper(table_name) AS tkey FROM fx_table),
t_tab AS (SELECT db_id, table_name, upper(table_name) AS tkey FROM fx_t_table),
common AS (SELECT s.db_id, s.tkey, s.table_name FROM s_tab s JOIN t_tab t USING (db_id, tkey)),
s_col AS (SELECT c.*, upper(c.table_name) AS tkey, upper(c.column_name) AS ckey FROM fx_u_column c),
t_col AS (SELECT c.*, upper(c.table_name) AS tkey, upper(c.column_name) AS ckey FROM fx_t_column c),
s_cc AS (SELECT * FROM s_col WHERE (db_id, tkey) IN (SELECT (db_id, tkey) FROM common)),
t_cc AS (SELECT * FROM t_col WHERE (db_id, tkey) IN (SELECT (db_id, tkey) FROM common)),
missing_tab AS (SELECT * FROM s_tab s WHERE NOT EXISTS (SELECT 1 FROM t_tab t WHERE t.db_id = s.db_id AND t.tkey = s.tkey)),
fk_l AS (SELECT db_id, table_name, fk_name, list(column_name ORDER BY ordinal, column_name) AS cols
         FROM fx_fk_col WHERE column_name IS NOT NULL GROUP BY ALL),
fk_r AS (SELECT db_id, table_name, fk_name, list(ref_column ORDER BY ordinal, ref_column) AS cols
         FROM fx_fk_col WHERE ref_column IS NOT NULL GROUP BY ALL),
ix_l AS (SELECT db_id, table_name, index_name, list(column_name ORDER BY ordinal, column_name) AS cols
         FROM fx_index_col GROUP BY ALL),
fk_any AS (
  SELECT f.db_id, f.table_name, upper(f.table_name) AS tkey, f.fk_name, f.ref_table, f.update_rule, f.delete_rule,
         coalesce(l.cols, CAST([] AS VARCHAR[])) AS cols, coalesce(r.cols, CAST([] AS VARCHAR[])) AS ref_cols,
         upper(array_to_string(coalesce(l.cols, CAST([] AS VARCHAR[])), '|') || '->' || f.ref_table || '('
               || array_to_string(coalesce(r.cols, CAST([] AS VARCHAR[])), '|') || ')[' || coalesce(f.update_rule, '')
               || '|' || coalesce(f.delete_rule, '') || ']') AS sig, f.side
  FROM (SELECT *, 'S' AS side FROM fx_fk UNION ALL SELECT *, 'T' AS side FROM fx_t_fk) f
  LEFT JOIN fk_l l USING (db_id, table_name, fk_name) LEFT JOIN fk_r r USING (db_id, table_name, fk_name)),
ix_any AS (
  SELECT i.db_id, i.table_name, upper(i.table_name) AS tkey, i.index_name, i.is_unique, i.is_desc,
         coalesce(l.cols, CAST([] AS VARCHAR[])) AS cols,
         CASE WHEN i.is_unique THEN 'U' ELSE 'N' END || '|' || CASE WHEN i.is_desc THEN 'D' ELSE 'A' END || '|'
         || upper(array_to_string(coalesce(l.cols, CAST([] AS VARCHAR[])), '|')) AS sig, i.side
  FROM (SELECT db_id, table_name, index_name, is_unique, is_desc, 'S' AS side FROM fx_index
        UNION ALL SELECT db_id, table_name, index_name, is_unique, is_desc, 'T' FROM fx_t_index) i
  LEFT JOIN ix_l l USING (db_id, table_name, index_name)),
fk_rank AS (
  SELECT *, row_number() OVER w AS rn, first_value(fk_name) OVER w AS first_name FROM fk_any
  WHERE (db_id, tkey) IN (SELECT (db_id, tkey) FROM common)
  WINDOW w AS (PARTITION BY side, db_id, tkey, sig ORDER BY upper(fk_name), fk_name)),
ix_rank AS (
  SELECT *, row_number() OVER w AS rn, first_value(index_name) OVER w AS first_name FROM ix_any
  WHERE (db_id, tkey) IN (SELECT (db_id, tkey) FROM common)
  WINDOW w AS (PARTITION BY side, db_id, tkey, sig ORDER BY upper(index_name), index_name)),
fk_missing AS (SELECT * FROM fk_rank s WHERE side = 'S' AND rn = 1
  AND NOT EXISTS (SELECT 1 FROM fk_rank t WHERE t.side = 'T' AND t.rn = 1 AND t.db_id = s.db_id AND t.tkey = s.tkey AND t.sig = s.sig)),
fk_tonly AS (SELECT * FROM fk_rank t WHERE side = 'T' AND rn = 1
  AND NOT EXISTS (SELECT 1 FROM fk_rank s WHERE s.side = 'S' AND s.rn = 1 AND t.db_id = s.db_id AND t.tkey = s.tkey AND t.sig = s.sig)),
ix_missing AS (SELECT * FROM ix_rank s WHERE side = 'S' AND rn = 1
  AND NOT EXISTS (SELECT 1 FROM ix_rank t WHERE t.side = 'T' AND t.rn = 1 AND t.db_id = s.db_id AND t.tkey = s.tkey AND t.sig = s.sig)),
ix_tonly AS (SELECT * FROM ix_rank t WHERE side = 'T' AND rn = 1
  AND NOT EXISTS (SELECT 1 FROM ix_rank s WHERE s.side = 'S' AND s.rn = 1 AND t.db_id = s.db_id AND t.tkey = s.tkey AND t.sig = s.sig)),
both_col AS (
  SELECT s.db_id, s.table_name, s.column_name, s.sql_type, s.nullable, s.default_sql, s.computed_sql,
         t.sql_type AS t_sql_type, t.nullable AS t_nullable, t.default_sql AS t_default_sql, t.computed_sql AS t_computed_sql,
         upper(s.computed_sql) IS NOT DISTINCT FROM upper(t.computed_sql) AS same_computed
  FROM s_cc s JOIN t_cc t USING (db_id, tkey, ckey)),
pk_l AS (SELECT db_id, table_name, pk_name, list(column_name ORDER BY ordinal, column_name) AS cols FROM fx_pk_col
         WHERE column_name IS NOT NULL GROUP BY ALL),
t_pk_l AS (SELECT db_id, table_name, pk_name, list(column_name ORDER BY ordinal, column_name) AS cols FROM fx_t_pk_col
           WHERE column_name IS NOT NULL GROUP BY ALL),
s_pk AS (SELECT p.db_id, upper(p.table_name) AS tkey, p.table_name, p.pk_name, coalesce(l.cols, CAST([] AS VARCHAR[])) AS cols
         FROM fx_pk p LEFT JOIN pk_l l USING (db_id, table_name, pk_name)),
t_pk AS (SELECT p.db_id, upper(p.table_name) AS tkey, p.pk_name, coalesce(l.cols, CAST([] AS VARCHAR[])) AS cols
         FROM fx_t_pk p LEFT JOIN t_pk_l l USING (db_id, table_name, pk_name)),
pk_diff AS (
  SELECT c.db_id, c.table_name, s.pk_name, s.cols, t.pk_name AS t_pk_name
  FROM common c LEFT JOIN s_pk s USING (db_id, tkey) LEFT JOIN t_pk t USING (db_id, tkey)
  WHERE coalesce(upper(array_to_string(s.cols, '|')), '') <> coalesce(upper(array_to_string(t.cols, '|')), '')),
r_all AS (
  SELECT coalesce(s.db_id, t.db_id) AS db_id, coalesce(s.kind, t.kind) AS kind, s.name, s.source, t.name AS t_name,
         t.source AS t_source
  FROM fx_routine s FULL OUTER JOIN fx_t_routine t ON s.db_id = t.db_id AND s.kind = t.kind AND upper(s.name) = upper(t.name)),
r_diff AS (
  SELECT * FROM r_all WHERE name IS NOT NULL AND t_name IS NOT NULL
   AND upper({trim_ws("regexp_replace(coalesce(source, ''), '\\r\\n?', chr(10), 'g')")})
       <> upper({trim_ws("regexp_replace(coalesce(t_source, ''), '\\r\\n?', chr(10), 'g')")})),
s_uq AS (SELECT db_id, table_name, upper(table_name) AS tkey, name, list(column_name ORDER BY ordinal, column_name) AS cols
         FROM fx_unique GROUP BY db_id, table_name, name),
t_uq AS (SELECT db_id, table_name, upper(table_name) AS tkey, name, list(column_name ORDER BY ordinal, column_name) AS cols
         FROM fx_t_unique GROUP BY db_id, table_name, name),
uq_all AS (
  SELECT coalesce(s.db_id, t.db_id) AS db_id, s.table_name, s.name, s.cols, t.table_name AS t_table, t.name AS t_name, t.cols AS t_cols
  FROM (SELECT * FROM s_uq SEMI JOIN common USING (db_id, tkey)) s
  FULL OUTER JOIN (SELECT * FROM t_uq SEMI JOIN common USING (db_id, tkey)) t
  ON s.db_id = t.db_id AND s.tkey = t.tkey AND upper(s.name) = upper(t.name)),
ck_all AS (
  SELECT coalesce(s.db_id, t.db_id) AS db_id, s.table_name, s.name, s.check_sql, t.table_name AS t_table, t.name AS t_name,
         t.check_sql AS t_check
  FROM (SELECT *, upper(table_name) AS tkey FROM fx_check WHERE (db_id, upper(table_name)) IN (SELECT (db_id, tkey) FROM common)) s
  FULL OUTER JOIN (SELECT *, upper(table_name) AS tkey FROM fx_t_check
                   WHERE (db_id, upper(table_name)) IN (SELECT (db_id, tkey) FROM common)) t
  ON s.db_id = t.db_id AND s.tkey = t.tkey AND upper(s.name) = upper(t.name)),
sq_all AS (SELECT coalesce(s.db_id, t.db_id) AS db_id, s.name, t.name AS t_name FROM fx_sequence s
           FULL OUTER JOIN fx_t_sequence t ON s.db_id = t.db_id AND upper(s.name) = upper(t.name)),
vw_all AS (SELECT coalesce(s.db_id, t.db_id) AS db_id, s.name, s.select_sql, t.name AS t_name, t.select_sql AS t_select FROM fx_view s
           FULL OUTER JOIN fx_t_view t ON s.db_id = t.db_id AND upper(s.name) = upper(t.name)),
dm_all AS (
  SELECT coalesce(s.db_id, t.db_id) AS db_id, s.name, s.sql_type, s.nullable, s.default_sql, s.check_sql, s.charset, t.name AS t_name,
         (upper(s.sql_type), s.nullable, upper(s.default_sql), upper(s.check_sql), upper(s.charset))
         IS DISTINCT FROM (upper(t.sql_type), t.nullable, upper(t.default_sql), upper(t.check_sql), upper(t.charset)) AS differs
  FROM (SELECT * FROM fx_domain WHERE NOT starts_with(upper(name), 'RDB$')) s
  FULL OUTER JOIN (SELECT * FROM fx_t_domain WHERE NOT starts_with(upper(name), 'RDB$')) t
  ON s.db_id = t.db_id AND upper(s.name) = upper(t.name))
"""


def _named_items(rel: str, kind: str, differs: str, in_table: bool = False) -> str:
    s_tab, t_tab = ("table_name", "t_table") if in_table else ("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)")
    return f"""
SELECT db_id, 'created' AS bucket, '{kind}' AS object_type, {s_tab} AS table_name, name, CAST(NULL AS VARCHAR) AS attr
FROM {rel} WHERE t_name IS NULL
UNION ALL SELECT db_id, 'target_only', '{kind}', {t_tab}, t_name, NULL FROM {rel} WHERE name IS NULL
UNION ALL SELECT db_id, 'warning', '{kind}', {s_tab}, name, NULL FROM {rel}
WHERE name IS NOT NULL AND t_name IS NOT NULL AND {differs}"""


def _check_norm(x: str) -> str:
    return f"""upper(trim(regexp_replace(coalesce({x}, ''), '[\\r\\n\\t]+', ' ', 'g')))"""


def _text_norm(x: str) -> str:
    unix = f"regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g')"
    return f"upper({trim_ws(unix)})"


ITEMS_SQL = {
    "tables": """
SELECT db_id, 'created' AS bucket, 'TABLE' AS object_type, table_name, table_name AS name, CAST(NULL AS VARCHAR) AS attr FROM missing_tab
UNION ALL
SELECT db_id, 'target_only', 'TABLE', table_name, table_name, NULL FROM t_tab t
WHERE NOT EXISTS (SELECT 1 FROM s_tab s WHERE s.db_id = t.db_id AND s.tkey = t.tkey)""",
    "columns": """
SELECT db_id, 'created' AS bucket, 'COLUMN' AS object_type, table_name, column_name AS name, CAST(NULL AS VARCHAR) AS attr
FROM s_cc s WHERE NOT EXISTS (SELECT 1 FROM t_cc t WHERE t.db_id = s.db_id AND t.tkey = s.tkey AND t.ckey = s.ckey)
UNION ALL
SELECT t.db_id, 'target_only', 'COLUMN', c.table_name, t.column_name, NULL
FROM t_cc t JOIN common c USING (db_id, tkey)
WHERE NOT EXISTS (SELECT 1 FROM s_cc s WHERE t.db_id = s.db_id AND t.tkey = s.tkey AND t.ckey = s.ckey)
UNION ALL
SELECT db_id, 'warning', 'COLUMN', table_name, column_name, 'COMPUTED' FROM both_col WHERE NOT same_computed
UNION ALL
SELECT db_id, 'changed', 'COLUMN', table_name, column_name, 'TYPE' FROM both_col
WHERE same_computed AND NOT (upper(sql_type) IS NOT DISTINCT FROM upper(t_sql_type))
UNION ALL
SELECT db_id, 'changed', 'COLUMN', table_name, column_name, 'NULLABILITY' FROM both_col
WHERE same_computed AND nullable IS DISTINCT FROM t_nullable
UNION ALL
SELECT db_id, 'changed', 'COLUMN', table_name, column_name, 'DEFAULT' FROM both_col
WHERE same_computed AND NOT (upper(default_sql) IS NOT DISTINCT FROM upper(t_default_sql))""",
    "pk": """
SELECT db_id, 'changed' AS bucket, 'PK' AS object_type, table_name, coalesce(pk_name, t_pk_name) AS name,
       CAST(NULL AS VARCHAR) AS attr FROM pk_diff""",
    "fks": """
SELECT db_id, 'created' AS bucket, 'FK' AS object_type, table_name, fk_name AS name, CAST(NULL AS VARCHAR) AS attr FROM fk_missing
UNION ALL SELECT db_id, 'target_only', 'FK', table_name, fk_name, NULL FROM fk_tonly
UNION ALL SELECT db_id, 'warning', 'FK', table_name, fk_name,
  CASE side WHEN 'S' THEN 'DUPLICATE_SOURCE: ' ELSE 'DUPLICATE_TARGET: ' END || first_name || ' <-> ' || fk_name || ' | ' || sig
FROM fk_rank WHERE rn > 1""",
    "indexes": """
SELECT db_id, 'created' AS bucket, 'INDEX' AS object_type, table_name, index_name AS name, CAST(NULL AS VARCHAR) AS attr FROM ix_missing
UNION ALL SELECT db_id, 'target_only', 'INDEX', table_name, index_name, NULL FROM ix_tonly
UNION ALL SELECT db_id, 'warning', 'INDEX', table_name, index_name,
  CASE side WHEN 'S' THEN 'DUPLICATE_SOURCE: ' ELSE 'DUPLICATE_TARGET: ' END || first_name || ' <-> ' || index_name || ' | ' || sig
FROM ix_rank WHERE rn > 1""",
    "routines": """
SELECT db_id, 'created' AS bucket, 'ROUTINE' AS object_type, CAST(NULL AS VARCHAR) AS table_name, name, kind AS attr
FROM r_all WHERE t_name IS NULL
UNION ALL SELECT db_id, 'target_only', 'ROUTINE', NULL, t_name, kind FROM r_all WHERE name IS NULL
UNION ALL SELECT db_id, 'warning', 'ROUTINE', NULL, name, kind FROM r_diff""",
    "uniques": _named_items("uq_all", "UNIQUE", "upper(array_to_string(cols, '|')) <> upper(array_to_string(t_cols, '|'))", True),
    "checks": _named_items("ck_all", "CHECK", f"{_check_norm('check_sql')} <> {_check_norm('t_check')}", True),
    "sequences": _named_items("sq_all", "SEQUENCE", "false"),
    "views": _named_items("vw_all", "VIEW", f"{_text_norm('select_sql')} <> {_text_norm('t_select')}"),
    "domains": _named_items("dm_all", "DOMAIN", "differs"),
}

FK_CMD = f"""'ALTER TABLE ' || {q('table_name')}
  || CASE WHEN regexp_full_match(trim(fk_name), '(?i)INTEG_\\d+') THEN ' ADD ' ELSE ' ADD CONSTRAINT ' || {q('fk_name')} || ' ' END
  || 'FOREIGN KEY (' || {ql('cols')} || ') REFERENCES ' || {q('ref_table')} || ' (' || {ql('ref_cols')} || ')'
  || CASE WHEN upper(coalesce(update_rule, 'RESTRICT')) = 'RESTRICT' THEN '' ELSE ' ON UPDATE ' || update_rule END
  || CASE WHEN upper(coalesce(delete_rule, 'RESTRICT')) = 'RESTRICT' THEN '' ELSE ' ON DELETE ' || delete_rule END || ';'"""
IX_CMD = f"""CASE WHEN is_unique AND is_desc THEN 'CREATE UNIQUE DESCENDING INDEX ' WHEN is_unique THEN 'CREATE UNIQUE INDEX '
  WHEN is_desc THEN 'CREATE DESCENDING INDEX ' ELSE 'CREATE INDEX ' END || {q('index_name')} || ' ON ' || {q('table_name')}
  || ' (' || {ql('cols')} || ');'"""
PK_CMD = f"""'ALTER TABLE ' || {q('table_name')} || CASE WHEN regexp_full_match(trim(pk_name), '(?i)INTEG_\\d+')
  THEN ' ADD PRIMARY KEY (' ELSE ' ADD CONSTRAINT ' || {q('pk_name')} || ' PRIMARY KEY (' END || {ql('cols')} || ');'"""
ALTER = f"""'ALTER TABLE ' || {q('table_name')} || ' ALTER COLUMN ' || {q('column_name')}"""
STRIP_AS = f"""CASE WHEN starts_with(upper(rtrim({trim_ws('source')}, ';')), 'AS')
  THEN regexp_replace(substr(rtrim({trim_ws('source')}, ';'), 3), '^\\s+', '')
  ELSE rtrim({trim_ws('source')}, ';') END"""

UQ_CMD = f"""'ALTER TABLE ' || {q('table_name')} || ' ADD ' || CASE WHEN regexp_full_match(trim(name), '(?i)INTEG_\\d+') THEN ''
  ELSE 'CONSTRAINT ' || {q('name')} || ' ' END || 'UNIQUE (' || {ql('cols')} || ');'"""
CK_CMD = f"""'ALTER TABLE ' || {q('table_name')} || ' ADD ' || CASE WHEN regexp_full_match(trim(name), '(?i)INTEG_\\d+') THEN ''
  ELSE 'CONSTRAINT ' || {q('name')} || ' ' END || CASE WHEN starts_with(upper({trim_ws('check_sql')}), 'CHECK')
  THEN {trim_ws('check_sql')} ELSE 'CHECK (' || {trim_ws('check_sql')} || ')' END || ';'"""
DM_CMD = f"""'CREATE DOMAIN ' || {q('name')} || ' AS ' || sql_type || coalesce(' CHARACTER SET ' || charset, '')
  || coalesce(' ' || default_sql, '') || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END || coalesce(' ' || check_sql, '') || ';'"""

COMMANDS_SQL = f"""
SELECT m.db_id, 20 AS class, m.table_name, '' AS seq,
       'CREATE TABLE ' || {q('m.table_name')} || ' (' || chr(10)
       || coalesce((SELECT string_agg('    ' || ({COLDEF}), ',' || chr(10) ORDER BY ordinal, ({COLDEF}))
                    FROM s_col c WHERE c.db_id = m.db_id AND c.table_name = m.table_name), '')
       || chr(10) || ');' AS sql
FROM missing_tab m
UNION ALL
SELECT db_id, 40, table_name, pk_name, {PK_CMD} FROM s_pk p
WHERE EXISTS (SELECT 1 FROM missing_tab m WHERE m.db_id = p.db_id AND m.table_name = p.table_name)
UNION ALL
SELECT db_id, 60, table_name, fk_name, {FK_CMD} FROM fk_any f
WHERE side = 'S' AND EXISTS (SELECT 1 FROM missing_tab m WHERE m.db_id = f.db_id AND m.table_name = f.table_name)
UNION ALL
SELECT db_id, 50, table_name, index_name, {IX_CMD} FROM ix_any i
WHERE side = 'S' AND EXISTS (SELECT 1 FROM missing_tab m WHERE m.db_id = i.db_id AND m.table_name = i.table_name)
UNION ALL
SELECT db_id, 30, table_name, column_name, 'ALTER TABLE ' || {q('table_name')} || ' ADD ' || ({COLDEF}) || ';'
FROM s_cc s WHERE NOT EXISTS (SELECT 1 FROM t_cc t WHERE t.db_id = s.db_id AND t.tkey = s.tkey AND t.ckey = s.ckey)
UNION ALL
SELECT db_id, 35, table_name, column_name || '#1', {ALTER} || ' TYPE ' || sql_type || ';' FROM both_col
WHERE same_computed AND NOT (upper(sql_type) IS NOT DISTINCT FROM upper(t_sql_type))
UNION ALL
SELECT db_id, 35, table_name, column_name || '#2',
       {ALTER} || CASE WHEN coalesce(nullable, true) THEN ' DROP NOT NULL;' ELSE ' SET NOT NULL;' END FROM both_col
WHERE same_computed AND nullable IS DISTINCT FROM t_nullable
UNION ALL
SELECT db_id, 35, table_name, column_name || '#3',
       {ALTER} || CASE WHEN {blank('default_sql')} THEN ' DROP DEFAULT;' ELSE ' SET ' || default_sql || ';' END FROM both_col
WHERE same_computed AND NOT (upper(default_sql) IS NOT DISTINCT FROM upper(t_default_sql))
UNION ALL
SELECT db_id, 10, table_name, t_pk_name, 'ALTER TABLE ' || {q('table_name')} || ' DROP CONSTRAINT ' || {q('t_pk_name')} || ';'
FROM pk_diff WHERE t_pk_name IS NOT NULL
UNION ALL
SELECT db_id, 40, table_name, pk_name, {PK_CMD} FROM pk_diff WHERE pk_name IS NOT NULL
UNION ALL
SELECT db_id, 60, table_name, fk_name, {FK_CMD} FROM fk_missing
UNION ALL
SELECT db_id, 50, table_name, index_name, {IX_CMD} FROM ix_missing
UNION ALL
SELECT db_id, CASE WHEN starts_with(upper(sql), 'CREATE OR ALTER PROCEDURE') THEN 17 ELSE 70 END, '', kind || ':' || name, sql
FROM (
  SELECT db_id, kind, name,
    CASE WHEN kind = 'PROCEDURE' THEN
           CASE WHEN {blank('source')}
                THEN '-- [WARNING] PROCEDURE ' || {q('name')} || ' exists in metadata but has no PSQL source; DDL was not generated for this object.'
                ELSE 'CREATE OR ALTER PROCEDURE ' || {q('name')} || chr(10) || 'AS' || chr(10) || {STRIP_AS} || chr(10) || ' ^' END
         ELSE CASE WHEN {blank('source')}
                THEN '-- [WARNING] PSQL object unknown exists in metadata but has no PSQL source; DDL was not generated for this object.'
                ELSE rtrim({trim_ws('source')}, ';') || ' ^' END END AS sql
  FROM (SELECT * FROM r_all WHERE t_name IS NULL UNION ALL SELECT * FROM r_diff) r
) rc
UNION ALL
SELECT db_id, 42, table_name, name, {UQ_CMD} FROM s_uq u
WHERE EXISTS (SELECT 1 FROM missing_tab m WHERE m.db_id = u.db_id AND m.table_name = u.table_name)
UNION ALL
SELECT db_id, 42, table_name, name, {UQ_CMD} FROM uq_all WHERE t_name IS NULL
UNION ALL
SELECT db_id, 43, table_name, name, {CK_CMD} FROM fx_check k
WHERE EXISTS (SELECT 1 FROM missing_tab m WHERE m.db_id = k.db_id AND m.table_name = k.table_name)
UNION ALL
SELECT db_id, 43, table_name, name, {CK_CMD} FROM ck_all WHERE t_name IS NULL
UNION ALL
SELECT db_id, 16, '', name, 'CREATE SEQUENCE ' || {q('name')} || ';' FROM sq_all WHERE t_name IS NULL
UNION ALL
SELECT db_id, 25, '', name, 'CREATE VIEW ' || {q('name')} || ' AS ' || {trim_ws('select_sql')} || ';' FROM vw_all WHERE t_name IS NULL
UNION ALL
SELECT db_id, 15, '', name, {DM_CMD} FROM dm_all WHERE t_name IS NULL"""

DEPTH_CTE = """
edges AS (
  SELECT DISTINCT f.db_id, upper(f.table_name) AS src, upper(f.ref_table) AS dst FROM fx_fk f
  WHERE trim(coalesce(f.ref_table, '')) <> ''
    AND EXISTS (SELECT 1 FROM fx_table t WHERE t.db_id = f.db_id AND upper(t.table_name) = upper(f.ref_table))),
proper AS (SELECT * FROM edges WHERE src <> dst),
walk AS (
  SELECT db_id, src AS start, dst AS node, 1 AS len, [src, dst] AS path, false AS looped FROM proper
  UNION ALL
  SELECT w.db_id, w.start, e.dst, w.len + 1, list_append(w.path, e.dst), list_contains(w.path, e.dst)
  FROM walk w JOIN proper e ON e.db_id = w.db_id AND e.src = w.node
  WHERE NOT w.looped),
reach AS (SELECT db_id, start, bool_or(looped) AS cyc, max(len) AS longest FROM walk GROUP BY db_id, start),
acyclic AS (SELECT db_id, start AS node, longest AS d FROM reach WHERE NOT cyc),
stuck AS (
  SELECT r.db_id, r.start AS node,
         1 + coalesce((SELECT max(coalesce(a.d, 0)) FROM proper e LEFT JOIN reach r2 ON r2.db_id = e.db_id AND r2.start = e.dst
                       LEFT JOIN acyclic a ON a.db_id = e.db_id AND a.node = e.dst
                       WHERE e.db_id = r.db_id AND e.src = r.start AND NOT coalesce(r2.cyc, false)), 0) AS d
  FROM reach r WHERE r.cyc),
depth AS (
  SELECT t.db_id, t.table_name,
    CAST(greatest(coalesce(a.d, s.d, 0),
                  CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.db_id = t.db_id AND e.src = upper(t.table_name)
                                    AND e.dst = e.src) THEN 1 ELSE 0 END) AS INT) AS depth,
    s.d IS NOT NULL AS cyclic
  FROM fx_table t LEFT JOIN acyclic a ON a.db_id = t.db_id AND a.node = upper(t.table_name)
  LEFT JOIN stuck s ON s.db_id = t.db_id AND s.node = upper(t.table_name))
"""


def _items_sql(*parts):
    return f"WITH {DIFF_CTE}\n" + "\nUNION ALL\n".join(f"SELECT * FROM ({ITEMS_SQL[p]}) i_{p}" for p in parts)


register("diff_tables", _items_sql("tables"))(
    lambda spark, sf: D.diff_tables(*_sides(spark, sf))[0])
register("diff_columns", _items_sql("columns"))(
    lambda spark, sf: D.diff_columns(*_sides(spark, sf))[0])
register("diff_pk", _items_sql("pk"))(lambda spark, sf: D.diff_pk(*_sides(spark, sf))[0])
register("diff_fks", _items_sql("fks"))(lambda spark, sf: D.diff_fks(*_sides(spark, sf))[0])
register("diff_indexes", _items_sql("indexes"))(lambda spark, sf: D.diff_indexes(*_sides(spark, sf))[0])
register("diff_routines", _items_sql("routines"))(lambda spark, sf: D.diff_routines(*_sides(spark, sf))[0])

register("diff_unique", _items_sql("uniques"))(lambda spark, sf: D.diff_uniques(*_sides(spark, sf))[0])
register("diff_checks", _items_sql("checks"))(lambda spark, sf: D.diff_checks(*_sides(spark, sf))[0])
register("diff_sequences", _items_sql("sequences"))(lambda spark, sf: D.diff_sequences(*_sides(spark, sf))[0])
register("diff_views", _items_sql("views"))(lambda spark, sf: D.diff_views(*_sides(spark, sf))[0])
register("diff_domains", _items_sql("domains"))(lambda spark, sf: D.diff_domains(*_sides(spark, sf))[0])

ALL_ITEMS = ("tables", "columns", "pk", "fks", "indexes", "routines", "uniques", "checks", "sequences", "views", "domains")
register("diff_items", _items_sql(*ALL_ITEMS))(lambda spark, sf: _full(spark, sf).items)

register("target_only", f"""WITH {DIFF_CTE}
SELECT * FROM ({" UNION ALL ".join(f"SELECT * FROM ({ITEMS_SQL[p]}) i_{p}" for p in ALL_ITEMS)}) a
WHERE bucket = 'target_only'""")(lambda spark, sf: _full(spark, sf).items.where(F.col("bucket") == "target_only"))

register("diff_duplicates", f"""WITH {DIFF_CTE}
SELECT * FROM ({ITEMS_SQL['fks']}) f WHERE bucket = 'warning'
UNION ALL SELECT * FROM ({ITEMS_SQL['indexes']}) i WHERE bucket = 'warning'""")(
    lambda spark, sf: _full(spark, sf).items.where(
        (F.col("bucket") == "warning") & F.col("object_type").isin("FK", "INDEX")))

register("fk_depth", f"WITH RECURSIVE {DEPTH_CTE} SELECT db_id, table_name, depth, cyclic FROM depth")(
    lambda spark, sf: G.fk_depth(fixture_catalog(spark, sf, "source")))

register("diff_commands", f"""WITH RECURSIVE {DIFF_CTE}, {DEPTH_CTE.strip()},
cmds AS ({COMMANDS_SQL})
SELECT c.db_id, c.class, CAST(coalesce(d.depth, 0) AS INT) AS depth, c.table_name, c.seq, c.sql
FROM cmds c LEFT JOIN depth d ON d.db_id = c.db_id AND upper(d.table_name) = upper(c.table_name)""")(
    lambda spark, sf: _full(spark, sf).commands)

register("diff_summary", f"""WITH RECURSIVE {DIFF_CTE},
items AS ({" UNION ALL ".join(f"SELECT * FROM ({ITEMS_SQL[p]}) i_{p}" for p in ALL_ITEMS)}),
cmds AS ({COMMANDS_SQL}),
b AS (SELECT db_id, count(*) FILTER (WHERE bucket = 'created') AS created,
             count(*) FILTER (WHERE bucket = 'changed') AS changed,
             count(*) FILTER (WHERE bucket = 'target_only') AS target_only,
             count(*) FILTER (WHERE bucket = 'warning') AS warning FROM items GROUP BY db_id),
c AS (SELECT db_id, count(*) AS commands FROM cmds GROUP BY db_id)
SELECT coalesce(b.db_id, c.db_id) AS db_id, coalesce(created, 0) AS created, coalesce(changed, 0) AS changed,
       coalesce(target_only, 0) AS target_only, coalesce(warning, 0) AS warning, coalesce(commands, 0) AS commands
FROM b FULL OUTER JOIN c ON b.db_id = c.db_id""")(lambda spark, sf: D.diff_summary(_full(spark, sf)))


# ---------------------------------------------------------------- routine graph (fx_proc)

CALL_SQL = r"""
calls AS (
  SELECT db_id, upper(name) AS caller, unnest(list_concat(
           regexp_extract_all(coalesce(source, ''), '(?i)EXECUTE\s+PROCEDURE\s+("[^"]+"|[A-Z0-9_$]+)', 1),
           regexp_extract_all(coalesce(source, ''), '(?i)\b(?:FROM|JOIN)\s+("[^"]+"\s*\(|"[^"]+"\w|[A-Z0-9_$]+\b)', 1))) AS raw
  FROM fx_proc WHERE kind = 'PROCEDURE'),
redges AS (
  SELECT DISTINCT c.db_id, c.caller,
         upper(trim(CASE WHEN starts_with(raw, '"') THEN regexp_extract(raw, '^"([^"]+)"', 1) ELSE raw END)) AS callee
  FROM calls c),
kedges AS (
  SELECT * FROM redges r WHERE callee <> '' AND callee <> caller
    AND EXISTS (SELECT 1 FROM fx_proc p WHERE p.kind = 'PROCEDURE' AND p.db_id = r.db_id AND upper(p.name) = r.callee))
"""

def _procs(spark, sf):
    return fixture(spark, sf, "fx_proc")


register("routine_edges", f"WITH {CALL_SQL} SELECT db_id, caller, callee FROM kedges")(
    lambda spark, sf: G.routine_edges(_procs(spark, sf)))

# level = longest call chain below the procedure; a procedure that can reach
# a cycle is never peeled (cyclic). Oracle: recursive walk with a path guard.
LEVEL_SQL = f"""WITH RECURSIVE {CALL_SQL},
procs AS (SELECT db_id, name, upper(name) AS node FROM fx_proc WHERE kind = 'PROCEDURE'),
walk AS (
  SELECT db_id, caller AS start, callee AS node, 1 AS len, [caller, callee] AS path, false AS looped FROM kedges
  UNION ALL
  SELECT w.db_id, w.start, e.callee, w.len + 1, list_append(w.path, e.callee), list_contains(w.path, e.callee)
  FROM walk w JOIN kedges e ON e.db_id = w.db_id AND e.caller = w.node
  WHERE NOT w.looped),
agg AS (SELECT db_id, start, max(len) AS len, bool_or(looped) AS cyclic FROM walk GROUP BY db_id, start)
SELECT p.db_id, p.name,
       CASE WHEN coalesce(a.cyclic, false) THEN NULL ELSE CAST(coalesce(a.len, 0) AS INT) END AS level,
       coalesce(a.cyclic, false) AS cyclic
FROM procs p LEFT JOIN agg a ON a.db_id = p.db_id AND a.start = p.node"""


register("routine_order", LEVEL_SQL)(lambda spark, sf: G.routine_order(_procs(spark, sf)))
register("routine_cycles", f"SELECT db_id, name FROM ({LEVEL_SQL}) l WHERE cyclic")(
    lambda spark, sf: G.routine_levels(_procs(spark, sf)).where("cyclic").select("db_id", "name"))

register("convergence", f"""WITH {DIFF_CTE}
SELECT * FROM ({ITEMS_SQL['tables']}) t WHERE false""")(
    lambda spark, sf: D.convergence(*_sides(spark, sf), keep=lambda df: keep_buckets(df, "table_name")))

register("min_call_arity", r"""
WITH sites AS (
  SELECT db_id, upper(name) AS caller, unnest(regexp_extract_all(source,
           '(?i)\b(?:FROM|JOIN|EXECUTE\s+PROCEDURE)\s+("[^"]+"|[A-Z0-9_$]+)\s*\(([^)]*)\)', 0)) AS m
  FROM fx_proc WHERE kind = 'PROCEDURE'),
parsed AS (
  SELECT db_id, caller,
         upper(replace(regexp_extract(m, '(?i)\b(?:FROM|JOIN|EXECUTE\s+PROCEDURE)\s+("[^"]+"|[A-Z0-9_$]+)', 1), '"', '')) AS callee,
         regexp_extract(m, '\(([^)]*)\)$', 1) AS args FROM sites)
SELECT db_id, callee, CAST(min(CASE WHEN trim(args) = '' THEN 0 ELSE length(args) - length(replace(args, ',', '')) + 1 END) AS INT) AS min_args,
       count(*) AS call_sites
FROM parsed p WHERE callee <> caller
  AND EXISTS (SELECT 1 FROM fx_proc k WHERE k.kind = 'PROCEDURE' AND k.db_id = p.db_id AND upper(k.name) = p.callee)
GROUP BY db_id, callee""")(lambda spark, sf: G.min_call_arity(_procs(spark, sf)))
