"""Deterministic fleet fixtures over the driver's test tables.

100 orders form one database, an order is a catalog table, its line items
are columns and index segments (FIXTURES.md section 3). The same view text
is registered in Spark and inlined as CTEs into the DuckDB oracle, so both
engines start from identical rows and the check exercises the operators.
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .tables import register_base_tables

# Fixed view definitions (FIXTURES.md section 3, plus fx_database: a server
# major version per database so the version-gated field rules have input).
FX_VIEWS = (
    ("fx_table", "SELECT CAST(floor(o_orderkey / 100) AS BIGINT) AS db_id, concat('T', CAST(o_orderkey AS VARCHAR(20))) AS table_name, o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderpriority AS pr FROM orders"),
    ("fx_column", "SELECT t.db_id, t.table_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ordinal, concat('C', CAST(l_partkey % 12 AS VARCHAR(20))) AS column_name, CASE l_partkey % 9 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'VARCHAR(100)' WHEN 2 THEN 'VARCHAR(20000)' WHEN 3 THEN 'NUMERIC(15,2)' WHEN 4 THEN 'NUMERIC(20,2)' WHEN 5 THEN 'BOOLEAN' WHEN 6 THEN 'TYPE_999' WHEN 7 THEN 'NUMERIC(40,2)' ELSE 'TIMESTAMP' END AS sql_type, CAST(1 + l_suppkey % 4 AS INT) AS bytes_per_char, l_quantity < 25 AS nullable, CASE WHEN l_linenumber = 1 THEN 'DEFAULT 0' END AS default_sql, CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN '(X * 2)' END AS computed_sql, l_partkey AS p, l_suppkey AS s FROM lineitem JOIN fx_table t ON t.k = l_orderkey"),
    ("fx_pk", "SELECT db_id, table_name, concat('PK_', table_name) AS pk_name, k, c, pr FROM fx_table WHERE st <> 'P'"),
    ("fx_pk_col", "SELECT db_id, table_name, pk_name, 1 AS ordinal, concat('C', CAST(c % 12 AS VARCHAR(20))) AS column_name FROM fx_pk WHERE pr <> '5-LOW'"),
    ("fx_fk", "SELECT db_id, table_name, concat('FK_', CAST(k AS VARCHAR(20))) AS fk_name, concat('T', CAST(db_id * 100 + (k * 11) % 105 AS VARCHAR(20))) AS ref_table, CASE WHEN k % 2 = 0 THEN '' ELSE concat('FK_', CAST(k AS VARCHAR(20))) END AS support_index, 'RESTRICT' AS update_rule, CASE WHEN k % 5 = 0 THEN 'CASCADE' ELSE 'RESTRICT' END AS delete_rule, k, c FROM fx_table WHERE k % 3 = 0 UNION ALL SELECT db_id, table_name, concat('FK2_', CAST(k AS VARCHAR(20))), concat('T', CAST(db_id * 100 + (k * 11) % 105 AS VARCHAR(20))), '', 'RESTRICT', CASE WHEN k % 5 = 0 THEN 'CASCADE' ELSE 'RESTRICT' END, k, c FROM fx_table WHERE k % 30 = 0"),
    ("fx_fk_col", "SELECT db_id, table_name, fk_name, 1 AS ordinal, concat('C', CAST(c % 12 AS VARCHAR(20))) AS column_name, concat('C', CAST(c % 12 AS VARCHAR(20))) AS ref_column FROM fx_fk WHERE k % 17 <> 0 UNION ALL SELECT db_id, table_name, fk_name, 2, CAST(NULL AS VARCHAR(20)), 'C0' FROM fx_fk WHERE k % 17 <> 0 AND k % 11 = 0"),
    ("fx_index", "SELECT DISTINCT t.db_id, t.table_name, concat('IX_', CAST(l_orderkey AS VARCHAR(20)), '_', CAST(l_linenumber AS VARCHAR(20))) AS index_name, l_linenumber = 7 AS is_unique, l_linenumber % 2 = 0 AS is_desc, l_orderkey AS k, l_linenumber AS ln FROM lineitem JOIN fx_table t ON t.k = l_orderkey"),
    ("fx_index_col", "SELECT t.db_id, t.table_name, concat('IX_', CAST(l_orderkey AS VARCHAR(20)), '_', CAST(l_linenumber AS VARCHAR(20))) AS index_name, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey % 12, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ordinal, CASE WHEN l_suppkey % 13 = 0 THEN concat('Z', CAST(l_partkey % 12 AS VARCHAR(20))) WHEN l_suppkey % 17 = 0 THEN concat('UPPER(C', CAST(l_partkey % 12 AS VARCHAR(20)), ')') ELSE concat('C', CAST(l_partkey % 12 AS VARCHAR(20))) END AS column_name FROM lineitem JOIN fx_table t ON t.k = l_orderkey WHERE l_suppkey % 19 <> 0"),
    ("fx_routine", "SELECT doc_id % 7 AS db_id, CASE doc_id % 3 WHEN 0 THEN 'PROCEDURE' WHEN 1 THEN 'FUNCTION' ELSE 'TRIGGER' END AS kind, concat('R', CAST(doc_id AS VARCHAR(20))) AS name, doc_id % 10 = 9 AS ignore_body, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'AS BEGIN /* SUSPEND */ -- noop' WHEN 2 THEN 'AS BEGIN SUSPEND; END' WHEN 3 THEN 'AS BEGIN /* c */ ; END' ELSE concat('AS BEGIN EXECUTE PROCEDURE R', CAST(doc_id - 4 AS VARCHAR(20)), '(1, 2); END') END AS source FROM documents"),
    ("fx_monitor", "SELECT user_id % 10 AS db_id, event_id AS sample_id, ts, event_id AS oit, event_id + CAST(floor(value * 3000) AS BIGINT) AS oat, event_id + CAST(floor(value * 3000) AS BIGINT) + CAST(floor(value * 1500) AS BIGINT) AS ost, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS tx_state, user_id AS attachment_id FROM events"),
    ("fx_log", "SELECT event_id, ts, user_id % 10 AS db_id, CASE event_id % 9 WHEN 0 THEN 'deadlock: update conflicts with concurrent update' WHEN 1 THEN 'unsupported on-disk structure for file a.fdb; found 13.0, support 12.0' WHEN 2 THEN 'no permission for read-write access to database' WHEN 3 THEN 'I/O error for file b.fdb' WHEN 4 THEN 'Dynamic SQL Error Token unknown' WHEN 5 THEN 'Unable to complete network request' WHEN 6 THEN 'operation timeout' WHEN 7 THEN 'MON$STATE column unknown' ELSE 'violation of PRIMARY KEY' END AS message FROM events"),
    ("fx_stmt", "SELECT CAST(floor(c_custkey / 100) AS BIGINT) AS file_no, c_custkey AS stmt_no, CASE WHEN c_custkey % 50 = 0 THEN concat('INSERT INTO CUSTOMER (C_CUSTKEY, C_NAME, C_SEG) VALUES (', CAST(c_custkey AS VARCHAR(20)), ', ''', c_name, ''');') WHEN c_custkey % 7 = 0 THEN concat('UPDATE OR INSERT INTO CUSTOMER (C_CUSTKEY, C_NAME) VALUES (', CAST(c_custkey AS VARCHAR(20)), ', ''a, (b'') MATCHING (C_CUSTKEY);') ELSE concat('INSERT INTO CUSTOMER (C_CUSTKEY, C_NAME) VALUES (', CAST(c_custkey AS VARCHAR(20)), ', ''', c_name, ', it''''s'');') END AS sql_text FROM customer"),
    ("fx_replay", "SELECT file_no, stmt_no * 10 AS seq, sql_text, CASE WHEN stmt_no % 50 = 0 THEN 'quarantined' WHEN stmt_no % 7 = 0 THEN 'merged' ELSE 'loaded' END AS fate FROM fx_stmt"
     " UNION ALL SELECT file_no, stmt_no * 10 + 1, concat('UPDATE OR INSERT INTO customer (C_CUSTKEY, \"C_NAME\") VALUES (', CAST(stmt_no AS VARCHAR(20)), ', ''renamed', chr(10), CAST(stmt_no AS VARCHAR(20)), ''') MATCHING (C_CUSTKEY);'), 'merged' FROM fx_stmt WHERE stmt_no % 3 = 0"
     " UNION ALL SELECT file_no, stmt_no * 10 + 2, concat('INSERT INTO CUSTOMER (C_NAME, C_CUSTKEY) VALUES (''again'', ', CAST(stmt_no AS VARCHAR(20)), ');'), CASE WHEN stmt_no % 3 = 0 OR stmt_no % 50 <> 0 THEN 'quarantined' ELSE 'loaded' END FROM fx_stmt WHERE stmt_no % 11 = 0"
     " UNION ALL SELECT file_no, stmt_no * 10 + 3, CASE stmt_no % 6 WHEN 0 THEN 'INSERT INTO CUSTOMER (C_CUSTKEY, C_NAME VALUES (1, ''x'');' WHEN 1 THEN 'UPDATE CUSTOMER SET C_NAME = ''y'' WHERE C_CUSTKEY = 1;' WHEN 2 THEN 'DELETE FROM CUSTOMER;' WHEN 3 THEN 'INSERT INTO CUSTOMER (C_CUSTKEY, C_NAME) SELECT 1, ''x'' FROM RDB$DATABASE;' WHEN 4 THEN 'INSERT INTO CUSTOMER (C_CUSTKEY, C_CUSTKEY) VALUES (1, 2);' ELSE 'INSERT INTO \"MY TABLE\" (ID) VALUES (1);' END, CASE WHEN stmt_no % 6 IN (0, 4) THEN 'quarantined' ELSE 'not_applicable' END FROM fx_stmt WHERE stmt_no % 13 = 0"
     " UNION ALL SELECT file_no, stmt_no * 10 + 4, concat('INSERT INTO CUSTOMER VALUES (-', CAST(stmt_no + 1 AS VARCHAR(20)), ', ''line', chr(10), 'two; ('');'), 'loaded' FROM fx_stmt WHERE stmt_no % 17 = 0"),
    ("fx_u_column", 'SELECT db_id, table_name, ordinal, column_name, sql_type, nullable, default_sql, computed_sql, p, s FROM (SELECT *, row_number() OVER (PARTITION BY db_id, table_name, column_name ORDER BY ordinal) AS rn FROM fx_column) x WHERE rn = 1'),
    ("fx_t_table", "SELECT db_id, table_name, k FROM fx_table WHERE k % 29 <> 0 UNION ALL SELECT db_id, concat('N', CAST(k AS VARCHAR(20))), k FROM fx_table WHERE k % 31 = 0"),
    ("fx_t_column", "SELECT u.db_id, u.table_name, u.ordinal, u.column_name, CASE WHEN p % 37 = 0 THEN 'BIGINT' ELSE sql_type END AS sql_type, CASE WHEN s % 19 = 0 THEN NOT nullable ELSE nullable END AS nullable, CASE WHEN p % 43 = 0 THEN 'DEFAULT 1' ELSE default_sql END AS default_sql, CASE WHEN p % 47 = 0 THEN '(Y + 1)' ELSE computed_sql END AS computed_sql FROM fx_u_column u JOIN fx_t_table t ON t.db_id = u.db_id AND t.table_name = u.table_name WHERE p % 41 <> 0 UNION ALL SELECT db_id, table_name, 99, 'X1', 'INTEGER', TRUE, CAST(NULL AS VARCHAR(20)), CAST(NULL AS VARCHAR(20)) FROM fx_t_table WHERE k % 23 = 0"),
    ("fx_t_fk", "SELECT db_id, table_name, fk_name, ref_table, support_index, update_rule, CASE WHEN k % 13 = 0 THEN 'SET NULL' ELSE delete_rule END AS delete_rule, k, c FROM fx_fk WHERE k % 7 <> 0 AND k % 29 <> 0"),
    ("fx_t_index", 'SELECT db_id, table_name, index_name, is_unique, CASE WHEN k % 13 = 0 THEN NOT is_desc ELSE is_desc END AS is_desc, k, ln FROM fx_index WHERE ln <> 6 AND k % 29 <> 0'),
    ("fx_t_routine", "SELECT db_id, kind, name, CASE WHEN name LIKE '%7' THEN concat(source, ' ') WHEN name LIKE '%3' THEN concat(source, '/*v2*/') ELSE source END AS source FROM fx_routine WHERE name NOT LIKE '%11'"),
    ("fx_unique", "SELECT i.db_id, i.table_name, CASE WHEN i.k % 10 = 0 THEN concat('INTEG_', CAST(i.k AS VARCHAR(20))) ELSE concat('UQ_', i.index_name) END AS name, c.ordinal, c.column_name, i.k FROM fx_index i JOIN fx_index_col c ON c.db_id = i.db_id AND c.table_name = i.table_name AND c.index_name = i.index_name WHERE i.is_unique"),
    ("fx_t_unique", "SELECT db_id, table_name, lower(name) AS name, ordinal, CASE WHEN k % 11 = 0 THEN 'C0X' ELSE lower(column_name) END AS column_name FROM fx_unique WHERE k % 7 <> 0 AND k % 29 <> 0 UNION ALL SELECT db_id, table_name, concat('UT_', name), ordinal, column_name FROM fx_unique WHERE k % 13 = 0 AND k % 29 <> 0"),
    ("fx_check", "SELECT db_id, table_name, CASE WHEN k % 10 = 1 THEN concat('INTEG_', CAST(k AS VARCHAR(20))) ELSE concat('CK_', table_name) END AS name, CASE WHEN k % 8 = 1 THEN concat('check (C', CAST(c % 12 AS VARCHAR(20)), ' > 0', chr(10), 'AND 1 = 1)') ELSE concat('C', CAST(c % 12 AS VARCHAR(20)), ' IS NOT NULL ') END AS check_sql, k FROM fx_table WHERE k % 4 = 1"),
    ("fx_t_check", "SELECT db_id, table_name, name, CASE WHEN k % 5 = 0 THEN concat('(', check_sql, ')') WHEN k % 3 = 0 THEN replace(upper(check_sql), chr(10), concat(chr(13), chr(10))) ELSE check_sql END AS check_sql FROM fx_check WHERE k % 7 <> 0 AND k % 29 <> 0 UNION ALL SELECT db_id, table_name, concat('CT_', name), check_sql FROM fx_check WHERE k % 13 = 0 AND k % 29 <> 0"),
    ("fx_sequence", "SELECT CAST(floor(c_custkey / 100) AS BIGINT) AS db_id, concat('S', CAST(c_custkey AS VARCHAR(20))) AS name, c_custkey AS k FROM customer"),
    ("fx_t_sequence", "SELECT db_id, lower(name) AS name FROM fx_sequence WHERE k % 5 <> 0 UNION ALL SELECT db_id, concat('ST', CAST(k AS VARCHAR(20))) FROM fx_sequence WHERE k % 9 = 0"),
    ("fx_domain", "SELECT CAST(floor(c_custkey / 100) AS BIGINT) AS db_id, concat(CASE WHEN c_custkey % 17 = 0 THEN 'RDB$' ELSE 'D' END, CAST(c_custkey AS VARCHAR(20))) AS name, CASE c_custkey % 3 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'VARCHAR(60)' ELSE 'NUMERIC(15,2)' END AS sql_type, c_custkey % 4 <> 0 AS nullable, CASE WHEN c_custkey % 6 = 0 THEN 'DEFAULT 0' END AS default_sql, CASE WHEN c_custkey % 7 = 0 THEN 'CHECK (VALUE >= 0)' END AS check_sql, CASE WHEN c_custkey % 3 = 1 THEN 'WIN1252' END AS charset, c_custkey AS k FROM customer"),
    ("fx_f_domain", "SELECT db_id, name, CASE k % 11 WHEN 0 THEN 'BOOLEAN' WHEN 1 THEN 'INT128' WHEN 2 THEN 'VARCHAR(20000)' WHEN 3 THEN 'NUMERIC(20,2)' WHEN 4 THEN '' ELSE sql_type END AS sql_type, CAST(1 + k % 4 AS INT) AS bytes_per_char, nullable, default_sql, check_sql, charset FROM fx_domain"),
    ("fx_t_domain", "SELECT db_id, name, CASE WHEN k % 19 = 0 THEN 'BIGINT' ELSE lower(sql_type) END AS sql_type, CASE WHEN k % 23 = 0 THEN NOT nullable ELSE nullable END AS nullable, CASE WHEN k % 29 = 0 THEN 'DEFAULT 1' ELSE default_sql END AS default_sql, CASE WHEN k % 31 = 0 THEN CAST(NULL AS VARCHAR(20)) ELSE check_sql END AS check_sql, CASE WHEN k % 37 = 0 THEN 'UTF8' ELSE charset END AS charset FROM fx_domain WHERE k % 5 <> 0 UNION ALL SELECT db_id, concat('DT', CAST(k AS VARCHAR(20))), sql_type, nullable, default_sql, check_sql, charset FROM fx_domain WHERE k % 11 = 0"),
    ("fx_view", "SELECT doc_id % 100 AS db_id, concat('V', CAST(doc_id AS VARCHAR(20))) AS name, concat(' SELECT C1 FROM T1', chr(10), '/* ', replace(coalesce(text, ''), '*/', ''), ' */ ') AS select_sql, doc_id AS k FROM documents"),
    ("fx_t_view", "SELECT db_id, lower(name) AS name, CASE WHEN k % 7 = 0 THEN replace(select_sql, 'C1', 'C2') WHEN k % 3 = 0 THEN replace(select_sql, chr(10), concat(chr(13), chr(10))) ELSE select_sql END AS select_sql FROM fx_view WHERE k % 5 <> 0 UNION ALL SELECT db_id, concat('VT', CAST(k AS VARCHAR(20))), select_sql FROM fx_view WHERE k % 11 = 0"),
    ("fx_database", "SELECT DISTINCT db_id, CAST(2 + db_id % 4 AS INT) AS major FROM fx_table"),
    ("fx_t_pk", "SELECT db_id, table_name, pk_name, k FROM fx_pk WHERE k % 37 <> 0"),
    ("fx_t_pk_col", "SELECT db_id, table_name, pk_name, ordinal, CASE WHEN c % 5 = 0 THEN 'C0' ELSE column_name END AS column_name, c FROM fx_pk_col p JOIN (SELECT db_id AS d, table_name AS tn, c FROM fx_pk) x ON x.d = p.db_id AND x.tn = p.table_name"),
    ("fx_ddl", "SELECT doc_id % 5 AS db_id, doc_id AS stmt_no, CASE doc_id % 6 WHEN 0 THEN concat('CREATE OR ALTER PROCEDURE P', CAST(doc_id % 37 AS VARCHAR(20)), ' AS BEGIN SUSPEND; END') WHEN 1 THEN concat('CREATE SEQUENCE S', CAST(doc_id % 23 AS VARCHAR(20))) WHEN 2 THEN concat('CREATE DOMAIN \"D', CAST(doc_id % 19 AS VARCHAR(20)), '\" AS VARCHAR(', CAST(n_chars % 100 + 1 AS VARCHAR(20)), ')') WHEN 3 THEN concat('create view v', CAST(doc_id % 29 AS VARCHAR(20)), ' AS SELECT ', CAST(doc_id AS VARCHAR(20)), ' FROM RDB$DATABASE') WHEN 4 THEN concat('CREATE DESCENDING INDEX IX', CAST(doc_id % 31 AS VARCHAR(20)), ' ON T (C', CAST(doc_id % 7 AS VARCHAR(20)), ')') ELSE concat('ALTER TABLE T ADD CONSTRAINT FK', CAST(doc_id % 13 AS VARCHAR(20)), ' FOREIGN KEY (A) REFERENCES R (B)') END AS sql_text FROM documents"),
    ("fx_rdb_character_sets", "SELECT db_id, 53 AS character_set_id, 'WIN1252' AS character_set_name, 1 AS bytes_per_character FROM fx_database UNION ALL SELECT db_id, 10, 'EUCJ_0208', 2 FROM fx_database UNION ALL SELECT db_id, 3, 'UNICODE_FSS', 3 FROM fx_database UNION ALL SELECT db_id, 4, 'UTF8', 4 FROM fx_database"),
    ("fx_rdb_relations", "SELECT db_id, table_name AS relation_name, 0 AS system_flag, CAST(NULL AS VARCHAR(20)) AS view_blr FROM fx_table UNION ALL SELECT db_id, 'RDB$PAGES', 1, CAST(NULL AS VARCHAR(20)) FROM fx_database UNION ALL SELECT db_id, concat('V_', CAST(db_id AS VARCHAR(20))), 0, 'blr' FROM fx_database"),
    ("fx_rdb_relation_fields", "SELECT db_id, table_name AS relation_name, column_name AS field_name, concat('RDB$F', CAST(p AS VARCHAR(20)), '_', CAST(s AS VARCHAR(20)), '_', table_name, '_', CAST(ordinal AS VARCHAR(20))) AS field_source, ordinal - 1 AS field_position, CASE WHEN nullable THEN NULL ELSE 1 END AS null_flag, CASE WHEN p % 5 = 0 THEN NULL ELSE default_sql END AS default_source FROM fx_column"),
    ("fx_rdb_fields", "SELECT db_id, concat('RDB$F', CAST(p AS VARCHAR(20)), '_', CAST(s AS VARCHAR(20)), '_', table_name, '_', CAST(ordinal AS VARCHAR(20))) AS field_name, CASE sql_type WHEN 'INTEGER' THEN 8 WHEN 'VARCHAR(100)' THEN 37 WHEN 'VARCHAR(20000)' THEN 37 WHEN 'NUMERIC(15,2)' THEN 16 WHEN 'NUMERIC(20,2)' THEN 26 WHEN 'BOOLEAN' THEN 23 WHEN 'TYPE_999' THEN 999 WHEN 'NUMERIC(40,2)' THEN 26 ELSE 35 END AS field_type, CASE WHEN sql_type LIKE 'NUMERIC%' THEN 1 ELSE 0 END AS field_sub_type, CASE sql_type WHEN 'VARCHAR(100)' THEN 100 * bytes_per_char WHEN 'VARCHAR(20000)' THEN 20000 * bytes_per_char ELSE 8 END AS field_length, CASE sql_type WHEN 'NUMERIC(15,2)' THEN 15 WHEN 'NUMERIC(20,2)' THEN 20 WHEN 'NUMERIC(40,2)' THEN 40 WHEN 'INTEGER' THEN 0 END AS field_precision, CASE WHEN sql_type LIKE 'NUMERIC%' THEN -2 ELSE 0 END AS field_scale, CASE sql_type WHEN 'VARCHAR(100)' THEN 100 WHEN 'VARCHAR(20000)' THEN 20000 END AS character_length, CASE bytes_per_char WHEN 1 THEN 53 WHEN 2 THEN 10 WHEN 3 THEN 3 ELSE 4 END AS character_set_id, CASE WHEN p % 5 = 0 THEN '= 5' END AS default_source, CASE WHEN computed_sql IS NULL THEN NULL ELSE concat(' ', computed_sql, chr(10)) END AS computed_source, CAST(NULL AS INT) AS null_flag, CAST(NULL AS VARCHAR(20)) AS validation_source, 0 AS system_flag FROM fx_column UNION ALL SELECT db_id, concat('DM_', table_name), CASE WHEN k % 20 = 0 THEN 37 ELSE 16 END, CASE WHEN k % 20 = 0 THEN 0 ELSE 2 END, CASE WHEN k % 20 = 0 THEN 40 ELSE 8 END, CASE WHEN k % 20 = 0 THEN NULL ELSE 18 END, CASE WHEN k % 20 = 0 THEN 0 ELSE -4 END, CASE WHEN k % 20 = 0 THEN 10 END, 4, CASE WHEN k % 30 = 0 THEN 'DEFAULT 0' END, CAST(NULL AS VARCHAR(20)), CASE WHEN k % 40 = 0 THEN 1 END, CASE WHEN k % 50 = 0 THEN concat('CHECK (VALUE >', chr(10), '0)') END, 0 FROM fx_table WHERE k % 10 = 0 UNION ALL SELECT doc_id % 7, concat('RDB$PARAM_', CAST(doc_id AS VARCHAR(20))), CASE WHEN doc_id % 2 = 0 THEN 8 ELSE 37 END, 0, 60, CAST(NULL AS INT), 0, CASE WHEN doc_id % 2 = 1 THEN 15 END, 4, CAST(NULL AS VARCHAR(20)), CAST(NULL AS VARCHAR(20)), CAST(NULL AS INT), CAST(NULL AS VARCHAR(20)), 1 FROM documents"),
    ("fx_rdb_relation_constraints", "SELECT db_id, pk_name AS constraint_name, 'PRIMARY KEY' AS constraint_type, table_name AS relation_name, concat('RDB$PRIMARY', CAST(k AS VARCHAR(20))) AS index_name FROM fx_pk UNION ALL SELECT db_id, fk_name, 'FOREIGN KEY', table_name, concat('RDB$FOREIGN_', fk_name) FROM fx_fk UNION ALL SELECT db_id, concat('UQ_', index_name), 'UNIQUE', table_name, index_name FROM fx_index WHERE is_unique AND k % 3 = 0 UNION ALL SELECT db_id, name, 'CHECK', table_name, CAST(NULL AS VARCHAR(20)) FROM fx_check"),
    ("fx_rdb_check_constraints", "SELECT db_id, name AS constraint_name, concat('CHECK_', name, '_1') AS trigger_name FROM fx_check UNION ALL SELECT db_id, name, concat('CHECK_', name, '_2') FROM fx_check"),
    ("fx_rdb_triggers", "SELECT db_id, concat('CHECK_', name, '_1') AS trigger_name, check_sql AS trigger_source FROM fx_check UNION ALL SELECT db_id, concat('CHECK_', name, '_2'), CASE k % 5 WHEN 0 THEN 'BEGIN END' WHEN 1 THEN concat('/* made */ ', check_sql) WHEN 2 THEN CAST(NULL AS VARCHAR(20)) ELSE concat(check_sql, chr(10)) END FROM fx_check"),
    ("fx_rdb_ref_constraints", "SELECT db_id, fk_name AS constraint_name, concat('PK_', ref_table) AS const_name_uq, update_rule, delete_rule FROM fx_fk"),
    ("fx_rdb_index_segments", "SELECT p.db_id, concat('RDB$PRIMARY', CAST(k.k AS VARCHAR(20))) AS index_name, p.column_name AS field_name, p.ordinal - 1 AS field_position FROM fx_pk_col p JOIN fx_pk k ON k.db_id = p.db_id AND k.table_name = p.table_name UNION ALL SELECT db_id, concat('RDB$FOREIGN_', fk_name), column_name, ordinal - 1 FROM fx_fk_col WHERE column_name IS NOT NULL UNION ALL SELECT db_id, index_name, column_name, ordinal - 1 FROM fx_index_col"),
    ("fx_rdb_indices", "SELECT db_id, index_name, table_name AS relation_name, CASE WHEN is_unique THEN 1 ELSE 0 END AS unique_flag, CASE WHEN is_desc THEN 1 ELSE 0 END AS index_type, 0 AS system_flag FROM fx_index UNION ALL SELECT db_id, concat('RDB$PRIMARY', CAST(k AS VARCHAR(20))), table_name, 1, 0, 0 FROM fx_pk UNION ALL SELECT db_id, concat('RDB$FOREIGN_', fk_name), table_name, 0, 0, 0 FROM fx_fk"),
    ("fx_rdb_procedure_parameters", "SELECT doc_id % 7 AS db_id, concat('P', CAST(doc_id AS VARCHAR(20))) AS procedure_name, 'A_IN' AS parameter_name, 0 AS parameter_number, 0 AS parameter_type, CASE WHEN doc_id % 6 = 0 THEN 'NO_SUCH_FIELD' ELSE concat('RDB$PARAM_', CAST(doc_id AS VARCHAR(20))) END AS field_source, CASE WHEN doc_id % 4 = 0 THEN 1 END AS null_flag, CASE WHEN doc_id % 8 = 0 THEN '= 0' END AS default_source FROM documents UNION ALL SELECT doc_id % 7, concat('P', CAST(doc_id AS VARCHAR(20))), 'R_OUT', 0, 1, concat('RDB$PARAM_', CAST(doc_id AS VARCHAR(20))), CAST(NULL AS INT), CAST(NULL AS VARCHAR(20)) FROM documents WHERE doc_id % 3 = 0"),
    ("fx_rdb_functions", "SELECT doc_id % 7 AS db_id, concat('FN', CAST(doc_id AS VARCHAR(20))) AS function_name, CASE WHEN doc_id % 4 = 0 THEN 'ib_udf' END AS module_name, CASE doc_id % 4 WHEN 0 THEN 'fn_entry' WHEN 1 THEN ' ' END AS entrypoint, CASE WHEN doc_id % 4 = 2 THEN 'UDR' END AS engine_name, CASE WHEN doc_id % 9 = 0 THEN 'PKG' END AS package_name, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS legacy_flag, CASE WHEN doc_id % 9 = 0 THEN doc_id % 2 END AS private_flag, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS system_flag, CASE WHEN doc_id % 3 = 0 THEN 1 END AS return_argument FROM documents"),
    ("fx_rdb_function_arguments", "SELECT doc_id % 7 AS db_id, concat('FN', CAST(doc_id AS VARCHAR(20))) AS function_name, 0 AS argument_position, CAST((doc_id + 0) % 7 AS INT) AS mechanism, CASE (doc_id + 0) % 5 WHEN 0 THEN 8 WHEN 1 THEN 37 WHEN 2 THEN 40 WHEN 3 THEN 16 ELSE 27 END AS field_type, CASE WHEN (doc_id + 0) % 5 = 3 THEN 1 END AS field_sub_type, CAST(8 + doc_id % 90 AS INT) AS field_length, CASE WHEN (doc_id + 0) % 10 = 3 THEN 15 END AS field_precision, CASE WHEN (doc_id + 0) % 5 = 3 THEN -2 ELSE 0 END AS field_scale, CASE WHEN doc_id % 4 = 0 THEN CAST(4 + doc_id % 60 AS INT) END AS character_length FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id % 7 AS db_id, concat('FN', CAST(doc_id AS VARCHAR(20))) AS function_name, 1 AS argument_position, CAST((doc_id + 1) % 7 AS INT) AS mechanism, CASE (doc_id + 1) % 5 WHEN 0 THEN 8 WHEN 1 THEN 37 WHEN 2 THEN 40 WHEN 3 THEN 16 ELSE 27 END AS field_type, CASE WHEN (doc_id + 1) % 5 = 3 THEN 1 END AS field_sub_type, CAST(8 + doc_id % 90 AS INT) AS field_length, CASE WHEN (doc_id + 1) % 10 = 3 THEN 15 END AS field_precision, CASE WHEN (doc_id + 1) % 5 = 3 THEN -2 ELSE 0 END AS field_scale, CASE WHEN doc_id % 4 = 0 THEN CAST(4 + doc_id % 60 AS INT) END AS character_length FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id % 7 AS db_id, concat('FN', CAST(doc_id AS VARCHAR(20))) AS function_name, 2 AS argument_position, CAST((doc_id + 2) % 7 AS INT) AS mechanism, CASE (doc_id + 2) % 5 WHEN 0 THEN 8 WHEN 1 THEN 37 WHEN 2 THEN 40 WHEN 3 THEN 16 ELSE 27 END AS field_type, CASE WHEN (doc_id + 2) % 5 = 3 THEN 1 END AS field_sub_type, CAST(8 + doc_id % 90 AS INT) AS field_length, CASE WHEN (doc_id + 2) % 10 = 3 THEN 15 END AS field_precision, CASE WHEN (doc_id + 2) % 5 = 3 THEN -2 ELSE 0 END AS field_scale, CASE WHEN doc_id % 4 = 0 THEN CAST(4 + doc_id % 60 AS INT) END AS character_length FROM documents WHERE doc_id % 5 = 1"),
    ("fx_proc", "SELECT doc_id % 7 AS db_id, 'PROCEDURE' AS kind, concat('P', CAST(doc_id AS VARCHAR(20))) AS name, doc_id % 10 = 9 AS ignore_body, CASE doc_id % 4 WHEN 0 THEN concat('AS BEGIN EXECUTE PROCEDURE P', CAST(doc_id - 7 AS VARCHAR(20)), '(1); END') WHEN 1 THEN concat('AS BEGIN SELECT X FROM \"P', CAST(doc_id - 14 AS VARCHAR(20)), '\"(1) JOIN p', CAST(doc_id - 7 AS VARCHAR(20)), ' ON 1 = 1; END') WHEN 2 THEN concat('AS BEGIN EXECUTE PROCEDURE \"P', CAST(doc_id + 7 AS VARCHAR(20)), '\"; END') ELSE 'AS BEGIN SUSPEND; END' END AS source FROM documents"),
)

FX_NAMES = tuple(n for n, _ in FX_VIEWS)
# The views over orders and line items are projections of two tables, ``fx_order`` and ``fx_line`` (below); the rest are
# plans over the base tables.
# Where a view adds rows to those of another, they are exploded: a union would lose the buckets.
ORDER_VIEWS = {
    "fx_table": "SELECT db_id, table_name, k, c, st, pr FROM {order}",
    "fx_fk": "SELECT db_id, table_name, concat(prefix, CAST(k AS STRING)) AS fk_name, concat('T', CAST(db_id * 100 + (k * 11) % 105 AS STRING)) AS ref_table, CASE WHEN k % 2 = 0 OR prefix = 'FK2_' THEN '' ELSE concat('FK_', CAST(k AS STRING)) END AS support_index, 'RESTRICT' AS update_rule, CASE WHEN k % 5 = 0 THEN 'CASCADE' ELSE 'RESTRICT' END AS delete_rule, k, c"
    " FROM (SELECT *, explode(CASE WHEN k % 30 = 0 THEN array('FK_', 'FK2_') ELSE array('FK_') END) AS prefix FROM fx_table WHERE k % 3 = 0) t",
    "fx_fk_col": "SELECT db_id, table_name, fk_name, ordinal, CASE WHEN ordinal = 1 THEN concat('C', CAST(c % 12 AS STRING)) END AS column_name, CASE WHEN ordinal = 1 THEN concat('C', CAST(c % 12 AS STRING)) ELSE 'C0' END AS ref_column"
    " FROM (SELECT *, explode(CASE WHEN k % 11 = 0 THEN array(1, 2) ELSE array(1) END) AS ordinal FROM fx_fk WHERE k % 17 <> 0) f",
    "fx_t_table": "SELECT db_id, name AS table_name, k FROM (SELECT db_id, k, explode(array_compact(array(CASE WHEN k % 29 <> 0 THEN table_name END, CASE WHEN k % 31 = 0 THEN concat('N', CAST(k AS STRING)) END))) AS name FROM fx_table) t",
    "fx_t_check": "SELECT db_id, table_name, made.name, made.check_sql FROM (SELECT db_id, table_name, explode(array_compact(array(CASE WHEN k % 7 <> 0 THEN named_struct('name', name, 'check_sql', CASE WHEN k % 5 = 0 THEN concat('(', check_sql, ')') WHEN k % 3 = 0 THEN replace(upper(check_sql), chr(10), concat(chr(13), chr(10))) ELSE check_sql END) END,"
    " CASE WHEN k % 13 = 0 THEN named_struct('name', concat('CT_', name), 'check_sql', check_sql) END))) AS made FROM fx_check WHERE k % 29 <> 0) c",
}
LINE_VIEWS = {
    "fx_column": "SELECT db_id, table_name, ordinal, concat('C', CAST(p % 12 AS STRING)) AS column_name, CASE p % 9 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'VARCHAR(100)' WHEN 2 THEN 'VARCHAR(20000)' WHEN 3 THEN 'NUMERIC(15,2)' WHEN 4 THEN 'NUMERIC(20,2)' WHEN 5 THEN 'BOOLEAN' WHEN 6 THEN 'TYPE_999' WHEN 7 THEN 'NUMERIC(40,2)' ELSE 'TIMESTAMP' END AS sql_type, CAST(1 + s % 4 AS INT) AS bytes_per_char, nullable, CASE WHEN ln = 1 THEN 'DEFAULT 0' END AS default_sql, CASE WHEN returned AND ln = 7 THEN '(X * 2)' END AS computed_sql, p, s, k, copies, name_no FROM {line}",
    "fx_index": "SELECT db_id, table_name, concat('IX_', CAST(k AS STRING), '_', CAST(ln AS STRING)) AS index_name, ln = 7 AS is_unique, ln % 2 = 0 AS is_desc, k, ln FROM {line} WHERE line_no = 1",
    "fx_index_col": "SELECT db_id, table_name, concat('IX_', CAST(k AS STRING), '_', CAST(ln AS STRING)) AS index_name, segment AS ordinal, CASE WHEN s % 13 = 0 THEN concat('Z', CAST(p % 12 AS STRING)) WHEN s % 17 = 0 THEN concat('UPPER(C', CAST(p % 12 AS STRING), ')') ELSE concat('C', CAST(p % 12 AS STRING)) END AS column_name FROM {line} WHERE s % 19 <> 0",
    "fx_u_column": "SELECT db_id, table_name, ordinal, column_name, sql_type, nullable, default_sql, computed_sql, p, s FROM {column} WHERE name_no = 1",
    "fx_t_column": "SELECT db_id, table_name, ordinal, column_name, CASE WHEN p % 37 = 0 THEN 'BIGINT' ELSE sql_type END AS sql_type, CASE WHEN s % 19 = 0 THEN NOT nullable ELSE nullable END AS nullable, CASE WHEN p % 43 = 0 THEN 'DEFAULT 1' ELSE default_sql END AS default_sql, CASE WHEN p % 47 = 0 THEN '(Y + 1)' ELSE computed_sql END AS computed_sql FROM (SELECT *, explode(sequence(1, copies)) AS copy FROM {column} WHERE name_no = 1 AND p % 41 <> 0 AND k % 29 <> 0) u"
    " UNION ALL SELECT db_id, table_name, 99, 'X1', 'INTEGER', TRUE, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM fx_t_table WHERE k % 23 = 0",
    "fx_t_unique": "SELECT db_id, table_name, made.name, ordinal, made.column_name FROM (SELECT db_id, table_name, ordinal, explode(array_compact(array(CASE WHEN k % 7 <> 0 THEN named_struct('name', lower(name), 'column_name', CASE WHEN k % 11 = 0 THEN 'C0X' ELSE lower(column_name) END) END,"
    " CASE WHEN k % 13 = 0 THEN named_struct('name', concat('UT_', name), 'column_name', column_name) END))) AS made FROM fx_unique WHERE k % 29 <> 0) u",
}
_FX_SQL = dict(FX_VIEWS)
_BASE_SCANS = ("orders", "lineitem", "events", "documents", "customer")

# of each session: the folder its views are over (and which of those over written tables are there), and the order and the
# line table of every folder
_current: WeakKeyDictionary[SparkSession, tuple[str, int]] = WeakKeyDictionary()
_orders: WeakKeyDictionary[SparkSession, dict[str, str]] = WeakKeyDictionary()
_written: WeakKeyDictionary[SparkSession, dict[str, str]] = WeakKeyDictionary()


def _deps(name: str) -> list[str]:
    sql = _FX_SQL[name]
    return [n for n in FX_NAMES if n != name and re.search(rf"\b{n}\b", sql)]


def _over(roots) -> frozenset[str]:
    found = set(roots)
    while more := {n for n in FX_NAMES if n not in found and found.intersection(_deps(n))}:
        found |= more
    return frozenset(found)


OVER_LINES = _over(LINE_VIEWS)
OVER_ORDERS = _over(ORDER_VIEWS)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _no_shuffles_left(spark: SparkSession):
    """The shuffle files of a write in here go when it ends; else they stay
    until the driver happens to collect its garbage."""
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if was is None else spark.conf.set(SHUFFLE_CLEANUP, was)


def keep_table(df: DataFrame, *order: str, key: str = "db_id", **options: str) -> str:
    """The name of a table with the rows of ``df``, written once in buckets of
    ``key``, each in ``order``. Catalog keys all begin with the database, so
    joins, groups and windows of such tables read whole buckets and shuffle
    nothing; a lost executor re-reads files."""
    spark = df.sparkSession
    name = f"catwarden_fx_{uuid.uuid4().hex}"
    with _no_shuffles_left(spark):
        (df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key, *order).format("parquet").options(**options)
         .option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/catwarden-fx/{name}").saveAsTable(name))
    return name


def keep_buckets(df: DataFrame, *order: str) -> DataFrame:
    """``df`` from a table of ``keep_table``."""
    return df.sparkSession.table(keep_table(_dealt(df), *order)).hint("merge")


def keep_rows(frames: list[DataFrame]) -> DataFrame:
    """The rows of all frames, each written by a job of its own: plans stay as
    small as the largest part, and a sort of the rows does not make them twice."""
    return _write_rows(frames)[0]


def _write_rows(frames: list[DataFrame], **options: str) -> tuple[DataFrame, str]:
    spark = frames[0].sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/catwarden-rows/{uuid.uuid4().hex}"
    with _no_shuffles_left(spark):
        for i, df in enumerate(frames):
            df.write.options(**options).parquet(f"{folder}/{i}")
    return spark.read.schema(frames[0].schema).parquet(*[f"{folder}/{i}" for i in range(len(frames))]), folder


def _range_keys(spark: SparkSession, n: int) -> list[int]:
    """Of each of ``n`` buckets a number that is dealt into it."""
    found: dict[int, int] = {}
    start, step = 0, 16 * n
    while len(found) < n:
        number = F.col("id").cast("int")
        more = spark.range(start, start + step, 1, 1).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("b")).agg(F.min(number).alias("k")).collect()
        found = {r["b"]: r["k"] for r in more} | found
        start += step
    return [found[b] for b in range(n)]


def keep_ranges(frames: list[DataFrame], order: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of the rows of all frames in ``order``, written once: each
    bucket is one range of the order, number ``range_no``, and ``place`` counts
    its rows from 0. ``range_key`` is what the ranges are dealt by, so joins and
    groups on it (and more) read range by range and shuffle nothing. The copy
    that the sort reads goes when the sorted one is there.

    The table is sorted by ``range_key`` and ``columns`` but the last, which must be
    the first ones of the order."""
    spark = frames[0].sparkSession
    keep_bucket_order(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, folder = _write_rows(frames, compression="zstd")
    at = F.spark_partition_id()
    ranged = (rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .select(F.element_at(F.lit(_range_keys(spark, n)), at + 1).alias("range_key"), at.alias("range_no"),
                      F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), *columns))
    name = keep_table(ranged, *columns[:-1], "place", key="range_key", compression="zstd")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.table(name)


def keep_bucket_order(spark: SparkSession) -> None:
    """Joins on more than the buckets' key may keep the buckets as they are, and a bucket of one file its order."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "db_id")


def _write_orders(spark: SparkSession) -> str:
    """``fx_order``: every order as a catalog table."""
    return keep_table(_dealt(spark.sql("""SELECT CAST(floor(o_orderkey / 100) AS BIGINT) AS db_id, concat('T', CAST(o_orderkey AS STRING)) AS table_name,
        o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderpriority AS pr FROM orders""")), "table_name")


def _write_lines(spark: SparkSession, orders: str) -> str:
    """``fx_line``: the line items that have an order, with every number the
    views over them need. Line items are shuffled once, by database; the join
    with the orders and all windows lie within it."""
    key = ["db_id", "k"]
    own = spark.table(orders).where("k IS NOT NULL").select(*key, "table_name")
    lines = _dealt(spark.sql("""SELECT CAST(floor(l_orderkey / 100) AS BIGINT) AS db_id, l_orderkey AS k, l_linenumber AS ln, l_partkey AS p, l_suppkey AS s,
        l_quantity AS q, l_extendedprice AS price, l_shipdate AS shipped, l_returnflag = 'R' AS returned
        FROM lineitem WHERE l_orderkey IS NOT NULL"""))
    joined = lines.join(own.withColumn("copies", F.count("*").over(Window.partitionBy(*key))).hint("merge"), key)
    tie = ["p", "s", "q", "price", "shipped"]

    def place(order, *by):
        return F.row_number().over(Window.partitionBy(*key, *by).orderBy(*order))

    table = (joined.withColumn("ordinal", place(["ln", *tie])).withColumn("line_no", place(tie, "ln"))
             .withColumn("segment", place([F.expr("p % 12"), *tie], "ln", F.expr("coalesce(s % 19 <> 0, false)")))
             .withColumn("name_no", place(["ordinal"], F.expr("p % 12")))
             .select("db_id", "table_name", "k", "ln", "p", "s", (F.col("q") < 25).alias("nullable"), "returned", "copies", "ordinal", "segment", "name_no", "line_no"))
    return keep_table(table, "table_name", "ordinal")


def register_fixtures(spark: SparkSession, sf_dir: str, lines: bool = True, orders: bool = False) -> None:
    """Register base tables and all fx views for ``sf_dir`` (idempotent).

    The views over line items and orders need ``fx_line`` and ``fx_order``,
    which are written once a folder under the session's shared checkpoint
    folder and never rewritten, so plans over them hold when another folder is
    registered in between. Without ``lines`` and ``orders`` neither is written:
    queries of the other tables then read only what they need.
    """
    need = 2 if lines else 1 if orders else 0
    at, have = _current.get(spark, (None, -1))
    if at == sf_dir and have >= need:
        return
    if at != sf_dir:
        register_base_tables(spark, sf_dir)
        have = -1
    if need:
        keep_bucket_order(spark)
    kept, roots = _orders.setdefault(spark, {}), _written.setdefault(spark, {})
    if need and sf_dir not in kept:
        kept[sf_dir] = _write_orders(spark)
    if lines and sf_dir not in roots:
        roots[sf_dir] = _write_lines(spark, kept[sf_dir])
    for name, sql in FX_VIEWS:
        level = 2 if name in OVER_LINES else 1 if name in OVER_ORDERS else 0
        if not have < level <= max(need, 1):
            continue
        if name in LINE_VIEWS:
            sql = LINE_VIEWS[name].format(line=roots[sf_dir], column=f"({LINE_VIEWS['fx_column'].format(line=roots[sf_dir])})")
        elif name in ORDER_VIEWS and need:
            sql = ORDER_VIEWS[name].format(order=kept[sf_dir])
        df = spark.sql(sql)
        if name == "fx_column":
            df = df.drop("k", "copies", "name_no")
        df.createOrReplaceTempView(name)
    _current[spark] = sf_dir, need


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fx view. The hint keeps joins of catalog tables from being
    broadcast by the size of their files, which says little of their rows."""
    register_fixtures(spark, sf_dir, name in OVER_LINES, name in OVER_ORDERS)
    return spark.table(name).hint("merge")


def oracle_with(body_sql: str) -> str:
    """Prefix ``body_sql`` with the fx views it uses, as DuckDB CTEs."""
    needed: list[str] = []

    def visit(n: str) -> None:
        if n in needed:
            return
        for d in _deps(n):
            visit(d)
        needed.append(n)

    for n in FX_NAMES:
        if re.search(rf"\b{n}\b", body_sql):
            visit(n)
    if not needed:
        return body_sql
    texts = [body_sql, *(_FX_SQL[n] for n in needed)]

    def cte(n: str) -> str:
        # a view that is read more than once is computed once
        uses = sum(len(re.findall(rf"\b{n}\b", t)) for t in texts)
        return f"{n} AS {'MATERIALIZED ' if uses > 1 else ''}({_FX_SQL[n]})"

    ctes = ",\n".join(map(cte, needed))
    body = body_sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
