"""Script queries: split, sniff, classify, parse, load, profile, round trip.

The corpus is derived from ``customer`` (through ``fx_stmt``): one script
file per 100 customers, holding one statement per customer plus comment
lines, multi-line statements, ``SET TERM`` blocks, CRLF line ends on every
third file and ISO-8859-1 bytes on odd files. The oracle computes the
expected statements and line numbers straight from ``fx_stmt``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import script_chunks as C
from ..operators import scripts as S
from ..operators import transfer as X
from ..sources.fixtures import register_fixtures
from ..sources.tables import read_table
from .registry import register


# ---------------------------------------------------------------- corpus

def statement_blocks(stmts: DataFrame) -> DataFrame:
    """Lines of each statement block: optional comment line, the statement
    (split before VALUES on every tenth+7), optional SET TERM block."""
    k = F.col("stmt_no")
    pre = (F.when(k % 10 == 3, F.array(F.concat(F.lit("-- statement "), k.cast("string"))))
            .when(k % 10 == 5, F.array(F.lit("/* note; here */")))
            .otherwise(F.array().cast("array<string>")))
    multi = F.array(F.regexp_extract("sql_text", r"(?s)^(.*?) VALUES (.*)$", 1),
                    F.concat(F.lit("VALUES "), F.regexp_extract("sql_text", r"(?s)^(.*?) VALUES (.*)$", 2)))
    body = F.when(k % 10 == 7, multi).otherwise(F.array("sql_text"))
    post = F.when(k % 25 == 0, F.array(
        F.lit("SET TERM ^ ;"),
        F.concat(F.lit("EXECUTE BLOCK AS BEGIN INSERT INTO LOG VALUES ("), k.cast("string"), F.lit("); END^")),
        F.lit("SET TERM ; ^"))).otherwise(F.array().cast("array<string>"))
    return stmts.withColumn("block", F.concat(pre, body, post))


def build_corpus(stmts: DataFrame) -> DataFrame:
    """(path, content) per file; a file's statements are bounded (100) by
    construction, so assembling one file text in one group is bounded."""
    b = statement_blocks(stmts)
    files = b.groupBy("file_no").agg(F.sort_array(F.collect_list(F.struct("stmt_no", "block"))).alias("_b"))
    charset = F.when(F.col("file_no") % 2 == 1, F.lit("ISO8859_1")).otherwise(F.lit("UTF8"))
    header = F.array(F.lit("SET SQL DIALECT 3;"), F.concat(F.lit("SET NAMES "), charset, F.lit(";")), F.lit(""))
    lines = F.concat(header, F.flatten(F.transform("_b", lambda x: x["block"])))
    eol = F.when(F.col("file_no") % 3 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    text = F.array_join(lines, "\n")
    text = F.when(F.col("file_no") % 3 == 0, F.replace(text, F.lit("\n"), eol)).otherwise(text)
    content = F.when(F.col("file_no") % 2 == 1, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    path = F.concat(F.lit("corpus/file_"), F.lpad(F.col("file_no").cast("string"), 5, "0"), F.lit(".sql"))
    return files.select(path.alias("path"), content.alias("content"))


def corpus(spark, sf):
    register_fixtures(spark, sf, lines=False)
    return build_corpus(spark.table("fx_stmt"))


def statements(spark, sf):
    return S.script_statements(corpus(spark, sf))


PATH_SQL = "'corpus/file_' || lpad(CAST(file_no AS VARCHAR), 5, '0') || '.sql'"

EXPECTED_CTE = f"""
blk AS (
  SELECT file_no, stmt_no, sql_text,
         CASE WHEN stmt_no % 10 IN (3, 5) THEN 1 ELSE 0 END AS pre_len,
         CASE WHEN stmt_no % 10 = 7 THEN 2 ELSE 1 END AS body_len,
         CASE WHEN stmt_no % 25 = 0 THEN 3 ELSE 0 END AS post_len
  FROM fx_stmt),
pos AS (
  SELECT *, 4 + coalesce(sum(pre_len + body_len + post_len) OVER (PARTITION BY file_no ORDER BY stmt_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block_start
  FROM blk),
exp AS (
  SELECT file_no, stmt_no, 0 AS sub, block_start + pre_len AS start_line,
         CASE WHEN stmt_no % 10 = 7
              THEN regexp_extract(rtrim(sql_text, ';'), '(?s)^(.*?) VALUES (.*)$', 1) || chr(10) || 'VALUES '
                   || regexp_extract(rtrim(sql_text, ';'), '(?s)^(.*?) VALUES (.*)$', 2)
              ELSE rtrim(sql_text, ';') END AS sql_text
  FROM pos
  UNION ALL
  SELECT file_no, stmt_no, 1, block_start + pre_len + body_len + 1,
         'EXECUTE BLOCK AS BEGIN INSERT INTO LOG VALUES (' || CAST(stmt_no AS VARCHAR) || '); END'
  FROM pos WHERE stmt_no % 25 = 0),
expected AS (
  SELECT {PATH_SQL} AS path, CAST(row_number() OVER (PARTITION BY file_no ORDER BY stmt_no, sub) AS BIGINT) AS stmt_no,
         CAST(start_line AS BIGINT) AS start_line, sql_text, file_no, stmt_no AS src_no
  FROM exp)
"""


register("script_statements", f"WITH {EXPECTED_CTE} SELECT path, stmt_no, start_line, sql_text FROM expected")(
    lambda spark, sf: statements(spark, sf).select("path", "stmt_no", "start_line", "sql_text"))

register("script_charset", f"""
SELECT DISTINCT {PATH_SQL} AS path, CASE WHEN file_no % 2 = 1 THEN 'ISO8859_1' ELSE 'UTF8' END AS charset FROM fx_stmt""")(
    lambda spark, sf: corpus(spark, sf).select("path", S.script_charset(F.col("content")).alias("charset")))

@register("run_metrics", f"""
WITH {EXPECTED_CTE},
lines AS (SELECT file_no, sum(pre_len + body_len + post_len) AS body_lines,
                 count(*) FILTER (WHERE stmt_no % 25 = 0) AS blocks FROM blk GROUP BY file_no),
cmds AS (SELECT file_no, count(*) AS commands FROM expected GROUP BY file_no)
SELECT {PATH_SQL} AS path, CAST(3 + body_lines AS BIGINT) AS lines_read,
       CAST(body_lines - 2 * blocks AS BIGINT) AS lines_processed, commands
FROM lines JOIN cmds USING (file_no)""")
def q_run_metrics(spark, sf):
    """Lines read, lines processed (headers, blanks and SET lines not
    counted) and commands per file."""
    st = statements(spark, sf)
    return st.groupBy("path").agg(F.max("lines_read").alias("lines_read"),
                                  F.max("lines_processed").alias("lines_processed"),
                                  F.count("sql_text").alias("commands"))


# ---------------------------------------------------------------- F16 / F17 / A15

register("target_table", r"""
SELECT file_no, stmt_no,
  CASE WHEN regexp_extract(sql_text, '(?is)^\s*(?:UPDATE\s+OR\s+INSERT\s+INTO|INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO)\s+("[^"]+"|[^\s(),;]+)', 1) = ''
       THEN NULL
       ELSE upper(regexp_extract(sql_text, '(?is)^\s*(?:UPDATE\s+OR\s+INSERT\s+INTO|INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO)\s+("[^"]+"|[^\s(),;]+)', 1)) END AS target
FROM fx_stmt""")(lambda spark, sf: (register_fixtures(spark, sf, lines=False), spark.table("fx_stmt"))[1].select(
    "file_no", "stmt_no", S.target_table(F.col("sql_text")).alias("target")))

ARITY_SQL = r"""
masked AS (SELECT file_no, stmt_no, regexp_replace(sql_text, '''[^'']*(''''[^'']*)*''', '''''', 'g') AS m FROM fx_stmt),
cnt AS (SELECT file_no, stmt_no,
          CAST(length(regexp_extract(m, '\(([^)]*)\)', 1)) - length(replace(regexp_extract(m, '\(([^)]*)\)', 1), ',', '')) + 1 AS INT) AS n_columns,
          CAST(length(regexp_extract(m, '(?i)VALUES\s*\(([^)]*)\)', 1)) - length(replace(regexp_extract(m, '(?i)VALUES\s*\(([^)]*)\)', 1), ',', '')) + 1 AS INT) AS n_values
        FROM masked)
"""

register("insert_arity", f"""WITH {ARITY_SQL}
SELECT file_no, stmt_no, n_columns, n_values,
  CASE WHEN n_columns <> n_values THEN 'Column count (' || n_columns || ') differs from value count (' || n_values || ').' END AS error
FROM cnt""")(lambda spark, sf: (register_fixtures(spark, sf, lines=False), spark.table("fx_stmt"))[1]
             .withColumn("_p", S.parse_insert(F.col("sql_text")))
             .select("file_no", "stmt_no", "_p.n_columns", "_p.n_values", "_p.error"))


def dml_kind(sql):
    return (F.when(sql.rlike(r"(?is)^\s*UPDATE\s+OR\s+INSERT\b"), F.lit("UPSERT"))
             .when(sql.rlike(r"(?is)^\s*INSERT\b"), F.lit("INSERT"))
             .when(sql.rlike(r"(?is)^\s*EXECUTE\s+BLOCK\b"), F.lit("BLOCK"))
             .otherwise(F.lit("OTHER")))


@register("statement_profile", f"""
WITH {EXPECTED_CTE}
SELECT path, CASE WHEN regexp_matches(sql_text, '(?is)^\\s*UPDATE\\s+OR\\s+INSERT\\b') THEN 'UPSERT'
                  WHEN regexp_matches(sql_text, '(?is)^\\s*INSERT\\b') THEN 'INSERT'
                  WHEN regexp_matches(sql_text, '(?is)^\\s*EXECUTE\\s+BLOCK\\b') THEN 'BLOCK' ELSE 'OTHER' END AS kind,
       upper(nullif(regexp_extract(sql_text, '(?is)^\\s*(?:UPDATE\\s+OR\\s+INSERT\\s+INTO|INSERT\\s+INTO|UPDATE|DELETE\\s+FROM|MERGE\\s+INTO)\\s+("[^"]+"|[^\\s(),;]+)', 1), '')) AS target,
       count(*) AS statements
FROM expected GROUP BY ALL""")
def q_statement_profile(spark, sf):
    """Statements per file, kind and target table."""
    st = statements(spark, sf)
    return (st.where(F.col("sql_text").isNotNull())
              .groupBy("path", dml_kind(F.col("sql_text")).alias("kind"),
                       S.target_table(F.col("sql_text")).alias("target"))
              .agg(F.count(F.lit(1)).alias("statements")))


# ---------------------------------------------------------------- S15 / S11 / A12

CUSTOMER_SCHEMA = "C_CUSTKEY bigint, C_NAME string"


def _loaded(spark, sf):
    from pyspark.sql.types import _parse_datatype_string
    st = statements(spark, sf).where(F.col("sql_text").isNotNull())
    return S.load_inserts(st.select("path", "stmt_no", "sql_text"), "CUSTOMER",
                          _parse_datatype_string(CUSTOMER_SCHEMA))


def replay_files(spark, sf):
    """A file for each 100 customers with the statements of ``fx_replay`` (a
    bounded number) in order."""
    register_fixtures(spark, sf, lines=False)
    one = F.sort_array(F.collect_list(F.struct("seq", "sql_text")))
    files = spark.table("fx_replay").groupBy("file_no").agg(one.alias("s"))
    return files.select(F.col("file_no").cast("string").alias("path"),
                        F.encode(F.array_join(F.transform("s", lambda x: x["sql_text"]), "\n"), "UTF-8").alias("content"))


def _settled(spark, sf):
    from pyspark.sql.types import _parse_datatype_string
    replayed = S.replay(S.script_statements(replay_files(spark, sf)), "CUSTOMER",
                        _parse_datatype_string(CUSTOMER_SCHEMA), key=["C_CUSTKEY"])
    return S.settle_keys(replayed, ["C_CUSTKEY"], ["path", "stmt_no"])


@register("replay_accounting", """
SELECT CAST(file_no AS VARCHAR) AS path, count(*) AS statements, count(*) FILTER (WHERE fate = 'loaded') AS loaded,
       count(*) FILTER (WHERE fate = 'merged') AS merged, count(*) FILTER (WHERE fate = 'quarantined') AS quarantined,
       count(*) FILTER (WHERE fate = 'not_applicable') AS not_applicable
FROM fx_replay GROUP BY file_no""")
def q_replay_accounting(spark, sf):
    """Statements in = loaded + merged + quarantined + not applicable, per file."""
    return _settled(spark, sf).groupBy("path").agg(
        F.count(F.lit(1)).alias("statements"),
        *[F.count_if(F.col("fate") == f).alias(f) for f in ("loaded", "merged", "quarantined", "not_applicable")])


@register("replay_upserts", """
SELECT c_custkey AS C_CUSTKEY,
       CASE WHEN c_custkey % 3 = 0 THEN 'renamed' || chr(10) || CAST(c_custkey AS VARCHAR)
            WHEN c_custkey % 50 <> 0 AND c_custkey % 7 = 0 THEN 'a, (b' WHEN c_custkey % 50 <> 0 THEN c_name || ', it''s'
            ELSE 'again' END AS C_NAME
FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 50 <> 0 OR c_custkey % 11 = 0
UNION ALL
SELECT -c_custkey - 1, 'line' || chr(10) || 'two; (' FROM customer WHERE c_custkey % 17 = 0""")
def q_replay_upserts(spark, sf):
    """The table after all INSERT and UPDATE OR INSERT statements, in order."""
    from pyspark.sql.types import _parse_datatype_string
    return S.replay_table(_settled(spark, sf), _parse_datatype_string(CUSTOMER_SCHEMA), ["C_CUSTKEY"], ["path", "stmt_no"])


LOAD_CTE = f"""{EXPECTED_CTE},
src AS (SELECT e.path, e.stmt_no, e.src_no, s.file_no FROM expected e JOIN fx_stmt s ON s.file_no = e.file_no
        AND s.stmt_no = e.src_no WHERE e.sql_text NOT LIKE 'EXECUTE BLOCK%')
"""

register("load_inserts", f"""WITH {LOAD_CTE}
SELECT s.path, s.stmt_no, c.c_custkey AS C_CUSTKEY, c.c_name || ', it''s' AS C_NAME
FROM src s JOIN customer c ON c.c_custkey = s.src_no WHERE c.c_custkey % 50 <> 0 AND c.c_custkey % 7 <> 0""")(
    lambda spark, sf: _loaded(spark, sf)[0])

register("quarantine", f"""WITH {LOAD_CTE}
SELECT path, stmt_no, 'Column count (3) differs from value count (2).' AS error FROM src WHERE src_no % 50 = 0""")(
    lambda spark, sf: _loaded(spark, sf)[1].select("path", "stmt_no", "error"))


@register("import_outcomes", f"""WITH {LOAD_CTE},
per AS (SELECT path, count(*) FILTER (WHERE src_no % 50 = 0) AS errors FROM src GROUP BY path)
SELECT CASE WHEN errors = 0 THEN 'succeeded' ELSE 'succeeded_with_errors' END AS outcome, count(*) AS files
FROM per GROUP BY 1""")
def q_import_outcomes(spark, sf):
    """A12 with continue-on-error: files succeeded / succeeded with errors
    (a fail-fast run marks the same files failed)."""
    from pyspark.sql.types import _parse_datatype_string
    fates = S.replay(statements(spark, sf), "CUSTOMER", _parse_datatype_string(CUSTOMER_SCHEMA))
    per = fates.groupBy("path").agg(F.count_if(F.col("fate") == "quarantined").alias("errors"))
    return import_outcomes(per, continue_on_error=True)


def import_outcomes(per_file: DataFrame, continue_on_error: bool) -> DataFrame:
    bad = "succeeded_with_errors" if continue_on_error else "failed"
    out = F.when(F.col("errors") == 0, F.lit("succeeded")).otherwise(F.lit(bad))
    return per_file.groupBy(out.alias("outcome")).agg(F.count(F.lit(1)).alias("files"))


# ---------------------------------------------------------------- U03 round trip

@register("roundtrip_verify", """
SELECT count(*) AS original_rows, count(*) AS reimported_rows, CAST(0 AS BIGINT) AS original_only,
       CAST(0 AS BIGINT) AS reimported_only FROM customer""")
def q_roundtrip(spark, sf):
    """Customer -> INSERT script files -> split -> parse -> load equals
    the original (multiset), so both one-sided counts are 0."""
    from pyspark.sql.types import _parse_datatype_string
    cust = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("C_CUSTKEY"), F.col("c_name").alias("C_NAME"),
        F.col("c_acctbal").cast("decimal(15,2)").alias("C_ACCTBAL"), F.col("c_mktsegment").alias("C_MKTSEGMENT"))
    rendered = X.render_insert(cust, "CUSTOMER", keep=["C_CUSTKEY"])
    stmts = rendered.select((F.col("C_CUSTKEY") / 100).cast("bigint").alias("file_no"),
                            F.col("C_CUSTKEY").alias("stmt_no"), "sql")
    files = build_corpus(stmts.withColumnRenamed("sql", "sql_text"))
    st = S.script_statements(files).where(F.col("sql_text").isNotNull() & ~F.col("sql_text").startswith("EXECUTE"))
    schema = _parse_datatype_string("C_CUSTKEY bigint, C_NAME string, C_ACCTBAL decimal(15,2), C_MKTSEGMENT string")
    good, bad = S.load_inserts(st.select("path", "stmt_no", "sql_text"), "CUSTOMER", schema)
    back = good.select(*schema.names)
    diff = X.roundtrip_diff(cust, back)
    counts = diff.groupBy().agg(F.count_if(F.col("side") == "original_only").alias("original_only"),
                                F.count_if(F.col("side") == "reimported_only").alias("reimported_only"))
    sizes = cust.agg(F.count(F.lit(1)).alias("original_rows")).withColumn("_one", F.lit(1)).join(
        back.agg(F.count(F.lit(1)).alias("reimported_rows")).withColumn("_one", F.lit(1)), "_one")
    return sizes.join(counts.withColumn("_one", F.lit(1)), "_one").drop("_one")


# ---------------------------------------------------------------- F20 / W04 over a DDL corpus

DDL_KIND_SQL = r"""
SELECT db_id, stmt_no, sql_text,
  CASE WHEN regexp_matches(sql_text, '(?i)^\s*CREATE\s+DOMAIN\s') THEN 'DOMAIN'
       WHEN regexp_matches(sql_text, '(?i)^\s*CREATE\s+(SEQUENCE|GENERATOR)\s') THEN 'SEQUENCE'
       WHEN regexp_matches(sql_text, '(?i)^\s*CREATE\s+OR\s+ALTER\s+PROCEDURE\s') THEN 'PROCEDURE'
       WHEN regexp_matches(sql_text, '(?i)^\s*CREATE\s+VIEW\s') THEN 'VIEW'
       WHEN regexp_matches(sql_text, '(?i)^\s*CREATE\s+(UNIQUE\s+)?(DESCENDING\s+)?INDEX\s') THEN 'INDEX'
       WHEN regexp_matches(sql_text, '(?i)^\s*ALTER\s+TABLE\s+\S+\s+ADD\s+CONSTRAINT\s') THEN 'CONSTRAINT' END AS kind,
  upper(replace(CASE
       WHEN regexp_matches(sql_text, '(?i)^\s*ALTER\s+TABLE') THEN regexp_extract(sql_text, '(?i)ADD\s+CONSTRAINT\s+("[^"]+"|[^\s(;]+)', 1)
       WHEN regexp_matches(sql_text, '(?i)^\s*CREATE\s+OR\s+ALTER') THEN regexp_extract(sql_text, '(?i)^\s*CREATE\s+OR\s+ALTER\s+\S+\s+("[^"]+"|[^\s(;]+)', 1)
       WHEN regexp_matches(sql_text, '(?i)INDEX\s') THEN regexp_extract(sql_text, '(?i)INDEX\s+("[^"]+"|[^\s(;]+)', 1)
       ELSE regexp_extract(sql_text, '(?i)^\s*CREATE\s+\S+\s+("[^"]+"|[^\s(;]+)', 1) END, '"', '')) AS name
FROM fx_ddl"""


def _ddl_kinds(spark, sf):
    register_fixtures(spark, sf, lines=False)
    d = spark.table("fx_ddl")
    kind, name = S.statement_kind(F.col("sql_text"))
    return d.select("db_id", "stmt_no", "sql_text", kind.alias("kind"), name.alias("name"))


register("statement_kind", DDL_KIND_SQL)(_ddl_kinds)

register("latest_definition", f"""
WITH k AS ({DDL_KIND_SQL})
SELECT db_id, kind, name,
       CASE WHEN kind IN ('SEQUENCE', 'DOMAIN') THEN min(stmt_no) ELSE max(stmt_no) END AS stmt_no,
       CASE WHEN kind IN ('SEQUENCE', 'DOMAIN') THEN arg_min(sql_text, stmt_no) ELSE arg_max(sql_text, stmt_no) END AS sql_text,
       count(*) AS declarations
FROM k GROUP BY db_id, kind, name""")(
    lambda spark, sf: S.latest_definition(_ddl_kinds(spark, sf), ["db_id"]))


# ---------------------------------------------------------------- S05: one script of all documents

# A document is a quoted text, a comment, a block under another terminator, or a remark with a statement.
LONG_SQL = """
SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN concat('INSERT INTO DOC VALUES (', CAST(doc_id AS VARCHAR(20)), ', ''', replace(body, '''', ''''''), ''');')
    WHEN 1 THEN concat('/* ', replace(body, '*/', ''), ' */ DELETE FROM DOC', chr(10), 'WHERE ID = ', CAST(doc_id AS VARCHAR(20)), ' ;')
    WHEN 2 THEN concat('SET TERM ^ ;', chr(10), 'EXECUTE BLOCK AS BEGIN', chr(10), 'P = ''', replace(body, '''', ''), '''; END ^', chr(10), 'SET TERM ; ^')
    ELSE concat('-- it''s ', CAST(doc_id AS VARCHAR(20)), chr(10), chr(10), 'UPDATE DOC SET A = 1;', chr(10)) END AS block
FROM (SELECT doc_id, concat(replace(coalesce(text, ''), chr(13), ''), chr(10), 'end ', CAST(doc_id AS VARCHAR(20))) AS body FROM documents) d"""
LONG_CHUNK_DOCS = 25


def long_script(spark, sf):
    """(path, chunk, content): one script over all documents, ordered by id. A chunk has some documents, the last of which goes
    on in the next chunk from its third line, so that quoted texts, comments and terminators cross from chunk to chunk."""
    read_table(spark, sf, "documents").createOrReplaceTempView("long_script_documents")
    blocks = spark.sql(LONG_SQL.replace("FROM documents", "FROM long_script_documents"))
    lines = blocks.select("doc_id", F.posexplode(F.split("block", "\n")).alias("pos", "line"))
    chunk = F.floor((F.col("doc_id") + F.when(F.col("pos") >= 2, 1).otherwise(0)) / LONG_CHUNK_DOCS)
    gathered = lines.groupBy(chunk.cast("bigint").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "pos", "line"))).alias("l"))
    text = F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))
    return gathered.select(F.lit("documents.sql").alias("path"), "chunk", F.encode(text, "UTF-8").alias("content"))


@register("long_script_statements", f"""
WITH blk AS ({LONG_SQL}),
pos AS (SELECT doc_id, block, length(block) - length(replace(block, chr(10), '')) + 1 AS n,
               coalesce(sum(length(block) - length(replace(block, chr(10), '')) + 1)
                        OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blk),
doc AS (SELECT p.*, concat(replace(coalesce(d.text, ''), chr(13), ''), chr(10), 'end ', CAST(d.doc_id AS VARCHAR(20))) AS body
        FROM pos p JOIN documents d ON d.doc_id = p.doc_id)
SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS stmt_no,
       CAST(before + CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN n - 1 WHEN 2 THEN 2 ELSE 3 END AS BIGINT) AS start_line,
       CASE doc_id % 4 WHEN 0 THEN rtrim(block, ';') WHEN 1 THEN concat('DELETE FROM DOC', chr(10), 'WHERE ID = ', CAST(doc_id AS VARCHAR(20)))
            WHEN 2 THEN concat('EXECUTE BLOCK AS BEGIN', chr(10), 'P = ''', replace(body, '''', ''), '''; END')
            ELSE 'UPDATE DOC SET A = 1' END AS sql_text,
       CAST((SELECT sum(n) FROM pos) AS BIGINT) AS lines_read
FROM doc""")
def q_long_script_statements(spark, sf):
    """S05 for one file of any size: its chunks are read apart and give the statements of one sequential pass."""
    return C.chunk_statements(long_script(spark, sf)).select("stmt_no", "start_line", "sql_text", "lines_read")
