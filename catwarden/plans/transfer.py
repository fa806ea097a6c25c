"""Transfer queries: scans, custom queries, literal rendering, batches, upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transfer as X
from ..operators.catalog import fixture_catalog
from ..sources.tables import read_table, register_base_tables
from .registry import register


def _t(spark, sf, name):
    return read_table(spark, sf, name)


# ---------------------------------------------------------------- S01 + P02

register("scan_table", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'AUTOMOBILE'")(
    lambda spark, sf: X.scan_table(_t(spark, sf, "customer"), ["c_custkey", " c_name", "c_acctbal"],
                                   "WHERE  c_acctbal > 5000 AND c_mktsegment <> 'AUTOMOBILE'"))

# ---------------------------------------------------------------- S02 custom queries (Spark SQL on views)

Q_JOIN = """SELECT o.o_orderkey, c.c_name, n.n_name, o.o_totalprice
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE o.o_orderstatus = 'F';"""
Q_EXPR = """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
  CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS state, upper(l_linestatus) AS ls FROM lineitem"""
Q_ORDER = "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey ;"
Q_PROJECTION = "select c_name, c_custkey, c_nationkey FROM customer"


def _sql_query(text):
    def run(spark, sf):
        register_base_tables(spark, sf)
        return X.scan_query(spark, text)
    return run


for _name, _text in (("q_join", Q_JOIN), ("q_expr", Q_EXPR), ("q_order", Q_ORDER), ("q_projection", Q_PROJECTION)):
    register(_name, X.normalize_select(_text))(_sql_query(_text))

# ---------------------------------------------------------------- F01 / F02 rendering

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("render_insert", """
SELECT o_orderkey, 'INSERT INTO ORDERS_COPY (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) VALUES ('
  || coalesce(CAST(o_orderkey AS VARCHAR), 'NULL') || ', ' || coalesce(CAST(o_custkey AS VARCHAR), 'NULL') || ', '
  || coalesce('''' || replace(o_orderstatus, '''', '''''') || '''', 'NULL') || ', '
  || coalesce(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), 'NULL') || ', '
  || coalesce('''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '''', 'NULL') || ', '
  || coalesce('''' || replace(o_orderpriority, '''', '''''') || '''', 'NULL') || ');' AS sql
FROM orders""")
def q_render_insert(spark, sf):
    o = _t(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(15,2)"))
    return X.render_insert(o, "ORDERS_COPY", ORDER_COLS, keep=["o_orderkey"])


@register("render_upsert", """
SELECT c_custkey, 'UPDATE OR INSERT INTO CUSTOMER (c_custkey, c_name, c_acctbal, c_mktsegment) VALUES ('
  || CAST(c_custkey AS VARCHAR) || ', ' || coalesce('''' || replace(c_name, '''', '''''') || '''', 'NULL') || ', '
  || coalesce(CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR), 'NULL') || ', '
  || coalesce('''' || replace(c_mktsegment, '''', '''''') || '''', 'NULL') || ') MATCHING (c_custkey);' AS sql
FROM customer""")
def q_render_upsert(spark, sf):
    c = _t(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(15,2)"))
    cols = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    missing = X.upsert_missing_pk(["C_CUSTKEY"], cols)
    if missing:
        raise X.TransferError(f"The upsert leaves out key columns: {missing}")
    return X.render_insert(c, "CUSTOMER", cols, mode="upsert", matching=["c_custkey"], keep=["c_custkey"])


@register("blob_literal", """
SELECT doc_id, 'x''' || upper(hex(encode(text))) || '''' AS hex_literal, '''' || to_base64(encode(text)) || '''' AS b64_literal
FROM documents""")
def q_blob_literal(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return d.select("doc_id", X.blob_literal(F.col("b"), "hex").alias("hex_literal"),
                    X.blob_literal(F.col("b"), "base64").alias("b64_literal"))


@register("quote_text", r"""
SELECT doc_id, '''' || replace(replace(replace(regexp_replace(text, '[^\r\n\t\x20-\xFF]', '', 'g'),
         chr(13), '\r'), chr(10), '\n'), '''', '''''') || '''' AS literal
FROM documents""")
def q_quote_text(spark, sf):
    """F04-F06 in the reference's order: sanitise, escape, quote."""
    d = _t(spark, sf, "documents")
    return d.select("doc_id", X.literal(F.col("text"), d.schema["text"].dataType, sanitize=True, escape=True)
                    .alias("literal"))


# ---------------------------------------------------------------- P01 / P10 (catalog driven)

register("writable_columns", """
SELECT db_id, table_name, ordinal, column_name FROM fx_column
WHERE computed_sql IS NULL OR regexp_replace(computed_sql, '\\s', '', 'g') = ''""")(
    lambda spark, sf: X.writable_columns(fixture_catalog(spark, sf)).withColumn("ordinal", F.col("ordinal").cast("bigint")))


@register("writable_upsert_check", """
SELECT p.db_id, p.table_name, p.column_name FROM fx_pk_col p
WHERE NOT EXISTS (SELECT 1 FROM fx_column c WHERE c.db_id = p.db_id AND c.table_name = p.table_name
                  AND upper(c.column_name) = upper(p.column_name)
                  AND (c.computed_sql IS NULL OR regexp_replace(c.computed_sql, '\\s', '', 'g') = ''))""")
def q_writable_upsert_check(spark, sf):
    """P10 over the fleet: PK columns that the writable projection lacks."""
    cat = fixture_catalog(spark, sf)
    w = X.writable_columns(cat).select("db_id", "table_name", F.upper("column_name").alias("ckey"))
    pk = cat.pk_cols.withColumn("ckey", F.upper("column_name"))
    return pk.join(w, ["db_id", "table_name", "ckey"], "left_anti").select("db_id", "table_name", "column_name")


# ---------------------------------------------------------------- S10 commit batches

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
COMMIT_EVERY = 500


@register("commit_batches", f"""
WITH n AS (SELECT *, row_number() OVER (ORDER BY {", ".join(LINE_ORDER)}) AS rn FROM lineitem)
SELECT (rn - 1) // {COMMIT_EVERY} AS batch_id, count(*) AS n_rows, sum(l_quantity) AS sum_qty,
       CAST(CASE WHEN count(*) = {COMMIT_EVERY} THEN 1 ELSE 0 END
            + CASE WHEN max(rn) = (SELECT count(*) FROM lineitem) THEN 1 ELSE 0 END AS BIGINT) AS commits
FROM n GROUP BY 1""")
def q_commit_batches(spark, sf):
    li = _t(spark, sf, "lineitem")
    numbered = X.commit_batches(X.global_row_number(li, LINE_ORDER), COMMIT_EVERY)
    total = li.agg(F.count(F.lit(1)).alias("_total"))
    per = numbered.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_qty"),
                                           F.max("row_no").alias("_last"))
    # the total is a one-row aggregate: an equi-join on a constant key
    return (per.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
               .select("batch_id", "n_rows", "sum_qty",
                       ((F.col("n_rows") == COMMIT_EVERY).cast("bigint")
                        + (F.col("_last") == F.col("_total")).cast("bigint")).alias("commits")))


# ---------------------------------------------------------------- S14 upsert replay

@register("apply_upsert", """
WITH ch AS (SELECT o_custkey AS c_custkey, 'Customer#' || CAST(o_orderkey AS VARCHAR) AS c_name,
                   o_totalprice AS c_acctbal, o_orderkey AS stmt_no FROM orders WHERE o_orderstatus = 'F'),
latest AS (SELECT c_custkey, arg_max(c_name, stmt_no) AS c_name, arg_max(c_acctbal, stmt_no) AS c_acctbal
           FROM ch GROUP BY c_custkey)
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM latest)
UNION ALL SELECT * FROM latest""")
def q_apply_upsert(spark, sf):
    """Replay of the finished orders only, as the query's SQL has it; all orders: ``apply_upsert_all``."""
    return _replay_orders(spark, sf, _t(spark, sf, "orders").where(F.col("o_orderstatus") == "F"))


def _replay_orders(spark, sf, o):
    """Each order is one upsert of its customer; the last by o_orderkey wins."""
    target = _t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = o.select(F.col("o_custkey").alias("c_custkey"),
                       F.concat(F.lit("Customer#"), F.col("o_orderkey").cast("string")).alias("c_name"),
                       F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("stmt_no"))
    return X.apply_upsert(target, changes, ["c_custkey"], "stmt_no")


@register("apply_upsert_all", """
WITH latest AS (SELECT o_custkey AS c_custkey, 'Customer#' || CAST(o_orderkey AS VARCHAR) AS c_name, o_totalprice AS c_acctbal
                FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT c_custkey, c_name, c_acctbal FROM customer c WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.c_custkey = c.c_custkey)
UNION ALL SELECT * FROM latest""")
def q_apply_upsert_all(spark, sf):
    """Replay of every order, whatever its status."""
    return _replay_orders(spark, sf, _t(spark, sf, "orders"))


# ---------------------------------------------------------------- S08 / S09 / W07 script sink

def _order_script(spark, sf):
    from ..sources import sinks
    o = _t(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(15,2)"))
    rendered = X.render_insert(o, "ORDERS_COPY", ORDER_COLS, keep=["o_orderkey"])
    numbered = X.global_row_number(rendered, ["o_orderkey"])
    return sinks.script_lines(numbered, COMMIT_EVERY)


_RENDER_SQL = """'INSERT INTO ORDERS_COPY (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) VALUES ('
  || coalesce(CAST(o_orderkey AS VARCHAR), 'NULL') || ', ' || coalesce(CAST(o_custkey AS VARCHAR), 'NULL') || ', '
  || coalesce('''' || replace(o_orderstatus, '''', '''''') || '''', 'NULL') || ', '
  || coalesce(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), 'NULL') || ', '
  || coalesce('''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '''', 'NULL') || ', '
  || coalesce('''' || replace(o_orderpriority, '''', '''''') || '''', 'NULL') || ');'"""


@register("part_bytes", f"""
WITH n AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS row_no, {_RENDER_SQL} AS line FROM orders),
lines AS (SELECT row_no, 0 AS sub, line FROM n
          UNION ALL SELECT row_no, 1, 'COMMIT;' FROM n WHERE row_no % {COMMIT_EVERY} = 0
          UNION ALL SELECT max(row_no), 2, 'COMMIT;' FROM n HAVING count(*) > 0)
SELECT CAST(row_no AS BIGINT) AS row_no, sub, line,
       CAST(sum(strlen(line) + 1) OVER (ORDER BY row_no, sub ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_bytes
FROM lines""")
def q_part_bytes(spark, sf):
    """Running byte count of the rendered script (commit lines included)."""
    from ..sources import sinks
    return sinks.running_bytes(_order_script(spark, sf))


PART_BYTES = 16 * 1024


@register("script_parts", f"""
WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS row_no, {_RENDER_SQL} AS line FROM orders),
lines AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY row_no, sub) AS ln, strlen(line) + 1 AS b, sum(strlen(line) + 1) OVER (ORDER BY row_no, sub) AS cum FROM (
    SELECT row_no, 0 AS sub, line FROM n UNION ALL SELECT row_no, 1, 'COMMIT;' FROM n WHERE row_no % {COMMIT_EVERY} = 0
    UNION ALL SELECT max(row_no), 2, 'COMMIT;' FROM n HAVING count(*) > 0)),
head AS (SELECT {len("SET SQL DIALECT 3;") + len("SET NAMES UTF8;") + 3} AS hb),
cut AS MATERIALIZED (  -- of each line the first that no longer fits into a part it begins
  SELECT l.ln, greatest(coalesce(m.ln, 1 + (SELECT max(ln) FROM lines)), l.ln + 1) AS nxt
  FROM lines l ASOF LEFT JOIN lines m ON l.cum - l.b + {PART_BYTES} - (SELECT hb FROM head) < m.cum),
parts AS (SELECT CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS ln FROM lines WHERE ln = 1
          UNION ALL SELECT p.part_no + 1, c.nxt FROM parts p JOIN cut c ON c.ln = p.ln WHERE c.nxt <= (SELECT max(ln) FROM lines)),
spans AS (SELECT part_no, ln AS a, coalesce(lead(ln) OVER (ORDER BY part_no), 1 + (SELECT max(ln) FROM lines)) AS z FROM parts)
SELECT CAST(part_no AS INT) AS part_no, count(*) + 3 AS n_lines, CAST(sum(b) + (SELECT hb FROM head) AS BIGINT) AS bytes
FROM spans JOIN lines ON ln >= a AND ln < z GROUP BY part_no""")
def q_script_parts(spark, sf):
    """Greedy parts with the header repeated; per part lines and bytes."""
    from ..sources import sinks
    header = sinks.header_lines("UTF8")
    parted = sinks.assign_parts(_order_script(spark, sf), PART_BYTES, header)
    return sinks.part_summary(sinks.with_headers(parted, header))


# ---------------------------------------------------------------- W08 checkpoint rows

CHECKPOINT_EVERY = 50_000  # Fixed value: units between progress checkpoints


MARK_UNITS, MARK_SECONDS = 40, 3_600


@register("progress_marks", f"""
WITH RECURSIVE n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts, event_id) AS row_no, event_id, ts FROM events),
s AS MATERIALIZED (SELECT 0 AS ln, min(ts) AS ts FROM n HAVING count(*) > 0 UNION ALL SELECT row_no, ts FROM n),
first_late AS (SELECT a.ln, min(b.ln) AS late FROM s a ASOF LEFT JOIN (SELECT ts, min(ln) AS ln FROM s WHERE ln > 0 GROUP BY ts) b
               ON a.ts + INTERVAL {MARK_SECONDS} SECOND <= b.ts GROUP BY a.ln),
nxt AS MATERIALIZED (SELECT ln, least(ln + {MARK_UNITS}, greatest(coalesce(late, ln + {MARK_UNITS}), ln + 1)) AS nx FROM first_late),
marks AS (SELECT CAST(0 AS BIGINT) AS ln FROM s WHERE ln = 0 UNION ALL SELECT x.nx FROM marks m JOIN nxt x ON x.ln = m.ln WHERE x.nx <= (SELECT max(row_no) FROM n))
SELECT CAST(m.ln AS BIGINT) AS row_no, n.event_id FROM marks m JOIN n ON n.row_no = m.ln""")
def q_progress_marks(spark, sf):
    """W08 whole: units or seconds, whichever comes first."""
    numbered = X.global_row_number(_t(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"])
    return X.progress_marks(numbered, "ts", MARK_UNITS, MARK_SECONDS).join(numbered.select("row_no", "event_id"), "row_no")


@register("checkpoint_rows", f"""
WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY {", ".join(LINE_ORDER)}) AS row_no FROM lineitem)
SELECT CAST(row_no AS BIGINT) AS row_no, l_orderkey, l_linenumber FROM n WHERE row_no % {CHECKPOINT_EVERY} = 0""")
def q_checkpoint_rows(spark, sf):
    """W08 (batch): the rows at which a progress checkpoint is taken (every
    50,000 units); the 30-second variant is the throughput stream."""
    numbered = X.global_row_number(_t(spark, sf, "lineitem"), LINE_ORDER)
    return numbered.where(F.col("row_no") % CHECKPOINT_EVERY == 0).select("row_no", "l_orderkey", "l_linenumber")
