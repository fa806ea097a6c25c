"""Monitor queries: operational thresholds, oldest active transaction,
analysis status, failure classes, and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as M
from ..sources.fixtures import fixture
from ..sources.tables import read_table
from ..streaming import monitor_stream as ST
from .registry import register


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


GAP_SQL = """
SELECT db_id, sample_id, code, severity, scope, value FROM (
  SELECT db_id, sample_id,
         CASE WHEN oat - oit >= 200000 THEN 'OPERACIONAL_GAP_OIT_OAT_ELEVADO'
              WHEN oat - oit >= 50000 THEN 'OPERACIONAL_GAP_OIT_OAT_ACIMA_DO_ESPERADO'
              WHEN oat - oit >= 10000 THEN 'OPERACIONAL_GAP_OIT_OAT_MODERADO' END AS code,
         CASE WHEN oat - oit >= 200000 THEN 'critical' WHEN oat - oit >= 50000 THEN 'high'
              WHEN oat - oit >= 10000 THEN 'medium' END AS severity,
         'OPERACIONAL.TRANSACTIONS' AS scope, CAST(oat - oit AS BIGINT) AS value FROM {src}
  UNION ALL
  SELECT db_id, sample_id,
         CASE WHEN ost - oat >= 200000 THEN 'OPERACIONAL_GAP_OAT_OST_ELEVADO'
              WHEN ost - oat >= 50000 THEN 'OPERACIONAL_GAP_OAT_OST_ACIMA_DO_ESPERADO' END,
         CASE WHEN ost - oat >= 200000 THEN 'high' WHEN ost - oat >= 50000 THEN 'medium' END,
         'OPERACIONAL.SNAPSHOTS', CAST(ost - oat AS BIGINT) FROM {src}
) g WHERE code IS NOT NULL"""

register("rule_operational_gaps", GAP_SQL.format(src="fx_monitor"))(
    lambda spark, sf: M.gap_findings(_fx(spark, sf, "fx_monitor"), ["db_id", "sample_id"]))

OLDEST_SQL = """
last_ts AS (SELECT db_id, max(ts) AS as_of FROM fx_monitor GROUP BY db_id),
oldest AS (
  SELECT m.db_id, min(m.ts) AS oldest_active, max(a.as_of) AS as_of FROM fx_monitor m JOIN last_ts a USING (db_id)
  WHERE m.tx_state = 1 AND m.attachment_id <> m.db_id AND m.ts <= a.as_of
  GROUP BY m.db_id)
"""


def _oldest(spark, sf):
    s = _fx(spark, sf, "fx_monitor")
    as_of = s.groupBy("db_id").agg(F.max("ts").alias("as_of"))
    # the monitoring connection of database d is attachment d in the fixture
    own = s.select("db_id").distinct().withColumn("own_attachment_id", F.col("db_id"))
    return M.oldest_active(s, own, as_of)


register("oldest_active", f"WITH {OLDEST_SQL} SELECT db_id, oldest_active, as_of FROM oldest")(_oldest)

register("rule_operational_age", f"""WITH {OLDEST_SQL},
aged AS (SELECT db_id, (epoch_us(as_of) - epoch_us(oldest_active)) / 6e7 AS age_minutes FROM oldest)
SELECT db_id,
  CASE WHEN age_minutes >= 720 THEN 'OPERACIONAL_TRANSACAO_ATIVA_LONGA_CRITICA'
       WHEN age_minutes >= 120 THEN 'OPERACIONAL_TRANSACAO_ATIVA_LONGA'
       WHEN age_minutes >= 30 THEN 'OPERACIONAL_TRANSACAO_ATIVA_ACIMA_DO_ESPERADO' END AS code,
  CASE WHEN age_minutes >= 720 THEN 'critical' WHEN age_minutes >= 120 THEN 'high'
       WHEN age_minutes >= 30 THEN 'medium' END AS severity,
  'OPERACIONAL.TRANSACTIONS' AS scope, age_minutes
FROM aged WHERE age_minutes >= 30""")(lambda spark, sf: M.age_findings(_oldest(spark, sf)))

CLASSIFY_SQL = """
SELECT event_id, ts, db_id, message,
  (contains(lower(message), 'deadlock') OR contains(lower(message), 'lock conflict')
   OR contains(lower(message), 'update conflicts with concurrent update') OR contains(lower(message), 'connection lost')
   OR contains(lower(message), 'read error') OR contains(lower(message), 'write error')
   OR contains(lower(message), 'timeout')) AS transient_execution,
  (contains(lower(message), 'being used by another process') OR contains(lower(message), 'used by another process')
   OR contains(lower(message), 'process cannot access the file') OR contains(lower(message), 'temporarily unavailable')
   OR contains(lower(message), 'resource temporarily unavailable')) AS transient_write,
  CASE WHEN contains(lower(message), 'unsupported on-disk structure') THEN 'incompatible_ods'
       WHEN contains(lower(message), 'no permission for read-write access to database') OR contains(lower(message), 'access denied')
            OR contains(lower(message), 'not owner of database') THEN 'permission_denied'
       WHEN contains(lower(message), 'i/o error for file') OR contains(lower(message), 'error while trying to open file')
            OR contains(lower(message), 'operating system directive open failed') OR contains(lower(message), 'cannot open file')
            THEN 'database_file_access'
       WHEN contains(lower(message), 'token unknown') OR contains(lower(message), 'dynamic sql error')
            OR contains(lower(message), 'column unknown') OR contains(lower(message), 'table unknown') THEN 'metadata_query_failure'
       WHEN contains(lower(message), 'unable to complete network request') OR contains(lower(message), 'connection rejected')
            OR contains(lower(message), 'connection shutdown') THEN 'connection_failure'
       ELSE 'unknown' END AS extraction_cause,
  CASE WHEN contains(lower(message), 'timeout') THEN 'timeout'
       WHEN contains(lower(message), 'permission') OR contains(lower(message), 'not permitted')
            OR contains(lower(message), 'access denied') OR contains(lower(message), 'sql error code = -551') THEN 'permission_denied'
       WHEN contains(lower(message), 'mon$') AND (contains(lower(message), 'column unknown')
            OR contains(lower(message), 'token unknown') OR contains(lower(message), 'sql error code = -206'))
            THEN 'metadata_incompatible'
       ELSE 'query_failure' END AS monitor_failure
FROM fx_log"""

register("classify_errors", CLASSIFY_SQL)(lambda spark, sf: M.classify_errors(_fx(spark, sf, "fx_log")))

register("error_class_counts", f"""
SELECT db_id, extraction_cause, monitor_failure, count(*) AS n, count(*) FILTER (WHERE transient_execution) AS transient
FROM ({CLASSIFY_SQL}) c GROUP BY ALL""")(
    lambda spark, sf: M.classify_errors(_fx(spark, sf, "fx_log")).groupBy("db_id", "extraction_cause", "monitor_failure")
    .agg(F.count(F.lit(1)).alias("n"), F.count_if("transient_execution").alias("transient")))

ATTEMPTS_SQL = f"""
WITH c AS ({CLASSIFY_SQL}),
att AS (SELECT db_id, ts, 'executed' AS status, CAST(NULL AS VARCHAR) AS reason, 0 AS pri FROM fx_monitor
        UNION ALL
        SELECT db_id, ts, CASE WHEN monitor_failure IN ('permission_denied', 'metadata_incompatible') THEN 'unavailable'
                               ELSE 'failed' END, monitor_failure, 1 FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY ts DESC, pri DESC) AS rn,
             count(*) OVER (PARTITION BY db_id) AS attempts FROM att)
SELECT db_id, status, reason, attempts FROM r WHERE rn = 1"""

register("analysis_status", ATTEMPTS_SQL)(
    lambda spark, sf: M.analysis_status(_fx(spark, sf, "fx_monitor"), _fx(spark, sf, "fx_log")))

register("fleet_analysis_status", f"""
SELECT d.db_id, CASE WHEN d.db_id % 4 = 3 THEN 'not_applicable' ELSE coalesce(a.status, 'pending') END AS status,
       CASE WHEN d.db_id % 4 <> 3 THEN a.reason END AS reason, coalesce(a.attempts, 0) AS attempts
FROM fx_database d LEFT JOIN ({ATTEMPTS_SQL}) a ON a.db_id = d.db_id""")(
    lambda spark, sf: M.fleet_analysis_status(_fx(spark, sf, "fx_database").withColumn("live", F.col("db_id") % 4 != 3),
                                              _fx(spark, sf, "fx_monitor"), _fx(spark, sf, "fx_log")))


@register("ods_details", r"""
SELECT event_id,
  nullif(trim(regexp_extract(message, '(?i)for file\s+([^;|]+)', 1)), '') AS ods_file,
  nullif(trim(regexp_extract(message, '(?i)found\s+(\d+(\.\d+)?)', 1)), '') AS found_version,
  nullif(trim(regexp_extract(message, '(?i)support\s+(\d+(\.\d+)?)', 1)), '') AS supported_version
FROM fx_log WHERE contains(lower(message), 'unsupported on-disk structure')""")
def q_ods_details(spark, sf):
    log = _fx(spark, sf, "fx_log").where(F.lower("message").contains("unsupported on-disk structure"))
    f, found, sup = M.ods_details(F.col("message"))
    return log.select("event_id", f.alias("ods_file"), found.alias("found_version"), sup.alias("supported_version"))


@register("command_preview", r"""
SELECT doc_id, CASE WHEN length(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) <= 180
                    THEN trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))
                    ELSE substr(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')), 1, 180) || '...' END AS preview
FROM documents""")
def q_command_preview(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", M.command_preview(F.col("text")).alias("preview"))


# ---------------------------------------------------------------- stream twins

WINDOW_SQL = """
lw AS (SELECT db_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, arg_max(sample_id, ts) AS sample_id,
              arg_max(oit, ts) AS oit, arg_max(oat, ts) AS oat, arg_max(ost, ts) AS ost
       FROM fx_monitor GROUP BY db_id, time_bucket(INTERVAL 1 DAY, ts))
"""

register("stream_operational_findings", f"""WITH {WINDOW_SQL}
SELECT db_id, window_start, sample_id, code, severity, scope, value FROM (
  SELECT db_id, window_start, sample_id,
         CASE WHEN oat - oit >= 200000 THEN 'OPERACIONAL_GAP_OIT_OAT_ELEVADO'
              WHEN oat - oit >= 50000 THEN 'OPERACIONAL_GAP_OIT_OAT_ACIMA_DO_ESPERADO'
              WHEN oat - oit >= 10000 THEN 'OPERACIONAL_GAP_OIT_OAT_MODERADO' END AS code,
         CASE WHEN oat - oit >= 200000 THEN 'critical' WHEN oat - oit >= 50000 THEN 'high'
              WHEN oat - oit >= 10000 THEN 'medium' END AS severity,
         'OPERACIONAL.TRANSACTIONS' AS scope, CAST(oat - oit AS BIGINT) AS value FROM lw
  UNION ALL
  SELECT db_id, window_start, sample_id,
         CASE WHEN ost - oat >= 200000 THEN 'OPERACIONAL_GAP_OAT_OST_ELEVADO'
              WHEN ost - oat >= 50000 THEN 'OPERACIONAL_GAP_OAT_OST_ACIMA_DO_ESPERADO' END,
         CASE WHEN ost - oat >= 200000 THEN 'high' WHEN ost - oat >= 50000 THEN 'medium' END,
         'OPERACIONAL.SNAPSHOTS', CAST(ost - oat AS BIGINT) FROM lw
) g WHERE code IS NOT NULL""")(
    lambda spark, sf: ST.operational_window_findings(ST.operational_windows(_fx(spark, sf, "fx_monitor"))))

register("stream_throughput", """
SELECT time_bucket(INTERVAL 30 SECOND, ts) AS window_start, count(*) AS units, count(*) / 30.0 AS rate
FROM events GROUP BY 1""")(lambda spark, sf: ST.throughput(read_table(spark, sf, "events")))


AGE_WINDOW_SQL = """
WITH ev AS (SELECT db_id, attachment_id, ts, tx_state, lag(tx_state) OVER (PARTITION BY db_id, attachment_id ORDER BY ts, tx_state) AS prev
            FROM fx_monitor WHERE attachment_id <> db_id),
changes AS (SELECT *, lead(ts) OVER (PARTITION BY db_id, attachment_id ORDER BY ts, tx_state) AS closed
            FROM ev WHERE tx_state IS DISTINCT FROM prev),
days AS (SELECT db_id, unnest(generate_series(CAST(date_trunc('day', min(ts)) AS TIMESTAMP), CAST(date_trunc('day', max(ts)) AS TIMESTAMP),
                                              INTERVAL 1 DAY)) AS window_start FROM fx_monitor GROUP BY db_id),
oldest AS (SELECT d.db_id, d.window_start, count(*) AS open_transactions,
                  (epoch_us(d.window_start + INTERVAL 1 DAY) - epoch_us(min(c.ts))) / 6e7 AS age_minutes
           FROM days d JOIN changes c ON c.db_id = d.db_id AND c.ts < d.window_start + INTERVAL 1 DAY
                AND (c.closed IS NULL OR c.closed >= d.window_start + INTERVAL 1 DAY)
           WHERE c.tx_state = 1 GROUP BY d.db_id, d.window_start)
SELECT db_id, window_start, open_transactions,
  CASE WHEN age_minutes >= 720 THEN 'OPERACIONAL_TRANSACAO_ATIVA_LONGA_CRITICA'
       WHEN age_minutes >= 120 THEN 'OPERACIONAL_TRANSACAO_ATIVA_LONGA'
       WHEN age_minutes >= 30 THEN 'OPERACIONAL_TRANSACAO_ATIVA_ACIMA_DO_ESPERADO' END AS code,
  CASE WHEN age_minutes >= 720 THEN 'critical' WHEN age_minutes >= 120 THEN 'high'
       WHEN age_minutes >= 30 THEN 'medium' END AS severity,
  'OPERACIONAL.TRANSACTIONS' AS scope, age_minutes
FROM oldest WHERE age_minutes >= 30"""


@register("stream_age_findings", AGE_WINDOW_SQL)
def q_stream_age_findings(spark, sf):
    """T01 with O06-O08: the batch twin of the stream of open transactions."""
    samples = _fx(spark, sf, "fx_monitor")
    own = samples.select("db_id").distinct().withColumn("own_attachment_id", F.col("db_id"))
    return ST.age_window_findings(ST.open_transactions(samples, own))
