"""Operational monitoring over samples of many databases (O01-O08, A11,
V01) and log classification (F18, F19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gap thresholds (transactions) and active-transaction ages (minutes).
OIT_OAT = ((200_000, "critical", "OPERACIONAL_GAP_OIT_OAT_ELEVADO"),
           (50_000, "high", "OPERACIONAL_GAP_OIT_OAT_ACIMA_DO_ESPERADO"),
           (10_000, "medium", "OPERACIONAL_GAP_OIT_OAT_MODERADO"))
OAT_OST = ((200_000, "high", "OPERACIONAL_GAP_OAT_OST_ELEVADO"),
           (50_000, "medium", "OPERACIONAL_GAP_OAT_OST_ACIMA_DO_ESPERADO"))
ACTIVE_AGE = ((720, "critical", "OPERACIONAL_TRANSACAO_ATIVA_LONGA_CRITICA"),
              (120, "high", "OPERACIONAL_TRANSACAO_ATIVA_LONGA"),
              (30, "medium", "OPERACIONAL_TRANSACAO_ATIVA_ACIMA_DO_ESPERADO"))
SCOPE_TX = "OPERACIONAL.TRANSACTIONS"
SCOPE_SNAP = "OPERACIONAL.SNAPSHOTS"


def _tiered(value: Column, tiers) -> Column:
    """struct(code, severity) of the highest tier reached, NULL below all."""
    expr = None
    for limit, sev, code in tiers:
        hit = value >= limit
        v = F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))
        expr = F.when(hit, v) if expr is None else expr.when(hit, v)
    return expr


def gap_findings(samples: DataFrame, keys: list[str]) -> DataFrame:
    """O01-O05 per sample: OAT-OIT and OST-OAT gaps, highest tier only."""
    a = samples.select(*keys, _tiered(F.col("oat") - F.col("oit"), OIT_OAT).alias("f"),
                       F.lit(SCOPE_TX).alias("scope"), (F.col("oat") - F.col("oit")).alias("value"))
    b = samples.select(*keys, _tiered(F.col("ost") - F.col("oat"), OAT_OST).alias("f"),
                       F.lit(SCOPE_SNAP).alias("scope"), (F.col("ost") - F.col("oat")).alias("value"))
    both = a.unionByName(b).where(F.col("f").isNotNull())
    return both.select(*keys, "f.code", "f.severity", "scope", F.col("value").cast("bigint").alias("value"))


def oldest_active(samples: DataFrame, own: DataFrame, as_of: DataFrame) -> DataFrame:
    """Per database the oldest timestamp of an active transaction
    (state 1) not owned by the monitoring attachment, however long ago it
    began, up to ``as_of``. ``samples`` has one row per transaction, in its
    latest state; ``own`` and ``as_of`` one row per database."""
    s = (samples.where(F.col("tx_state") == 1)
                .join(as_of, "db_id")
                .join(own, "db_id", "left")
                .where(F.col("own_attachment_id").isNull() | (F.col("attachment_id") != F.col("own_attachment_id")))
                .where(F.col("ts") <= F.col("as_of")))
    return s.groupBy("db_id").agg(F.min("ts").alias("oldest_active"), F.max("as_of").alias("as_of"))


def age_findings(oldest: DataFrame, keys: tuple[str, ...] = ("db_id",)) -> DataFrame:
    """O06-O08 from A11: age in minutes at ``as_of``, highest tier only."""
    age = (F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("oldest_active").cast("timestamp"))) / 6e7
    f = oldest.select(*keys, _tiered(age, ACTIVE_AGE).alias("f"), age.alias("age_minutes"))
    return f.where(F.col("f").isNotNull()).select(*keys, "f.code", "f.severity", F.lit(SCOPE_TX).alias("scope"),
                                                 "age_minutes")


def latest_sample(samples: DataFrame) -> DataFrame:
    """The newest counters of each database (ties: the larger sample_id)."""
    newest = F.max_by(F.struct("oit", "oat", "ost", "ts"), F.struct("ts", "sample_id"))
    return samples.groupBy("db_id").agg(newest.alias("s")).select("db_id", "s.oit", "s.oat", "s.ost", F.col("s.ts").alias("as_of"))


def operational_findings(samples: DataFrame, own: DataFrame) -> DataFrame:
    """O01-O08 as an audit sees them: the gaps of the newest sample and the
    age of the oldest active transaction at that moment, per database."""
    newest = latest_sample(samples)
    aged = age_findings(oldest_active(samples, own, newest.select("db_id", "as_of")))
    cols = ["db_id", "code", "severity", "scope"]
    return gap_findings(newest, ["db_id"]).select(*cols).unionByName(aged.select(*cols))


# ---- F18 / F19 -------------------------------------------------------------------------

def _contains_any(msg: Column, needles) -> Column:
    expr = None
    for n in needles:
        e = msg.contains(n)
        expr = e if expr is None else (expr | e)
    return expr


# Message fragments per failure class (lower case).
TRANSIENT_EXECUTION = ("deadlock", "lock conflict", "update conflicts with concurrent update", "connection lost",
                       "read error", "write error", "timeout")
TRANSIENT_WRITE = ("being used by another process", "used by another process", "process cannot access the file",
                   "temporarily unavailable", "resource temporarily unavailable")
EXTRACTION_CAUSES = (
    ("incompatible_ods", ("unsupported on-disk structure",)),
    ("permission_denied", ("no permission for read-write access to database", "access denied", "not owner of database")),
    ("database_file_access", ("i/o error for file", "error while trying to open file",
                              "operating system directive open failed", "cannot open file")),
    ("metadata_query_failure", ("token unknown", "dynamic sql error", "column unknown", "table unknown")),
    ("connection_failure", ("unable to complete network request", "connection rejected", "connection shutdown")),
)


def classify_errors(log: DataFrame, message_col: str = "message") -> DataFrame:
    """four independent classifications, first match wins in each."""
    m = F.lower(F.coalesce(F.col(message_col), F.lit("")))
    cause = None
    for name, needles in EXTRACTION_CAUSES:
        c = _contains_any(m, needles)
        cause = F.when(c, F.lit(name)) if cause is None else cause.when(c, F.lit(name))
    monitor = (F.when(m.contains("timeout"), F.lit("timeout"))
                .when(_contains_any(m, ("permission", "not permitted", "access denied", "sql error code = -551")),
                      F.lit("permission_denied"))
                .when(m.contains("mon$") & _contains_any(m, ("column unknown", "token unknown", "sql error code = -206")),
                      F.lit("metadata_incompatible"))
                .otherwise(F.lit("query_failure")))
    return log.select(
        "*",
        _contains_any(m, TRANSIENT_EXECUTION).alias("transient_execution"),
        _contains_any(m, TRANSIENT_WRITE).alias("transient_write"),
        cause.otherwise(F.lit("unknown")).alias("extraction_cause"),
        monitor.alias("monitor_failure"))


def ods_details(message: Column) -> tuple[Column, Column, Column]:
    """(file, found version, supported version) from an ODS message."""
    def grab(p):
        v = F.trim(F.regexp_extract(message, p, 1))
        return F.when(v == "", F.lit(None)).otherwise(v)
    return (grab(r"(?i)for file\s+([^;|]+)"), grab(r"(?i)found\s+(\d+(\.\d+)?)"),
            grab(r"(?i)support\s+(\d+(\.\d+)?)"))


def command_preview(sql: Column, limit: int = 180) -> Column:
    """whitespace collapsed, cut at ``limit`` characters plus '...'."""
    c = F.trim(F.regexp_replace(sql, r"\s+", " "))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit), F.lit("...")))


def analysis_status(samples: DataFrame, failures: DataFrame) -> DataFrame:
    """Per database the latest collection attempt decides: a sample
    means ``executed``; a failure is ``unavailable`` for permission or
    metadata classes, else ``failed``. ``max_by`` keeps it map-side."""
    ok = samples.select("db_id", "ts", F.lit("executed").alias("status"), F.lit(None).cast("string").alias("reason"))
    cls = classify_errors(failures)
    bad = cls.select("db_id", "ts",
                     F.when(F.col("monitor_failure").isin("permission_denied", "metadata_incompatible"),
                            F.lit("unavailable")).otherwise(F.lit("failed")).alias("status"),
                     F.col("monitor_failure").alias("reason"))
    att = ok.unionByName(bad)
    # ties on ts: a failure outranks a sample taken at the same instant
    rank = F.struct("ts", (F.col("status") != "executed").cast("int"))
    return att.groupBy("db_id").agg(F.max_by(F.struct("status", "reason"), rank).alias("s"),
                                    F.count(F.lit(1)).alias("attempts")) \
              .select("db_id", "s.status", "s.reason", "attempts")


def fleet_analysis_status(databases: DataFrame, samples: DataFrame, failures: DataFrame) -> DataFrame:
    """V01 of every database (``db_id``, ``live``): the status of its latest
    attempt; without one ``pending`` if the database can be reached (``live``)
    and ``not_applicable`` if it is known from a snapshot alone, which also
    holds if attempts are on record from an earlier time. Null counts as not live."""
    known = analysis_status(samples, failures)
    live = F.coalesce("live", F.lit(False))
    j = databases.select("db_id", live.alias("live")).join(known, "db_id", "left")
    return j.select("db_id", F.when(~F.col("live"), "not_applicable").otherwise(F.coalesce("status", F.lit("pending"))).alias("status"),
                    F.when(F.col("live"), F.col("reason")).alias("reason"), F.coalesce("attempts", F.lit(0)).alias("attempts"))
