"""Scored findings and their per-database summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ddl import scope_table
from ..functions.scoring import CODE_ALIASES, priority, risk_score, severity_weight
from .catalog import Catalog
from .rules import all_rule_findings, visible_tables
from .transfer import global_row_number

SCORED_COLS = ["db_id", "severity", "score", "priority", "code", "scope"]

KNOWN_CODES = sorted(set(CODE_ALIASES.values()))


def apply_overrides(findings: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Replace the default severity for codes named in ``overrides``
    (columns ``code, severity``, already normalised, and ``position``: of
    several for one code the last wins). At most one row for each of the
    fixed codes is broadcast."""
    if overrides is None:
        return findings
    if "position" not in overrides.columns:
        overrides = overrides.withColumn("position", F.monotonically_increasing_id())
    last = overrides.groupBy("code").agg(F.max_by("severity", "position").alias("_override")).where(F.col("code").isin(KNOWN_CODES))
    return (findings.join(F.broadcast(last), "code", "left")
                    .withColumn("severity", F.coalesce("_override", "severity")).drop("_override"))


def score_findings(findings: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    f = apply_overrides(findings, overrides)
    score = risk_score(F.col("severity"), F.col("code"))
    return f.withColumn("score", score).withColumn("priority", priority(F.col("score"))).select(*SCORED_COLS)


def analyze(cat: Catalog, prefixes=(), overrides: DataFrame | None = None) -> DataFrame:
    """All rules, scored. Ordering (W05) is left to ``order_findings``."""
    return score_findings(all_rule_findings(cat, prefixes), overrides)


def order_findings(scored: DataFrame) -> DataFrame:
    """Score desc, severity weight desc, code, scope (case-insensitive)."""
    return scored.orderBy("db_id", F.desc("score"), F.desc(severity_weight(F.col("severity"))),
                          F.upper("code"), F.upper("scope"))


def ranked_findings(scored: DataFrame) -> DataFrame:
    """W05 with the place of each finding in its database's list (``rank`` from
    1; equal findings in any order). The rank comes from one range sort of all
    findings, not from a window over a database."""
    keys = ["db_id", F.desc("score"), F.desc(severity_weight(F.col("severity"))), F.upper("code"), F.upper("scope"), "code", "scope"]
    numbered = global_row_number(scored, keys)
    first = numbered.groupBy("db_id").agg(F.min("row_no").alias("_first"))
    return numbered.join(first, "db_id").select("db_id", (F.col("row_no") - F.col("_first") + 1).alias("rank"), *[c for c in SCORED_COLS if c != "db_id"])


def severity_totals(scored: DataFrame) -> DataFrame:
    """Total and per-severity counts per database."""
    return scored.groupBy("db_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity") == "medium").alias("medium"),
        F.count_if(F.col("severity") == "low").alias("low"))


def _percent(n, total):
    """round(n*100/total, 2) half-to-even on exact decimals."""
    return F.bround(n.cast("decimal(20,0)") * F.lit(100) / total.cast("decimal(20,0)"), 2)


def summary_by(scored: DataFrame, key_expr, key_name: str = "key") -> DataFrame:
    """Count and percent of the database's findings per key.
    Partial counts per (db, key) are combined map-side; the total is a
    second tiny aggregate joined back, not a window over raw findings."""
    per_key = scored.groupBy("db_id", F.upper(key_expr).alias("_k")).agg(
        F.count(F.lit(1)).alias("n"), F.min(key_expr).alias(key_name))
    totals = per_key.groupBy("db_id").agg(F.sum("n").alias("_total"))
    return (per_key.join(totals, "db_id")
                   .select("db_id", key_name, "n", _percent(F.col("n"), F.col("_total")).cast("double").alias("percent"),
                           _percent(F.col("n"), F.col("_total")).alias("_pct")))


def summary_by_code(scored: DataFrame) -> DataFrame:
    return summary_by(scored, F.col("code"), "code").drop("_pct")


def summary_by_table(scored: DataFrame) -> DataFrame:
    return summary_by(scored, scope_table(F.col("scope")), "table_name").drop("_pct")


def risk_by_table(scored: DataFrame) -> DataFrame:
    """min(100, round(0.5*max + 0.4*avg + min(10, n))) half-to-even."""
    g = scored.groupBy("db_id", F.upper(scope_table(F.col("scope"))).alias("_k")).agg(
        F.min(scope_table(F.col("scope"))).alias("table_name"),
        F.count(F.lit(1)).alias("n"),
        F.max("score").alias("max_score"),
        F.avg("score").alias("avg_score"))
    # double arithmetic in this order, then half-to-even, as specified
    raw = F.col("max_score") * F.lit(0.5) + F.col("avg_score") * F.lit(0.4) + F.least(F.lit(10), F.col("n"))
    idx = F.least(F.lit(100), F.bround(raw, 0).cast("bigint"))
    return g.select("db_id", "table_name", "n", idx.alias("risk_index"), priority(idx).alias("priority"))


def top5_with_others(scored: DataFrame) -> DataFrame:
    """First five codes (count desc, code) and one OTHERS row."""
    s = summary_by(scored, F.col("code"), "code")
    w = Window.partitionBy("db_id").orderBy(F.desc("n"), F.upper("code"))
    ranked = s.withColumn("rn", F.row_number().over(w))
    bucket = F.when(F.col("rn") <= 5, F.col("code")).otherwise(F.lit("OTHERS"))
    return (ranked.groupBy("db_id", bucket.alias("code"))
                  .agg(F.sum("n").alias("n"), F.sum("_pct").cast("double").alias("percent"),
                       F.min("rn").cast("bigint").alias("rank")))


def object_counts(cat: Catalog, prefixes=()) -> DataFrame:
    """Tables, indexes, PKs, FKs of visible tables; routines of all."""
    vis = visible_tables(cat, prefixes).select("db_id", "table_name")
    keys = ["db_id", "table_name"]

    def per_db(df, name, semi=True):
        d = df.join(vis, keys, "left_semi") if semi else df
        return d.groupBy("db_id").agg(F.count(F.lit(1)).alias(name))

    r = cat.routines.groupBy("db_id").agg(
        F.count_if(F.col("kind") == "TRIGGER").alias("triggers"),
        F.count_if(F.col("kind") == "PROCEDURE").alias("procedures"),
        F.count_if(F.col("kind") == "FUNCTION").alias("functions"))
    dbs = cat.databases.select("db_id")
    out = dbs
    for df, name in ((vis, "tables"), (cat.indexes, "indexes"), (cat.pks, "pks"), (cat.fks, "fks")):
        out = out.join(per_db(df, name), "db_id", "left")
    out = out.join(r, "db_id", "left")
    cols = ["tables", "indexes", "pks", "fks", "triggers", "procedures", "functions"]
    return out.fillna(0, cols).select("db_id", *[F.col(c).cast("bigint") for c in cols])


def filter_findings(scored: DataFrame, severity: str | None = None, code: str | None = None,
                    text: str | None = None) -> DataFrame:
    """Severity equals AND code equals AND text contained (lower-case)
    in scope, code, description or recommendation."""
    out = scored
    if severity:
        out = out.where(F.col("severity") == severity)
    if code:
        out = out.where(F.col("code") == code)
    if text:
        hay = F.lower(F.concat_ws(" ", *[F.col(c) for c in ("scope", "code", "description", "recommendation")
                                        if c in scored.columns]))
        out = out.where(hay.contains(text.lower()))
    return out
