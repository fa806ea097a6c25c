"""Fleet summaries over many databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .findings import severity_totals, summary_by_code
from .catalog import Catalog
from .rules import visible_tables

SEVERITY_ORDER = ["critical", "high", "medium", "low"]


def top_codes(scored: DataFrame, k: int = 3) -> DataFrame:
    """Top ``k`` codes per database rendered ``CODE (n)``, in order.
    The collected list is bounded by ``k``, never by the data."""
    per = summary_by_code(scored)
    w = Window.partitionBy("db_id").orderBy(F.desc("n"), F.upper("code"))
    top = per.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return (top.groupBy("db_id")
               .agg(F.sort_array(F.collect_list(F.struct("rn", F.format_string("%s (%d)", "code", "n").alias("t"))))
                    .alias("_l"))
               .select("db_id", F.array_join("_l.t", ", ").alias("top_codes")))


def fleet_by_database(cat: Catalog, scored: DataFrame, prefixes=()) -> DataFrame:
    """Per database totals, highest severity or ``none``, top 3 codes."""
    tables = visible_tables(cat, prefixes).groupBy("db_id").agg(F.count(F.lit(1)).alias("tables"))
    out = (cat.databases.select("db_id")
              .join(tables, "db_id", "left")
              .join(severity_totals(scored), "db_id", "left")
              .join(top_codes(scored), "db_id", "left")
              .fillna(0, ["tables", "total"] + SEVERITY_ORDER)
              .fillna("", ["top_codes"]))
    highest = F.when(F.col("total") == 0, "none")
    for s in SEVERITY_ORDER[:-1]:
        highest = highest.when(F.col(s) > 0, s)
    return out.withColumn("highest_severity", highest.otherwise("low")).select(
        "db_id", "tables", "total", *SEVERITY_ORDER, "highest_severity", "top_codes")


def fleet_totals(by_db: DataFrame) -> DataFrame:
    """One row over the whole fleet."""
    return by_db.agg(
        F.count(F.lit(1)).alias("databases"),
        F.count_if(F.col("total") > 0).alias("with_findings"),
        F.count_if(F.col("critical") > 0).alias("with_criticals"),
        *[F.sum(c).cast("bigint").alias(c) for c in ["tables", "total"] + SEVERITY_ORDER])


def fleet_by_code(scored: DataFrame) -> DataFrame:
    """Codes summed over databases, percent of all findings."""
    per = scored.groupBy(F.upper("code").alias("_k")).agg(F.min("code").alias("code"),
                                                          F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("_t")).withColumn("_one", F.lit(1))
    pct = F.when(F.col("_t") == 0, F.lit(0).cast("decimal(20,2)")).otherwise(
        F.bround(F.col("n").cast("decimal(20,0)") * 100 / F.col("_t").cast("decimal(20,0)"), 2))
    # the grand total is a single-row aggregate: a bounded broadcast side
    return (per.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
               .select("code", "n", pct.cast("double").alias("percent")))
