"""Moving tables: scan, render rows as SQL statements, batch, replay.

Rendering is one Catalyst expression per column chosen from the Spark
type, so the whole export stays inside whole-stage codegen.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import render as R

# Tokens a user filter may not contain.
FORBIDDEN_TOKENS = (";", "--", "/*", "*/")


class TransferError(ValueError):
    pass


# ---- S01 / S02 / P02: scans -------------------------------------------------------

_FILTER = re.compile(r"(?:WHERE(?:\s+|\Z))?(?P<predicate>.*)", re.IGNORECASE | re.DOTALL)


def normalize_filter(text: str | None) -> str | None:
    """The predicate of a user filter without its optional ``WHERE``, None
    for a blank filter. One that says nothing or holds a forbidden token is refused."""
    given = (text or "").strip()
    if not given:
        return None
    predicate = _FILTER.fullmatch(given)["predicate"]
    if not predicate:
        raise TransferError("The filter has no condition.")
    refused = [t for t in FORBIDDEN_TOKENS if t in predicate]
    if refused:
        raise TransferError(f"The filter holds {refused[0]}, which is not allowed.")
    return predicate


_SELECT = re.compile(r"\s*(?P<query>SELECT\b.*?)\s*(?:;\s*)?", re.IGNORECASE | re.DOTALL)


def normalize_select(sql: str) -> str:
    """The query of a text that is one SELECT, without blanks around it
    and a last semicolon. A word that only begins with SELECT is none."""
    whole = _SELECT.fullmatch(sql)
    if whole is None:
        raise TransferError("A custom query has to begin with the word SELECT.")
    return whole["query"]


def scan_table(df: DataFrame, columns: list[str], where: str | None = None) -> DataFrame:
    """Explicit column list + optional predicate; Catalyst pushes both
    into the parquet scan (ReadSchema / PushedFilters)."""
    if not columns:
        raise TransferError("Nothing to export: the list of columns is empty.")
    out = df.select(*[F.col(c.strip()) for c in columns])
    pred = normalize_filter(where)
    if pred is not None:
        # filter before the projection is irrelevant to Catalyst; the
        # predicate may name columns outside the export list
        out = df.where(F.expr(pred)).select(*[F.col(c.strip()) for c in columns])
    return out


def scan_query(spark: SparkSession, sql: str, where: str | None = None) -> DataFrame:
    """Custom SELECT over registered views; cannot be combined with a filter."""
    if where and where.strip():
        raise TransferError("A custom query cannot be combined with a filter.")
    return spark.sql(normalize_select(sql))


# ---- F01-F06: literal rendering ---------------------------------------------------

def sanitize_text(c: Column) -> Column:
    """keep CR, LF, TAB and U+0020-U+00FF."""
    return F.regexp_replace(c, r"[^\r\n\t\x{20}-\x{FF}]", "")


def escape_newlines(c: Column) -> Column:
    """CR -> backslash r, LF -> backslash n (two characters each)."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def blob_literal(c: Column, fmt: str = "hex") -> Column:
    """``x'HEX'`` (upper case) or ``'base64'``."""
    if fmt == "hex":
        return F.concat(F.lit("x'"), F.upper(F.hex(c)), F.lit("'"))
    if fmt == "base64":
        # Spark may chunk base64 with CRLF every 76 chars; the literal is one line
        return F.concat(F.lit("'"), F.regexp_replace(F.base64(c), "[\r\n]", ""), F.lit("'"))
    return F.lit("NULL")


def literal(c: Column, dtype: T.DataType, blob_format: str = "hex", sanitize: bool = False,
            escape: bool = False) -> Column:
    """One value as an SQL literal by type; NULL renders as NULL."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        v = c.cast("string")
    elif isinstance(dtype, T.DateType):
        v = F.concat(F.lit("'"), F.date_format(c, "yyyy-MM-dd"), F.lit("'"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        v = F.concat(F.lit("'"), F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("'"))
    elif isinstance(dtype, T.BinaryType):
        v = blob_literal(c, blob_format)
    else:
        t = c.cast("string")
        if sanitize:
            t = sanitize_text(t)
        if escape:
            t = escape_newlines(t)
        v = R.quote_text(t)
    return F.coalesce(v, F.lit("NULL"))


def render_insert(df: DataFrame, target: str, columns: list[str] | None = None, mode: str = "insert",
                  matching: list[str] | None = None, blob_format: str = "hex", sanitize: bool = False,
                  escape_newlines_: bool = False, keep: list[str] | None = None) -> DataFrame:
    """one ``INSERT INTO`` (or ``UPDATE OR INSERT ... MATCHING``)
    statement per row in column ``sql``; ``keep`` columns ride along for
    ordering and batching."""
    cols = columns or df.columns
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    head = ("UPDATE OR INSERT INTO " if mode == "upsert" else "INSERT INTO ") + target + \
        " (" + ", ".join(cols) + ") VALUES ("
    vals = [literal(F.col(c), types[c], blob_format, sanitize, escape_newlines_) for c in cols]
    parts = [F.lit(head), F.concat_ws(", ", *vals), F.lit(")")]
    if mode == "upsert":
        if not matching:
            raise TransferError("An upsert has to name the columns that it matches by.")
        parts.append(F.lit(" MATCHING (" + ", ".join(matching) + ")"))
    parts.append(F.lit(";"))
    return df.select(*(keep or []), F.concat(*parts).alias("sql"))


def upsert_missing_pk(pk_columns: list[str], projected: list[str]) -> list[str]:
    """P10 for one table: PK columns absent from the projection."""
    have = {c.strip().upper() for c in projected}
    return [c for c in pk_columns if c.strip().upper() not in have]


# ---- S10: commit batches -------------------------------------------------------------

def global_row_number(df: DataFrame, order_cols: list) -> DataFrame:
    """1-based consecutive row number in ``order_cols`` order without a
    single-partition window: range-sort, then per-partition offsets from a
    tiny per-partition count table (one row per partition, broadcast).
    The sorted input is checkpointed so ids and counts see the same rows
    even if a task is recomputed."""
    sorted_df = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    sorted_df = sorted_df.checkpoint(eager=True)
    with_pid = (sorted_df.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
                         .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = with_pid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (with_pid.join(F.broadcast(offsets), "_pid")
                    .withColumn("row_no", F.col("_off") + F.col("_local") + 1)
                    .drop("_pid", "_local", "_off", "_mid"))


def commit_batches(numbered: DataFrame, every: int) -> DataFrame:
    """batch_id = (row_no - 1) div every; one COMMIT after each full batch
    and one at the end (so commits = n div every + 1 when n > 0)."""
    return numbered.withColumn("batch_id", F.floor((F.col("row_no") - 1) / F.lit(every)).cast("bigint"))


# ---- W08: progress checkpoints -------------------------------------------------------

CHECKPOINT_UNITS = 50_000  # Fixed values: units or seconds since the last checkpoint, whichever comes first
CHECKPOINT_SECONDS = 30
CHUNK_MARKS = 8


def _next_mark(ln: np.ndarray, us: np.ndarray, units: int, span: int) -> np.ndarray:
    """Of each row the place of the row that takes the next checkpoint after it."""
    own = np.arange(len(ln))
    return np.minimum(own + units, np.maximum(np.searchsorted(us, us + span, side="left"), own + 1))


def _leaving(units: int, span: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ln")
        ln, us, own = (pdf[c].to_numpy() for c in ("ln", "us", "own"))
        mine = int(own.sum())
        to = np.append(np.minimum(_next_mark(ln, us, units, span), len(ln)), len(ln))
        to[mine:] = np.arange(mine, len(to))
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        entry = np.flatnonzero(own & (np.arange(len(ln)) < units))
        return pd.DataFrame({"ln": ln[entry], "exit": ln[0] + to[entry]})
    return run


def _listed_marks(units: int, span: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ln")
        ln, us, own = (pdf[c].to_numpy() for c in ("ln", "us", "own"))
        to, at, out = _next_mark(ln, us, units, span), int(pdf["begin"].iloc[0] - ln[0]), []
        while at < int(own.sum()):
            out.append(ln[at])
            at = int(to[at])
        return pd.DataFrame({"ln": np.array(out, dtype=np.int64)})
    return run


def progress_marks(numbered: DataFrame, time_col: str, units: int = CHECKPOINT_UNITS, seconds: int = CHECKPOINT_SECONDS) -> DataFrame:
    """The ``row_no`` of the units at which a progress checkpoint is taken:
    ``units`` units or ``seconds`` after the last one, whichever comes first (at
    the start: after the first unit's time).

    ``numbered``: row_no from 1 in time order. Each checkpoint hangs on the one
    before it; as for script parts, chunks of rows give the jump from each row a
    chain could enter with to the row it leaves with, and the jumps double.
    """
    span, width = seconds * 1_000_000, CHUNK_MARKS * units
    at = F.unix_micros(F.col(time_col).cast("timestamp")).alias("us")
    rows = numbered.select(F.col("row_no").cast("bigint").alias("ln"), at)
    # the run's start is a row 0 at the time of the first unit
    start = rows.where("ln = 1").select(F.lit(0).cast("bigint").alias("ln"), "us")
    home = F.floor(F.col("ln") / width).cast("bigint")
    # a chunk sees the next one as far as one step reaches
    ahead = F.when((F.col("ln") % width <= units) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    spread = (rows.unionByName(start).select("ln", "us", home.alias("home"), F.explode(ahead).alias("chunk"))
              .select("ln", "us", "chunk", (F.col("home") == F.col("chunk")).alias("own")).checkpoint(eager=True))
    jump = spread.groupBy("chunk").applyInPandas(_leaving(units, span), "ln bigint, exit bigint").checkpoint(eager=True)
    reached = spread.where("ln = 0 and own").select("ln").checkpoint(eager=True)
    held = spread.where("own").select("ln")
    while True:
        more = (reached.join(jump, "ln").select(F.col("exit").alias("ln")).join(held, "ln", "left_semi")
                .join(reached, "ln", "left_anti").distinct().checkpoint(eager=True))
        if more.isEmpty():
            break
        reached = reached.unionByName(more).checkpoint(eager=True)
        jump = (jump.withColumnRenamed("exit", "mid").join(jump.select(F.col("ln").alias("mid"), "exit"), "mid")
                .select("ln", "exit").checkpoint(eager=True))
    begin = reached.groupBy(F.floor(F.col("ln") / width).cast("bigint").alias("chunk")).agg(F.min("ln").alias("begin"))
    marks = spread.join(begin, "chunk").groupBy("chunk").applyInPandas(_listed_marks(units, span), "ln bigint")
    return marks.where("ln > 0").select(F.col("ln").alias("row_no"))


# ---- S14 / S15 / U03 --------------------------------------------------------------

def apply_upsert(target: DataFrame, changes: DataFrame, pk: list[str], order_col: str) -> DataFrame:
    """Last statement per key wins (``max_by`` partial aggregation, so a
    hot key is combined map-side), then replace matching target rows."""
    value_cols = [c for c in target.columns]
    latest = (changes.groupBy(*pk)
                     .agg(F.max_by(F.struct(*[F.col(c) for c in value_cols if c not in pk]), F.col(order_col)).alias("_v"))
                     .select(*pk, "_v.*"))
    return target.join(latest.select(*pk), pk, "left_anti").unionByName(latest.select(*value_cols))


def roundtrip_diff(original: DataFrame, reimported: DataFrame) -> DataFrame:
    """Rows present on one side only (multiset); empty when equal."""
    a = original.exceptAll(reimported).withColumn("side", F.lit("original_only"))
    b = reimported.exceptAll(original).withColumn("side", F.lit("reimported_only"))
    return a.unionByName(b)


def writable_columns(cat) -> DataFrame:
    """Columns without a computed source, in field-position order."""
    return (cat.columns.where(R.blank(F.col("computed_sql")))
                       .select("db_id", "table_name", "ordinal", "column_name"))
