"""Script and result sinks (S08, S09, S12, S13; W07 running bytes).

A rendered export is a DataFrame of statements with a global row number
(``transfer.global_row_number``). Lines get a sort key ``(row_no, sub)`` so
COMMIT lines slot in after every N statements without renumbering.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADER_DIALECT = "SET SQL DIALECT 3;"
DEFAULT_PART_BYTES = 100 * 1024 * 1024  # Fixed value: default part size


def header_lines(charset: str | None, force_win1252: bool = False) -> list[str]:
    """S08 header: dialect, SET NAMES (WIN1252 when forced without a charset), blank line."""
    cs = charset or ("WIN1252" if force_win1252 else None)
    lines = [HEADER_DIALECT]
    if cs:
        lines.append(f"SET NAMES {cs};")
    lines.append("")
    return lines


def script_lines(numbered: DataFrame, commit_every: int = 0) -> DataFrame:
    """Statements (``row_no``, ``sql``) -> lines (``row_no``, ``sub``, ``line``):
    the statement (sub 0), a COMMIT after every ``commit_every`` rows
    (sub 1) and a final COMMIT after the last row (sub 2) when any row exists."""
    out = numbered.select("row_no", F.lit(0).alias("sub"), F.col("sql").alias("line"))
    if commit_every and commit_every > 0:
        commits = numbered.where(F.col("row_no") % commit_every == 0).select(
            "row_no", F.lit(1).alias("sub"), F.lit("COMMIT;").alias("line"))
        last = numbered.agg(F.max("row_no").alias("row_no")).where(F.col("row_no").isNotNull()).select(
            "row_no", F.lit(2).alias("sub"), F.lit("COMMIT;").alias("line"))
        out = out.unionByName(commits).unionByName(last)
    return out


def _positions(lines: DataFrame, partitions: int | None = None, charset: str | None = None) -> DataFrame:
    """``lines`` with ``ln`` (1, 2, ... in (row_no, sub) order) and ``cum_bytes``
    (bytes in the character set up to the line's end, newline included).

    The lines are range-sorted once and checkpointed with the number of their
    bucket, so that counts and sums see the same buckets even if a task runs
    again; sums inside a bucket are a window, and one row a bucket carries what
    lies before it."""
    keys = ["row_no", "sub"]
    # in a single-byte set a character is a byte, and an empty line is written as a blank (write_script)
    size = F.octet_length if script_charset_name(charset) == "UTF8" else lambda c: F.greatest(F.length(c), F.lit(1))
    dealt = lines.repartitionByRange(partitions, *keys) if partitions else lines.repartitionByRange(*keys)
    placed = (dealt.sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("bucket", F.shiftright("_mid", 33)).withColumn("n_bytes", F.coalesce(size("line"), F.lit(0)).cast("bigint") + 1)
              .checkpoint(eager=True))
    inside = Window.partitionBy("bucket").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("bucket").agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("bucket", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    return (placed.withColumn("b1", F.sum("n_bytes").over(inside)).withColumn("n1", F.row_number().over(inside)).join(before, "bucket")
            .select(*lines.columns, "n_bytes", (F.col("n0") + F.col("n1")).alias("ln"), (F.col("b0") + F.col("b1")).alias("cum_bytes")))


def running_bytes(lines: DataFrame) -> DataFrame:
    """Cumulative UTF-8 bytes (line + newline) in (row_no, sub) order."""
    return _positions(lines).select("row_no", "sub", "line", "cum_bytes")


CHUNK_PARTS = 8  # parts that a chunk of the search holds about


def _next_cut(at: np.ndarray, end: np.ndarray, room: int) -> np.ndarray:
    """Of each line the place of the first line that no longer fits into a part
    it begins: the first behind it that ends more than ``room`` bytes after its start."""
    return np.maximum(np.searchsorted(end, at + room, side="right"), np.arange(len(at)) + 1)


def _exits(room: int):
    """Lines of one chunk with its look-ahead -> for each line that a part from
    an earlier chunk could begin with, the first beginning of a part behind the chunk."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ln")
        ln, end, own = pdf["ln"].to_numpy(), pdf["end"].to_numpy(), pdf["own"].to_numpy()
        at = end - pdf["n_bytes"].to_numpy()
        mine = int(own.sum())  # own lines come first
        to = np.append(_next_cut(at, end, room), len(ln))
        to[mine:] = np.arange(mine, len(to))
        while True:  # successors double until all have left the chunk
            further = to[to]
            if (further == to).all():
                break
            to = further
        entry = np.flatnonzero(pdf["entry"].to_numpy())
        return pd.DataFrame({"ln": ln[entry], "exit": ln[0] + to[entry]})
    return run


def _cuts(room: int):
    """Lines of one chunk and the line its first part begins with -> all beginnings of parts in it."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ln")
        ln, end = pdf["ln"].to_numpy(), pdf["end"].to_numpy()
        to = _next_cut(end - pdf["n_bytes"].to_numpy(), end, room)
        mine, at, out = int(pdf["own"].sum()), int(pdf["begin"].iloc[0] - ln[0]), []
        while at < mine:
            out.append(ln[at])
            at = int(to[at])
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "cut": np.array(out, dtype=np.int64)})
    return run


def part_starts(sizes: DataFrame, room: int) -> DataFrame:
    """(chunk, cut): the lines with which greedy parts of ``room`` bytes begin.

    ``sizes``: ln, n_bytes, cum_bytes. A part is filled until the next line
    would not fit, so where a part begins hangs on all lines before it. The
    chain of beginnings is found without walking it: lines are cut into chunks
    of bytes; in each chunk, every line a part could begin with on entering
    gets the line with which the chain leaves the chunk, and these jumps double
    (a chain over m chunks is covered in log2(m) rounds). With each chunk's
    true beginning known, its parts are listed in place. A chunk reads the
    lines of the next one only as far as one part reaches.
    """
    width = CHUNK_PARTS * room + 1
    begin = F.col("cum_bytes") - F.col("n_bytes")
    spread = sizes.select("ln", "n_bytes", F.col("cum_bytes").alias("end"), F.floor(begin / width).cast("bigint").alias("home"),
                          (begin % width <= room).alias("near"))
    firsts = spread.groupBy("home").agg(F.min("ln").alias("first"))
    spread = spread.join(firsts, "home").withColumn("entry", F.col("near") | (F.col("ln") == F.col("first")))
    both = (spread.withColumn("chunk", F.explode(F.when(F.col("near") & (F.col("home") > 0), F.array(F.col("home"), F.col("home") - 1)).otherwise(F.array("home"))))
            .withColumn("own", F.col("chunk") == F.col("home")).withColumn("entry", F.col("entry") & F.col("own"))
            .select("chunk", "ln", "n_bytes", "end", "own", "entry").checkpoint(eager=True))
    held = both.where("own").select("chunk").distinct()  # a chunk without a line of its own has no part's beginning
    jump = both.join(held, "chunk", "left_semi").groupBy("chunk").applyInPandas(_exits(room), "ln bigint, exit bigint").checkpoint(eager=True)
    home = both.where("entry").select("ln", "chunk")
    reached = both.where("ln = 1 and own").select("ln").checkpoint(eager=True)
    while True:
        more = reached.join(jump, "ln").select(F.col("exit").alias("ln")).join(home, "ln", "left_semi").join(reached, "ln", "left_anti").distinct()
        more = more.checkpoint(eager=True)
        if more.isEmpty():
            break
        reached = reached.unionByName(more).checkpoint(eager=True)
        onward = jump.withColumnRenamed("exit", "mid").join(jump.select(F.col("ln").alias("mid"), "exit"), "mid").select("ln", "exit")
        jump = onward.checkpoint(eager=True)
    starts = reached.join(home, "ln").groupBy("chunk").agg(F.min("ln").alias("begin"))
    return both.join(starts, "chunk").groupBy("chunk").applyInPandas(_cuts(room), "chunk bigint, cut bigint")


def assign_parts(lines: DataFrame, max_bytes: int = DEFAULT_PART_BYTES, header: list[str] | None = None,
                 partitions: int | None = None, charset: str | None = None) -> DataFrame:
    """Lines with ``part_no`` (from 1). A new part starts when the next
    line would push the part over ``max_bytes`` and the part already holds a
    line; each part repeats the header, which counts. The parts are those of one
    pass over all lines, whatever the number of partitions. Without a limit
    (0) all lines are one part."""
    utf8 = script_charset_name(charset) == "UTF8"
    hb = sum((len(h.encode("utf-8")) if utf8 else max(1, len(h))) + 1 for h in header or [])
    placed = _positions(lines, partitions, charset)
    if max_bytes <= 0:
        return placed.select(*lines.columns, F.lit(1).alias("part_no"))
    room = max(0, max_bytes - hb)
    placed = placed.checkpoint(eager=True)
    cuts = part_starts(placed.select("ln", "n_bytes", "cum_bytes"), room)
    # one row a chunk: its beginnings (about CHUNK_PARTS) and the number of parts before it
    by_chunk = cuts.groupBy("chunk").agg(F.sort_array(F.collect_list("cut")).alias("cuts")).checkpoint(eager=True)
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    by_chunk = by_chunk.withColumn("parts_before", F.coalesce(F.sum(F.size("cuts")).over(earlier), F.lit(0)))
    width = CHUNK_PARTS * room + 1
    # a chunk in which no part begins belongs to the last part before it
    held = placed.withColumn("chunk", F.floor((F.col("cum_bytes") - F.col("n_bytes")) / width).cast("bigint"))
    seen = held.select("chunk").distinct().join(by_chunk, "chunk", "left")
    seen = seen.withColumn("parts_before", F.coalesce("parts_before", F.coalesce(
        F.max(F.col("parts_before") + F.size("cuts")).over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    count = F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c <= F.col("ln"))))
    return held.join(seen, "chunk").select(*lines.columns, (F.col("parts_before") + count).cast("int").alias("part_no"))


def with_headers(parted: DataFrame, header: list[str]) -> DataFrame:
    """Header rows for every part (negative ``sub`` sorts them first)."""
    parts = parted.select("part_no").distinct()
    hdr = parts.select("part_no", F.explode(F.array(*[F.struct(F.lit(-len(header) + i).alias("sub"), F.lit(h).alias("line"))
                                                      for i, h in enumerate(header)])).alias("h")) \
               .select("part_no", F.lit(0).cast("long").alias("row_no"), F.col("h.sub").cast("int").alias("sub"),
                       F.col("h.line").alias("line"))
    return parted.select("part_no", "row_no", "sub", "line").unionByName(hdr)


def part_summary(parted_with_headers: DataFrame) -> DataFrame:
    return parted_with_headers.groupBy("part_no").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("line") + 1).alias("bytes"))


# Script character sets, the name a writer knows them by, and the characters they hold
# beside the other scripts' Latin-1 (the 27 of windows-1252 in its 0x80-0x9F rows).
WIN1252_EXTRA = "\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178"
CHARSETS = {"UTF8": ("UTF-8", None), "ISO8859_1": ("ISO-8859-1", "\u0000-\u00ff"),
            "WIN1252": ("windows-1252", "\u0000-\u007f\u00a0-\u00ff" + WIN1252_EXTRA)}


def script_charset_name(charset: str | None) -> str:
    name = (charset or "UTF8").strip().upper()
    if name not in CHARSETS:
        raise ValueError(f"character set {charset!r} is none of {', '.join(CHARSETS)}")
    return name


def not_encodable(parted: DataFrame, charset: str | None) -> DataFrame:
    """The lines that hold a character the character set lacks (quarantine)."""
    held = CHARSETS[script_charset_name(charset)][1]
    return parted.where(F.col("line").rlike(f"[^{held}]") if held else F.lit(False))


def write_script(parted_with_headers: DataFrame, path: str, charset: str | None = None) -> None:
    """S08 sink: one directory per part (``part_no=N``), lines in order, in the
    character set that the header names. Lines that do not encode are left
    out; ``not_encodable`` gives them. Line ends inside a statement stay. In
    another set than UTF8 an empty line is written as a line of one blank."""
    name = script_charset_name(charset)
    encoding, held = CHARSETS[name]
    lines = parted_with_headers.where(~F.col("line").rlike(f"[^{held}]")) if held else parted_with_headers
    placed = lines.repartition("part_no").sortWithinPartitions("part_no", "row_no", "sub").select("part_no", "line")
    writer = placed.write.mode("overwrite").partitionBy("part_no")
    if name == "UTF8":
        writer.text(path)
        return
    # Spark's text writer is UTF-8 alone; its delimited writer with no quote, escape or separator in use encodes, but
    # leaves out empty lines
    writer = (placed.withColumn("line", F.when(F.col("line") == "", " ").otherwise(F.col("line")))
              .write.mode("overwrite").partitionBy("part_no"))
    (writer.option("encoding", encoding).option("sep", "\u0001").option("quote", "\u0000").option("escapeQuotes", False)
     .option("emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "db_id") -> None:
    """Findings, diffs, fleet summaries and field audits as files,
    partitioned by database."""
    w = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.format(fmt).save(path)
