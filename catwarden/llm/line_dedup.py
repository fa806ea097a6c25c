"""Line dedup: repeated runs of lines, found by distributed prefix doubling.

The doubling names classes (as Karp, Miller and Rosenberg do) and is not
followed by a sort of all suffixes: what line dedup asks of the suffix array are
its intervals of common prefixes, and two suffixes are in the same interval of
depth l exactly if the names of their first l lines are equal. So intervals are
the same as those of the sorted array with its LCP values, at one aggregate a
step and without a total order over the corpus.

The corpus is one long sequence of line IDs, document after document by doc_id.
For the suffix that starts at a line, ``rank_h`` names the class of its first h
lines: the position of the class's first member in the corpus. Ranks double as
in suffix array construction,

    rank_2h(i) = rank of the pair (rank_h(i), rank_h(i + h)),

each step one aggregate over the pairs and one join back. In the order of
(rank_1, rank_2, rank_4, ...), a suffix array, the suffixes that share their
first l lines stand together: this is the interval of longest common prefix >= l,
and it is named by the overlapping pair (rank_h(i), rank_h(i + l - h)) with h
the largest power of two up to l, so an interval of any depth costs one lookup.

A run of lines is *repeated* when it is in such an interval with an earlier
member, and counts when it has at least ``min_words`` words. Every maximal
counting run is the union of its shortest counting runs, those that no line can
be taken from at the end (from a given start) or at the start (up to a given
end); so these, two for each line, decide for all lengths. Their union, the
later copies of the maximal repeated runs, is deleted; the first copy stays.

Lines that occur once cannot be in a repeated run and leave after the first
aggregate; the steps end at the longest shortest run. DataFrame functions only.
Hot lines: a rank is a partial aggregate (one row for each pair and task), and
the join back has a shuffle of its own on both sides, which adaptive execution
splits. Nothing is collected for a class, and no pairs of copies are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import forget, written, unused

MIN_WORDS = 50
NO_ID = -(1 << 63)  # a null doc_id comes first

DOC = ["doc", "ver"]


def _place(line: str) -> Column:
    """A position in the corpus as one number: doc_id and line."""
    return F.expr(f"cast(doc as decimal(20,0)) * cast(2147483648 as decimal(10,0)) + {line}")


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))


def _document_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, ver, p, line_id, words): a row for each line, p from 0."""
    rows = docs.where(F.col(text_col).isNotNull()).select(
        _key(id_col).alias("doc"), F.xxhash64(text_col).alias("ver"), F.posexplode(F.split(text_col, "\n")).alias("p", "line"))
    words = F.size(F.array_remove(F.split(F.translate("line", "\t\x0b\f\r", "    "), " "), ""))
    return rows.select(*DOC, "p", F.unhex(F.md5("line")).alias("line_id"), words.cast("bigint").alias("words"))


def _shortest_runs(ranked: DataFrame, min_words: int) -> DataFrame:
    """(doc, ver, p, rank, runs) of the lines in stretches of repeated lines
    that hold ``min_words`` words: ``runs`` are the shortest runs of at least
    that many words that start or end at the line, as (i, n)."""
    order = Window.partitionBy(*DOC).orderBy("p")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    # frames that grow: one that shrinks from the end is evaluated anew for each line
    backwards = Window.partitionBy(*DOC).orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    lone = F.when(F.col("rank").isNull(), F.col("p"))  # a line that occurs once
    # a document row given twice is one document here
    once = (ranked.withColumn("k", F.row_number().over(Window.partitionBy(*DOC, "p").orderBy("line_id"))).where("k = 1")
            .withColumn("cum", F.sum("words").over(running))
            .withColumn("lone_before", F.max(lone).over(running))
            .withColumn("lone_after", F.min(lone).over(backwards)))
    by_words, from_end = (Window.partitionBy(*DOC).orderBy(c) for c in (F.col("cum"), F.col("cum").desc()))
    run = once.select(
        *DOC, "p", "rank", "cum", "words", "lone_before", "lone_after",
        # the first line that ends min_words words or more after this one ends: with it ends the
        # shortest run that starts at the next line
        F.min("p").over(from_end.rangeBetween(Window.unboundedPreceding, -min_words)).alias("next_end"),
        # the last line that ends min_words words or more before this one ends: after it starts the
        # shortest run that ends here
        F.max("p").over(by_words.rangeBetween(Window.unboundedPreceding, -min_words)).alias("before"),
        F.min(F.when(F.col("cum") >= min_words, F.col("p"))).over(Window.partitionBy(*DOC)).alias("first_end"))
    run = (run.withColumn("e", F.when(F.col("p") == 0, F.col("first_end")).otherwise(F.lag("next_end").over(order)))
           .withColumn("s", F.when(F.col("before").isNotNull(), F.col("before") + 1).when(F.col("cum") >= min_words, F.lit(0)))
           .where("rank is not null")
           .withColumn("stretch", F.sum("words").over(Window.partitionBy(*DOC, "lone_before")))
           .where(F.col("stretch") >= min_words))
    forward = F.when(F.col("lone_after").isNull() | (F.col("e") < F.col("lone_after")),
                     F.struct(F.col("p").alias("i"), (F.col("e") - F.col("p") + 1).alias("n")))
    backward = F.when(F.col("lone_before").isNull() | (F.col("s") > F.col("lone_before")),
                      F.struct(F.col("s").alias("i"), (F.col("p") - F.col("s") + 1).alias("n")))
    return run.select(*DOC, "p", "rank", F.filter(F.array_distinct(F.array_compact(F.array(forward, backward))),
                                                  lambda r: r["n"].isNotNull()).alias("runs"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, ver, runs): for each document with later copies, their runs of
    lines as an array of (first line, last line), from 0, in order and apart.
    ``doc`` is the id (the smallest bigint for null), ``ver`` the xxhash64 of
    the text."""
    lines = written(_document_lines(docs, id_col, text_col), "lines")
    # rank_1, of the lines that occur at more than one place
    first = written(lines.select("line_id", _place("p").alias("place"))
                    .groupBy("line_id").agg(F.min("place").alias("rank"), F.max("place").alias("last"))
                    .where("rank <> last").select("line_id", "rank"), "line-ranks")
    active = written(_shortest_runs(lines.join(first, "line_id", "left"), min_words), "active")
    forget(lines)
    runs = active.select(*DOC, F.explode("runs").alias("r")).select(*DOC, "r.i", "r.n").distinct()
    longest = active.select(F.explode("runs").alias("r")).agg(F.max("r.n")).first()[0]
    level = active.select(*DOC, "p", "rank")
    levels = level.withColumn("h", F.lit(1))
    h = 1
    while longest and 2 * h <= longest:
        # rank_h(i + h) of the same document
        ahead = Window.partitionBy(*DOC).orderBy("p").rangeBetween(h, h)
        paired = written(level.withColumn("rank2", F.first("rank").over(ahead)).where("rank2 is not null"), f"pairs-{h}")
        named = written(paired.withColumn("place", _place("p")).groupBy("rank", "rank2")
                        .agg(F.min("place").alias("name"), F.max("place").alias("last")).where("name <> last")
                        .drop("last"), f"classes-{h}")
        h *= 2
        level = written(paired.join(named, ["rank", "rank2"]).select(*DOC, "p", F.col("name").alias("rank")), f"ranks-{h}")
        forget(paired)
        forget(named)
        if level.isEmpty():
            break
        levels = levels.unionByName(level.withColumn("h", F.lit(h)))
    # the interval of each run: the two overlapping ranks that span it
    power = F.expr("cast(shiftleft(1, cast(floor(log2(n)) as int)) as int)")
    runs = runs.withColumn("h", power).withColumn("j", F.expr("cast(i + n - h as int)"))
    keyed = written(
        runs.join(levels.select(*DOC, F.col("p").alias("i"), "h", F.col("rank").alias("r1")), [*DOC, "i", "h"])
        .join(levels.select(*DOC, F.col("p").alias("j"), "h", F.col("rank").alias("r2")), [*DOC, "j", "h"])
        .select(*DOC, "i", "n", "r1", "r2", _place("i").alias("place")), "intervals")
    earliest = written(keyed.groupBy("n", "r1", "r2").agg(F.min("place").alias("origin"), F.max("place").alias("last"))
                       .where("origin <> last").drop("last"), "origins")
    later = keyed.join(earliest, ["n", "r1", "r2"]).where("place > origin").select(*DOC, "i", F.expr("i + n - 1").alias("e"))
    # union of the runs of a document
    sweep = Window.partitionBy(*DOC).orderBy("i", "e")
    reached = F.max("e").over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    part = later.withColumn("fresh", F.coalesce(F.col("i") > reached + 1, F.lit(True)).cast("int"))
    part = part.withColumn("part", F.sum("fresh").over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    spans = part.groupBy(*DOC, "part").agg(F.min("i").alias("first"), F.max("e").alias("last"))
    return spans.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                count_col: str = "line_count", gone_col: str = "lines_deleted") -> DataFrame:
    """``docs`` with the later copies deleted from ``text_col``, and the added
    columns ``count_col`` (lines) and ``gone_col`` (lines deleted).

    Lines are what stands between line feeds. A null text stays null (0
    lines), an empty one empty. Copies are ordered by (doc_id, line): within a
    document, too, the first of equal runs stays. A row given twice under one
    doc_id is one document and both rows get the same result; rows that share
    doc_id and differ in the text are versions of one document, and equal
    lines at the same place of both are no copies. All rows without an id are
    versions of one document, the first in order. Other columns pass through,
    but for two called as the added ones, which are replaced.
    """
    names = docs.columns
    key, ver, run_key, run_ver, run_list = [unused(n, names) for n in ("id", "ver", "run_id", "run_ver", "runs")]
    runs = repeated_lines(docs, id_col, text_col, min_words).select(
        F.col("doc").alias(run_key), F.col("ver").alias(run_ver), F.col("runs").alias(run_list))
    parts = F.split(F.col(text_col), "\n")
    held = (docs.withColumn(key, _key(id_col)).withColumn(ver, F.xxhash64(text_col))
            .join(runs, (F.col(key) == F.col(run_key)) & (F.col(ver) == F.col(run_ver)), "left"))
    # the lines between the runs: a lambda's argument is evaluated once, so the text is split once, and each
    # line that stays is copied once
    def between(s):
        first, last = s["runs"]["first"], s["runs"]["last"]
        gap = F.transform(F.sequence(F.lit(0), F.size(first)), lambda k: F.struct(
            F.when(k == 0, 1).otherwise(F.get(last, k - 1) + 2).alias("at"),
            F.when(k == F.size(first), F.size(s["lines"])).otherwise(F.get(first, k)).alias("end")))
        return F.array_join(F.flatten(F.transform(gap, lambda g: F.slice(s["lines"], g["at"], g["end"] - g["at"] + 1))), "\n")

    rest = F.transform(F.array(F.struct(parts.alias("lines"), F.col(run_list).alias("runs"))), between)[0]
    n_gone = F.coalesce(F.aggregate(run_list, F.lit(0).cast("bigint"), lambda s, r: s + r["last"] - r["first"] + 1), F.lit(0))
    return (held.withColumn(count_col, F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("bigint"))
            .withColumn(gone_col, n_gone.cast("bigint"))
            .withColumn(text_col, F.when(F.col(run_list).isNull(), F.col(text_col)).otherwise(rest))
            .select(*[c for c in names if c.lower() not in (count_col, gone_col)], count_col, gone_col))
