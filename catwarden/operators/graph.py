"""Dependency graphs: FK depth (G01) and routine call order.

Both are iterative DataFrame loops: every round is one join over all
databases at once, and the loop ends when a round produces nothing. Long
loops cut their lineage with ``checkpoint()`` in the session's shared
checkpoint folder (never a machine-local folder).
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..session import ensure_checkpoint_dir
from .catalog import Catalog

def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(db_id, node, level) of the nodes that reach no cycle: the longest chain
    of edges (db_id, src, dst) below the node, 0 where there is none.

    Each round settles the nodes whose targets are all settled, and shortens
    chains by pointer doubling: the level of a node is max(a, level(dst) + w)
    over its open edges, so an edge to a node with a single open edge moves on to
    that one's target, with both weights added and ``a`` carried along. A chain of
    n tables takes about log2(n) rounds. No frame has more rows than the edges;
    edges, lower bounds and the settled nodes of a round are checkpointed.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    key = ["db_id", "node"]
    open_edges = edges.select("db_id", "src", "dst", F.lit(1).cast("bigint").alias("w")).distinct().checkpoint(eager=True)
    sources = open_edges.select("db_id", F.col("src").alias("node")).distinct()
    bound = sources.withColumn("a", F.lit(0).cast("bigint"))
    settled = nodes.select(*key).distinct().join(sources, key, "left_anti").withColumn("level", F.lit(0).cast("bigint")).checkpoint(eager=True)
    done = [settled]
    while not settled.isEmpty():
        hit = open_edges.join(settled.select("db_id", F.col("node").alias("dst"), "level"), ["db_id", "dst"], "left")
        rest = hit.where("level is null").drop("level").checkpoint(eager=True)
        found = hit.where("level is not null").select("db_id", F.col("src").alias("node"), (F.col("level") + F.col("w")).alias("a"))
        bound = bound.unionByName(found).groupBy(*key).agg(F.max("a").alias("a")).checkpoint(eager=True)
        still = rest.groupBy("db_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.max("dst").alias("to"), F.max("w").alias("far"))
        settled = bound.join(still, key, "left_anti").withColumnRenamed("a", "level").checkpoint(eager=True)
        done.append(settled)
        through = (still.where((F.col("n") == 1) & (F.col("to") != F.col("node"))).join(bound, key)
                   .select("db_id", F.col("node").alias("dst"), "to", "far", "a"))
        moved = rest.join(through, ["db_id", "dst"], "left").withColumn("on", F.col("to").isNotNull() & (F.col("to") != F.col("src"))).checkpoint(eager=True)
        carried = moved.where("on").select("db_id", F.col("src").alias("node"), (F.col("a") + F.col("w")).alias("a"))
        # on a cycle weights would double without end; what is bounded here is never read
        weight = F.least(F.when(F.col("on"), F.col("w") + F.col("far")).otherwise(F.col("w")), F.lit(1 << 40))
        open_edges = (moved.select("db_id", "src", F.when(F.col("on"), F.col("to")).otherwise(F.col("dst")).alias("dst"), weight.alias("w"))
                      .groupBy("db_id", "src", "dst").agg(F.max("w").alias("w")).checkpoint(eager=True))
        bound = (bound.join(still.select(*key), key, "left_semi").unionByName(carried)
                 .groupBy(*key).agg(F.least(F.max("a"), F.lit(1 << 40)).alias("a")))
    return reduce(DataFrame.unionByName, done)


def fk_edges(cat: Catalog) -> DataFrame:
    """Distinct (db_id, src, dst) over FKs whose referenced table exists."""
    known = cat.tables.select("db_id", F.upper("table_name").alias("dst")).distinct()
    e = cat.fks.where(F.trim(F.coalesce("ref_table", F.lit(""))) != "").select(
        "db_id", F.upper("table_name").alias("src"), F.upper("ref_table").alias("dst"))
    return e.join(known, ["db_id", "dst"], "left_semi").distinct()


def fk_depth(cat: Catalog) -> DataFrame:
    """FK depth per table (``levels``): depth = 1 + the largest depth it
    references (0 for a root; unknown references are ignored). Tables without
    a level are on or behind an FK cycle (``cyclic``): their
    depth is 1 + the largest depth among peeled tables they reference (cycle
    edges count as 1). A self-reference gives at least 1."""
    edges = fk_edges(cat)
    proper = edges.where(F.col("src") != F.col("dst"))
    self_ref = edges.where(F.col("src") == F.col("dst")).select("db_id", F.col("src").alias("node")).distinct()
    tables = cat.tables.select("db_id", F.upper("table_name").alias("node"), "table_name")
    peeled = levels(tables, proper).withColumn("depth", F.col("level").cast("int")).drop("level").checkpoint(eager=True)
    pending = tables.select("db_id", "node").distinct().join(peeled, ["db_id", "node"], "left_anti")
    succ = (proper.join(peeled.select("db_id", F.col("node").alias("dst"), F.col("depth").alias("d")), ["db_id", "dst"])
                  .groupBy("db_id", F.col("src").alias("node")).agg(F.max("d").alias("succ_max")))
    stuck = (pending.join(succ, ["db_id", "node"], "left")
                    .select("db_id", "node", (F.coalesce("succ_max", F.lit(0)) + 1).alias("depth"),
                            F.lit(True).alias("cyclic")))
    all_nodes = peeled.select("db_id", "node", "depth", F.lit(False).alias("cyclic")).unionByName(stuck)
    out = (tables.join(all_nodes, ["db_id", "node"], "left")
                 .join(self_ref.withColumn("_self", F.lit(1)), ["db_id", "node"], "left"))
    return out.select("db_id", "table_name",
                      F.greatest(F.coalesce("depth", F.lit(0)), F.coalesce("_self", F.lit(0))).cast("int").alias("depth"),
                      F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


# ---- routine call graph ------------------------------------------------------

# Call-site patterns (EXECUTE PROCEDURE x; FROM x; JOIN x), quoted or bare.
CALL_EXECUTE = r'(?i)EXECUTE\s+PROCEDURE\s+("[^"]+"|[A-Z0-9_$]+)'
CALL_FROM_JOIN = r'(?i)\b(?:FROM|JOIN)\s+("[^"]+"\s*\(|"[^"]+"\w|[A-Z0-9_$]+\b)'


def _callee_name(c):
    quoted = F.regexp_extract(c, r'^"([^"]+)"', 1)
    return F.upper(F.trim(F.when(c.startswith('"'), quoted).otherwise(c)))


def routine_edges(routines: DataFrame) -> DataFrame:
    """(db_id, caller, callee) for procedures calling known procedures
    of the same database, self-calls dropped. Upper-case names."""
    procs = routines.where(F.col("kind") == "PROCEDURE")
    src = F.coalesce(F.col("source"), F.lit(""))
    calls = procs.select(
        "db_id", F.upper("name").alias("caller"),
        F.explode(F.array_union(F.regexp_extract_all(src, F.lit(CALL_EXECUTE), 1),
                                F.regexp_extract_all(src, F.lit(CALL_FROM_JOIN), 1))).alias("raw"))
    calls = calls.select("db_id", "caller", _callee_name(F.col("raw")).alias("callee")).where(F.col("callee") != "")
    known = procs.select("db_id", F.upper("name").alias("callee")).distinct()
    return (calls.join(known, ["db_id", "callee"], "left_semi")
                 .where(F.col("caller") != F.col("callee")).distinct())


def routine_levels(routines: DataFrame) -> DataFrame:
    """``level`` is the longest chain of calls below a procedure (0 =
    calls nothing). Procedures on or behind a cycle have none: ``cyclic``.
    Order for emission: (level, name), cyclic remainder last by name."""
    procs = routines.where(F.col("kind") == "PROCEDURE").select(
        "db_id", "name", F.upper("name").alias("node")).dropDuplicates(["db_id", "node"])
    calls = routine_edges(routines).withColumnsRenamed({"caller": "src", "callee": "dst"})
    found = levels(procs, calls)
    return (procs.join(found, ["db_id", "node"], "left")
                 .select("db_id", "name", F.col("level").cast("int").alias("level"), F.col("level").isNull().alias("cyclic")))


def routine_order(routines: DataFrame) -> DataFrame:
    lv = routine_levels(routines)
    return lv.orderBy("db_id", "cyclic", "level", F.upper("name"))


# ---- A14: smallest argument count at any call site ----------------------------

_CALL_TOKEN = re.compile(
    r"""(?P<remark>--[^\r\n]*|/\*(?s:.*?)(?:\*/|\Z))
      | (?P<call>(?:FROM|JOIN|EXECUTE\s+PROCEDURE)\s+(?P<callee>"[^"]+"|[A-Z0-9_$]+)\s*\()
      | (?P<open>\() | (?P<close>\)) | (?P<comma>,)
      | (?P<text>'[^']*(?:'|\Z)|"[^"]*"|[\w$]+|\S)""", re.IGNORECASE | re.VERBOSE)


def _call_sites(src: str | None) -> list[tuple[str, int]]:
    """(callee in upper case, number of arguments) of each call with a closed
    list of arguments, nested ones included; text in quotes and comments is none."""
    sites: list[tuple[str, int]] = []
    lists: list[list] = []  # of each open bracket: callee or None, commas, whether it holds anything
    for m in _CALL_TOKEN.finditer(src or ""):
        kind = m.lastgroup if m["callee"] is None else "call"
        if kind == "remark":
            continue
        if kind == "close":
            if lists:
                callee, commas, filled = lists.pop()
                if callee:
                    sites.append((callee, commas + 1 if filled else 0))
            continue
        if lists:
            lists[-1][1] += kind == "comma"
            lists[-1][2] = True
        if kind in ("call", "open"):
            lists.append([m["callee"].strip('"').strip().upper() if kind == "call" else None, 0, False])
    return sites


def min_call_arity(routines: DataFrame) -> DataFrame:
    """Per called procedure (known in the same database, not the
    caller itself) the smallest argument count at any call site."""
    schema = T.ArrayType(T.StructType([T.StructField("callee", T.StringType()),
                                       T.StructField("n_args", T.IntegerType())]))

    @pandas_udf(schema)
    def sites(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"callee": c, "n_args": n} for c, n in _call_sites(x)])

    procs = routines.where(F.col("kind") == "PROCEDURE")
    calls = procs.select("db_id", F.upper("name").alias("caller"), F.explode(sites(F.col("source"))).alias("c")) \
                 .select("db_id", "caller", "c.callee", "c.n_args")
    known = procs.select("db_id", F.upper("name").alias("callee")).distinct()
    return (calls.where(F.col("callee") != F.col("caller"))
                 .join(known, ["db_id", "callee"], "left_semi")
                 .groupBy("db_id", "callee").agg(F.min("n_args").alias("min_args"), F.count(F.lit(1)).alias("call_sites")))
