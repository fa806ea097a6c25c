"""URL filters: host-suffix and path-prefix expressions met by hash prefix.

Each distinct URL is expanded into the expressions a rule could have named: a
suffix of its host that starts at a label, joined with a prefix of its path.
Suffixes first meet the rules' hosts, which bring the lengths of their paths;
so only prefixes that some rule of that host could name are made. Suffixes and
expressions meet the rules in equi-joins on the first bytes of their SHA-256
(a short, evenly spread key, as in Safe Browsing lists); a match counts only if
the full digests agree. The longest rule wins.

A list of up to ``SMALL_RULES`` rules is broadcast; a longer one is joined by a
salted shuffle, as ``net`` is a suffix of a large share of all hosts.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import ascii_lower, hex_sha256, written

PREFIX_HEX = 8  # 32 bits of the digest
SMALL_RULES = 20_000
SALTS = 16


@dataclass(frozen=True)
class Rule:
    verdict: str  # "allow" or "block"
    host: str
    path: str


#: The rules of the registered query (fixed values).
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

RULE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("verdict", "host", "path")])


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], RULE_SCHEMA)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _met(left: DataFrame, right: DataFrame, left_key: str, right_key: str, small: bool, spread: str) -> DataFrame:
    """Equi-join with a table made from the rules: broadcast if it is small;
    else by a shuffle on (key, salt), the rules' rows once for each salt, so
    that a key which most URLs share is dealt to ``SALTS`` tasks."""
    if small:
        return left.join(F.broadcast(right), F.col(left_key) == F.col(right_key))
    salted = left.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, (F.col(left_key) == F.col(right_key)) & (F.col("salt") == F.col("copy"))).drop("salt", "copy")


def rule_verdicts(urls: DataFrame, rules: DataFrame, broadcast_rows: int = SMALL_RULES) -> DataFrame:
    """(url, rule, verdict) for each distinct non-null url that some rule fits.

    The plan does not grow with the rules: host suffixes are the last 1 to
    (most labels of a rule) labels of the host, and each suffix that is a
    rule's host brings the lengths of that host's rule paths, which give the
    path prefixes.
    """
    rules = rules.select("verdict", "host", "path").where(F.col("host").isNotNull() & F.col("path").isNotNull())
    name = F.concat("host", "path")
    # one entry for each expression: of rules that differ in the verdict alone the stricter counts
    listed = written(
        rules.select(hex_sha256(F.concat_ws("\n", "host", "path")).alias("digest"), "host", F.length("path").alias("size"),
                     F.struct(F.length(name).alias("size"), F.length("host").alias("host_size"),
                              (F.col("verdict") == "block").alias("strict"), name.alias("rule"), F.col("verdict").alias("verdict")).alias("entry"))
        .groupBy("digest", "host", "size").agg(F.max("entry").alias("entry")), "url-rules")
    n, labels = listed.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0))).first()
    small = n <= broadcast_rows
    hosts = (listed.groupBy("host").agg(F.sort_array(F.collect_set("size")).alias("sizes"))
             .select(hex_sha256(F.col("host")).alias("host_digest"), "sizes").withColumn("host_prefix", F.substring("host_digest", 1, PREFIX_HEX)))
    entries = listed.select("digest", F.substring("digest", 1, PREFIX_HEX).alias("prefix"), "entry")

    distinct = urls.select("url").where(F.col("url").isNotNull()).distinct().select(
        "url", F.split(url_host(F.col("url")), r"\.").alias("labels"), url_path(F.col("url")).alias("path"))
    depth = F.least(F.size("labels"), F.lit(labels))
    suffix = F.explode(F.transform(F.when(depth > 0, F.sequence(F.lit(1), depth)), lambda k: F.array_join(F.slice("labels", -k, k), ".")))
    of_host = distinct.select("url", "path", suffix.alias("suffix")).withColumn("suffix_digest", hex_sha256(F.col("suffix")))
    of_host = _met(of_host.withColumn("short", F.substring("suffix_digest", 1, PREFIX_HEX)), hosts, "short", "host_prefix", small, "url").where(
        "suffix_digest = host_digest").select("url", "path", "suffix", "sizes")
    expression = of_host.select("url", "path", "suffix", F.explode("sizes").alias("size")).where(F.length("path") >= F.col("size")).select(
        "url", hex_sha256(F.concat_ws("\n", "suffix", F.expr("substring(path, 1, size)"))).alias("full"))
    met = _met(expression.withColumn("short", F.substring("full", 1, PREFIX_HEX)), entries, "short", "prefix", small, "url").where("full = digest")
    best = met.groupBy("url").agg(F.max("entry").alias("entry"))
    return best.select("url", "entry.rule", "entry.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow",
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, url, host, path, rule, verdict.

    A rule fits its host and all subdomains when the url's path starts with the
    rule's path; the longest (host and path together, then the longer host,
    then block) wins. A url no rule fits gets ``default`` and a null rule. A
    null url, or one without ``://``, has an empty host and path, which no
    rule fits. Repeated rows stay repeated. Only the id and the url are read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    verdicts = rule_verdicts(rows, rules)
    return rows.join(verdicts, "url", "left").select(
        "page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"))
