"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from . import (decontamination, exact_dedup, language_id, line_dedup, minhash_dedup, pii, quality, sentencepiece_codec,
               token_alignment, token_counts, toxicity, url_filters, vector_codes)
from .common import hex_sha256, is_held_out, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """What the operators' Python workers need: the package, batches of a bounded number of rows."""
    ship_package(spark)
    small_batches(spark)


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return register


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_pii")
def op2_pii(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[F.col(f"pii.n_{k}").alias(f"n_{k}") for k in pii.KINDS],
        hex_sha256(F.col("pii.base")).alias("base_sha256"), F.col("pii.spans").alias("spans"), F.col("pii.n_added").alias("n_added"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    """Ids of each whole text, and whether decoding them gives the text back."""
    encoded = sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = sentencepiece_codec.decode(encoded)
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        hex_sha256(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sentencepiece_codec.round_trips(F.col("decoded"), F.col("text")).alias("round_trip"))


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op4_exact_dedup", f"""
WITH t AS (SELECT doc_id, sha256({_LOWER_SQL}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""")
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op5_near_dedup")
def op5_near_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op6_decontamination", f"""
WITH items AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS MATERIALIZED (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n)),
met AS MATERIALIZED (SELECT g.doc_id, g.i, g.n, x.item FROM grams g JOIN windows x ON x.n = g.n AND x.win = g.win),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM met) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN its t ON t.doc_id = d.doc_id""")
def op6_decontamination(spark, sf_dir):
    found = decontamination.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "hit.n_words", "hit.n_hit", "hit.n_items",
        hex_sha256(F.array_join("hit.items", ",")).alias("items_sha256"), decontamination.contaminated().alias("contaminated"))


@query("op7_url_filters", r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
        FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN fit f ON f.page_id = p.page_id AND f.k = 1""")
def op7_url_filters(spark, sf_dir):
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), url_filters.rules_frame(spark)).drop("url")


@query("op8_quality")
def op8_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    """The histogram with its suffix sums: every context limit's totals."""
    counted = token_counts.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_counts.token_report(counted)


@query("op10_line_dedup", r"""
WITH RECURSIVE l AS MATERIALIZED (
  SELECT doc_id, p, string_split(text, chr(10))[p] AS line FROM (
    SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS p FROM documents WHERE text IS NOT NULL)),
w AS MATERIALIZED (
  SELECT doc_id, p, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
         count(*) OVER (PARTITION BY line) > 1 AS rep FROM l),
grow AS (
  SELECT doc_id, p AS i, p AS e, CAST(words AS BIGINT) AS n, sha256(line) AS h FROM w WHERE rep
  UNION ALL
  SELECT g.doc_id, g.i, g.e + 1, g.n + w.words, sha256(g.h || sha256(w.line))
  FROM grow g JOIN w ON w.doc_id = g.doc_id AND w.p = g.e + 1 WHERE w.rep AND g.n < 50),
runs AS MATERIALIZED (SELECT doc_id, i, e, h FROM grow WHERE n >= 50),
back AS (
  SELECT doc_id, p AS i, p AS e, CAST(words AS BIGINT) AS n, sha256(line) AS h FROM w WHERE rep
  UNION ALL
  SELECT g.doc_id, g.i - 1, g.e, g.n + w.words, sha256(sha256(w.line) || g.h)
  FROM back g JOIN w ON w.doc_id = g.doc_id AND w.p = g.i - 1 WHERE w.rep AND g.n < 50),
both_ways AS (
  SELECT doc_id, i, e, 'f' || h AS h FROM runs UNION ALL SELECT doc_id, i, e, 'b' || h FROM back WHERE n >= 50),
firsts AS (SELECT *, min(CAST(doc_id AS HUGEINT) * 2147483648 + i) OVER (PARTITION BY h) AS origin FROM both_ways),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, e)) AS p FROM firsts WHERE CAST(doc_id AS HUGEINT) * 2147483648 + i > origin),
kept AS (SELECT l.doc_id, count(*) FILTER (g.p IS NOT NULL) AS gone, string_agg(line, chr(10) ORDER BY l.p) FILTER (g.p IS NULL) AS rest, count(*) AS n
         FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n, 0) AS line_count, coalesce(k.gone, 0) AS lines_deleted, sha256(coalesce(k.rest, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id""")
def op10_line_dedup(spark, sf_dir):
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "line_count", "lines_deleted", hex_sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


@query("op11_language_id")
def op11_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _codes_sql() -> str:
    """The rounds of op12 as plain SQL: every part against every entry."""
    near = """SELECT v.vec_id, v.r, v.label, v.p, v.x, b.e, b.c, v.d,
    list_sum(list_transform(range(1, len(v.x) + 1), lambda j: (v.x[j] - b.c[j]) * (v.x[j] - b.c[j]))) AS dist FROM parts v JOIN {books} b ON b.p = v.p"""
    steps = []
    for k in range(vector_codes.ROUNDS):
        steps.append(f"""n{k} AS MATERIALIZED (SELECT p, x, e FROM ({near.format(books=f"b{k}")}) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY dist, e) = 1),
s{k} AS (SELECT p, e, list(CAST(floor_div AS BIGINT) ORDER BY j) AS c FROM (
  SELECT p, e, j, CAST((sum(x[j]) - ((sum(x[j]) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS floor_div
  FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS j FROM n{k}) GROUP BY p, e, j) GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM b{k} b LEFT JOIN s{k} s ON s.p = b.p AND s.e = b.e)""")
    last = f"b{vector_codes.ROUNDS}"
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, r, p, len(v) AS d, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM kept, range(8) AS t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 16),
{", ".join(steps)},
done AS (SELECT * FROM ({near.format(books=last)}) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY dist, e) = 1),
coded AS (SELECT r, vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM done GROUP BY r, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM {last}) AS codebooks_sha256
FROM coded"""


@query("op12_vector_codes", _codes_sql())
def op12_vector_codes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.fit(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = vector_codes.with_group_error(vector_codes.encode(vectors, books).drop("embedding"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c.cast("bigint"))), 2, "0")))
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    found = token_alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("aligned.n_a") > 0, hex_sha256(F.col("aligned.groups"))).otherwise("")
    slim = found.select("doc_id", digest.alias("groups_sha256"), F.col("aligned").dropFields("groups").alias("aligned"))
    return token_alignment.with_link_counts(slim).select(
        "doc_id", "aligned.n_a", "aligned.n_b", "aligned.n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
