"""MinHash near-dedup: one-permutation sketches, bands, star-shaped edges.

A document is the set of its distinct word shingles (A-Z lower-cased, words
split at ASCII white space). Stages:

1. *Sketch.* Each shingle is hashed once; the hash range is cut into ``BINS``
   bins and a bin keeps its smallest hash. Empty bins borrow from a bin that
   is not empty, chosen by a hash of (bin, attempt) alone (optimal
   densification), so equal sets get equal sketches and a bin of two documents
   agrees with the probability of their similarity. Documents of the same set
   are one *set* from here on, named by their smallest doc_id.
2. *Buckets.* ``BANDS`` bands of ``ROWS`` bins; sets that agree in a band share
   a bucket. At similarity 0.8 a pair misses all bands with probability
   (1 - 0.8^5)^40 < 2e-7.
3. *Star edges.* In a bucket one centre, the most typical member, is compared
   with the members on the full shingle sets, not every member with every
   other; the confirmed pairs are joined to components. Members of a star that
   are then in one component are done: more links among them could change
   nothing. The others are compared where their differences from the centre
   leave a link possible (``_rest``), again on full sets. So no link between
   components is lost, and copies cost one pair for each star they are in.

Hot groups: rows of one set collapse in a partial aggregate; bucket centres and
component labels are partial aggregates too; the joins back are skew joins that
adaptive execution splits. Sets are shipped only for candidate pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import forget, kept_in_worker, written

SHINGLE = 4
BINS, BANDS, ROWS = 200, 40, 5
NUMERATOR, DENOMINATOR = 80, 100
SMALL_STAR = 32  # stars of more open members look for pairs by their differences

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x9FB21C651E98DF25)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_CODE = (np.arange(1, 257, dtype=np.uint64) * _M3) ^ (np.arange(1, 257, dtype=np.uint64) * _M1 >> np.uint64(7))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)
_INV_BASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 16)
        _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE))), dtype=np.uint64)
        _inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _INV_BASE))), dtype=np.uint64)
    return _powers, _inverse


def shingles(text: str | bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles. Fewer words
    than ``size``: the whole sequence as one; no words: none."""
    raw = text.encode() if isinstance(text, str) else bytes(text or b"")
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    byte = np.frombuffer(raw.translate(_LOWER), dtype=np.uint8)
    edge = np.diff(np.concatenate(([1], _SPACE[byte].view(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    # polynomial hash of each word by differences of a running sum (all modulo 2^64)
    powers, inverse = _tables(len(byte) + 1)
    run = np.concatenate(([np.uint64(0)], np.cumsum(_CODE[byte] * powers[:len(byte)], dtype=np.uint64)))
    word = mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _M2)
    n = min(size, len(word))
    h = np.full(len(word) - n + 1, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        h = mix(h * _M3 + word[k:len(word) - n + 1 + k])
    return np.unique(h)


_EDGES = np.array([-(-(b << 64) // BINS) for b in range(BINS)], dtype=np.uint64)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation sketches, a row for each non-empty set, densified."""
    out = np.zeros((len(sets), BINS), dtype=np.uint64)
    filled = np.zeros((len(sets), BINS), dtype=bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, _EDGES)
        filled[i] = np.diff(np.append(at, len(s))) > 0
        out[i, filled[i]] = s[at[filled[i]]]
    own = filled.copy()
    rows, attempt, bins = np.flatnonzero(~filled.all(axis=1)), 0, np.arange(BINS, dtype=np.uint64)
    while len(rows):
        attempt += 1
        donor = (mix(bins * _M3 + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        take = ~filled[rows] & own[rows][:, donor]
        r, b = np.nonzero(take)
        out[rows[r], b] = out[rows[r], donor[b]]
        filled[rows[r], b] = True
        rows = rows[~filled[rows].all(axis=1)]
    return out


def bands(sketches: np.ndarray) -> np.ndarray:
    """A bucket name (64 bits) for each band."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sketches), 1))
    for k in range(ROWS):
        h = mix(h * _M3 + parts[:, :, k])
    return h.view(np.int64)


_SKETCH = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("set_id", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType()))])


def _sketch_udf(size: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept_in_worker("near-dedup", object)  # frees what the operator before kept in this worker
        for texts in batches:
            n, ids, made = [], [], [None] * len(texts)
            chunk, at = [], []

            def flush():
                if chunk:
                    for i, b in zip(at, bands(sketch(chunk))):
                        made[i] = b
                    chunk.clear()
                    at.clear()

            for i, t in enumerate(texts):
                s = shingles(t, size)
                n.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    chunk.append(s)
                    at.append(i)
                if len(chunk) >= 512:
                    flush()
            flush()
            yield pd.DataFrame({"n": n, "set_id": ids, "bands": made})

    return F.pandas_udf(run, _SKETCH)


def _sets_udf(size: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t, size).view(np.int64) for t in texts], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.LongType()))


def similar(a: str, b: str):
    """100 * intersection >= 80 * union, on whole sets (arrays of distinct hashes)."""
    both = F.size(F.array_intersect(a, b))
    return DENOMINATOR * both >= NUMERATOR * (F.size(a) + F.size(b) - both)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b: bigint): label is the
    smallest node of the component. Alternating large-star and small-star
    steps; the smallest neighbour of a node is a partial aggregate, written so
    that the join back has a shuffle of its own, which adaptive execution can
    split at a hub. The number of steps grows with the logarithm of the nodes."""

    def settled(e: DataFrame) -> bool:
        """Each node is either a root or the child of one root."""
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionAll(
            e.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        return ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("root").alias("root")).where("child + root > 1").isEmpty()

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not settled(e):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .where("u <> v").distinct(), "large-star")
        # small star: u and its smaller neighbours go to the smallest of them
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = written(large.join(low, "u").select(F.col("v").alias("x"), "m")
                        .unionAll(low.select(F.col("u").alias("x"), "m"))
                        .where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "small-star")
        for t in (e, least, large, low):
            forget(t)
        e = small
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots)


def _confirmed(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    return (pairs.join(whole.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(whole.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
            .where(similar("sa", "sb")).select("a", "b"))


def _stars(crowd: DataFrame) -> DataFrame:
    """(c, x): the members of each bucket with a centre of its own group.

    The centre of a bucket is its most typical member, the one that shares most
    buckets with others. A group of copies has many buckets, whose centres
    differ a little; each therefore hands over to the most typical of the
    centres of its own buckets, so that a group has few stars. (Any document
    can be a centre: it is only what members are compared with first.)
    """
    weight = written(crowd.groupBy("rep").agg(F.sum("size").alias("weight")), "weights")
    ranked = crowd.join(weight.select("rep", (F.col("weight") * 1024 + F.xxhash64("rep").bitwiseAND(F.lit(1023))).alias("w")), "rep")
    centre = written(ranked.groupBy("bucket").agg(F.max_by("rep", "w").alias("c"), F.max("w").alias("w")), "centres")
    seen = crowd.select("bucket", "rep").join(centre, "bucket")
    leader = written(seen.groupBy("rep").agg(F.max_by("c", "w").alias("lead")), "leaders")
    twice = leader.select(F.col("rep").alias("lead"), F.col("lead").alias("last"))
    last = leader.join(twice, "lead").select(F.col("rep").alias("c"), "last")
    chosen = written(centre.select("bucket", "c").join(last, "c").select("bucket", F.col("last").alias("c")), "chosen-centres")
    return written(crowd.join(chosen, "bucket").where("rep <> c").select("c", F.col("rep").alias("x")).distinct(), "stars")


def _rest(measured: DataFrame, label: DataFrame | None, whole: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of members of one star that the links to the
    centre left in different components.

    With D(x) the shingles in which x and the centre differ, two members differ
    in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, and they are linked exactly
    if 18 |D(x) & D(y)| >= g(x) + g(y), where g(x) = 9 |D(x)| - |x|. If the
    right side is not positive both are linked to the centre, so members of
    different components must share shingles of D. In large stars these are
    found by an equi-join on the rarest shingles of D (prefix filter: of d
    shingles of which at least t must be shared, one is among the first d - t
    + 1 in any fixed order); in small ones, pairs that fail the triangle
    inequality are left out. Neither loses a link.
    """
    if label is None:
        m = measured.withColumn("label", F.col("x"))
    else:
        m = measured.join(label, measured["x"] == label["node"], "left").withColumn("label", F.coalesce("label", "x")).drop("node")
    m = written(m.select("c", "x", "label", "n", "d", (9 * F.col("d") - F.col("n")).alias("g")), "members")
    best = written(m.groupBy("c").agg(F.min(F.struct("g", "label")).alias("one"), F.min("label").alias("lo"), F.max("label").alias("hi"))
                   .where("lo <> hi").select("c", F.col("one.g").alias("g1"), F.col("one.label").alias("l1")), "star-first")
    second = written(m.join(best, "c").where("label <> l1").groupBy("c").agg(F.min("g").alias("g2")), "star-second")
    # t: what a member must share at least with any member of another component
    need = F.ceil((F.col("g") + F.when(F.col("label") == F.col("l1"), F.col("g2")).otherwise(F.col("g1"))) / 18).cast("bigint")
    m = written(m.join(best, "c").join(second, "c").withColumn("t", F.greatest(need, F.lit(1))).where("t <= d")
                .select("c", "x", "label", "n", "d", "g", "t"), "open-members")
    count = written(m.groupBy("c").agg(F.count(F.lit(1)).alias("open")).where("open > 1"), "open-stars")
    m = m.join(count, "c")

    few = m.where(F.col("open") <= SMALL_STAR)
    other = few.select("c", F.col("x").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("d").alias("dy"))
    near = few.join(other, "c").where(
        f"x < y and label <> ly and 9 * abs(d - dy) <= n + ny and {DENOMINATOR} * least(n, ny) >= {NUMERATOR} * greatest(n, ny)"
    ).select(F.col("x").alias("a"), F.col("y").alias("b"))

    many = m.where(F.col("open") > SMALL_STAR)
    differs = (many.join(whole.select(F.col("rep").alias("c"), F.col("shingles").alias("sc")), "c")
               .join(whole.select(F.col("rep").alias("x"), F.col("shingles").alias("sx")), "x")
               .select("c", "x", "label", "n", "d", "g", "t",
                       F.explode(F.concat(F.array_except("sx", "sc"), F.array_except("sc", "sx"))).alias("e")))
    differs = written(differs, "differences")
    common = written(differs.groupBy("c", "e").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "difference-counts")
    # shingles that no other member differs by are the rarest and cannot be shared: they only count
    # for the place of the others in the order
    shared = differs.join(common, ["c", "e"])
    member = Window.partitionBy("c", "x")
    order = member.orderBy("df", "e")
    first = (shared.withColumn("k", F.row_number().over(order) + F.col("d") - F.count(F.lit(1)).over(member))
             .where("k <= d - t + 1").select("c", "e", "x", "label", "n", "d", "g", "k"))
    first = written(first, "prefixes")
    y = first.select("c", "e", F.col("x").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("d").alias("dy"), F.col("g").alias("gy"), F.col("k").alias("ky"))
    # after the first shared shingle, d - k and dy - ky are left that could be shared too
    far = first.join(y, ["c", "e"]).where(
        "x < y and label <> ly and 9 * abs(d - dy) <= n + ny and g + gy <= 18 * (1 + least(d - k, dy - ky))"
    ).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return written(near.unionAll(far).distinct(), "rest-pairs")


def _labels(sets: DataFrame, rows: DataFrame, size: int) -> DataFrame | None:
    """(node, label) of the sets (rep, bands) that are linked with others; None if none are."""
    member = sets.select("rep", F.explode("bands").alias("bucket"))
    shared = written(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared-buckets")
    crowd = written(member.join(shared, "bucket").select("bucket", "size", "rep"), "crowd")
    if crowd.isEmpty():
        return None
    stars = _stars(crowd)
    # whole sets of the documents that share a bucket, made from their texts once
    wanted = crowd.select(F.col("rep").alias("doc_id")).distinct()
    whole = written(
        rows.join(wanted, "doc_id", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])
        .select(F.col("doc_id").alias("rep"), _sets_udf(size)(F.col("text")).alias("shingles")), "shingles")
    measured = written(
        stars.join(whole.select(F.col("rep").alias("c"), F.col("shingles").alias("sc")), "c")
        .join(whole.select(F.col("rep").alias("x"), F.col("shingles").alias("sx")), "x")
        .select("c", "x", F.size("sc").alias("nc"), F.size("sx").alias("n"), F.size(F.array_intersect("sc", "sx")).alias("both"))
        .withColumn("d", F.col("nc") + F.col("n") - 2 * F.col("both")), "measured")
    links = measured.where(f"{DENOMINATOR} * both >= {NUMERATOR} * (nc + n - both)").select(F.col("c").alias("a"), F.col("x").alias("b"))
    label = None if links.isEmpty() else written(components(links), "labels")
    more = written(_confirmed(_rest(measured, label, whole), whole), "more-links")
    if more.isEmpty():
        return label
    if label is not None:  # the components found so far stand for their links
        more = more.unionAll(label.select(F.col("node").alias("a"), F.col("label").alias("b")))
    return written(components(more), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links),
    kept (doc_id = component_id) for each row of ``docs``.

    Null, empty and blank texts have no shingles and are linked with nothing
    (component_id is their doc_id). A row given twice gets equal results twice.
    An id is one node: rows that share an id and differ in the text keep their
    own n_shingles, but what either text is linked with is linked with the id,
    so all of them get one component. A null doc_id is linked with nothing and
    kept. Only the two named columns are read, so other columns and their names
    do not matter. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    base = written(rows.withColumn("s", _sketch_udf(size)(F.col("text")))
                   .select("doc_id", F.col("s.n").alias("n"), F.col("s.set_id").alias("set_id"), F.col("s.bands").alias("bands")), "sketches")
    # rows of one set: a partial aggregate, whatever the size of the group; the set goes by its smallest doc_id
    sets = written(base.where("n > 0 and doc_id is not null").groupBy("set_id", "n")
                   .agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "sets")
    label = _labels(sets, rows, size)
    named = sets.select("set_id", F.col("rep").alias("component"))
    if label is not None:
        named = named.join(label, named["component"] == label["node"], "left").select(
            "set_id", F.coalesce("label", "component").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return base.select("doc_id", "n", "set_id").join(written(named, "components"), "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The documents that stay, one of each component, with all columns. A row
    repeated under the id that stays is kept once for each time it is given."""
    kept = near_duplicates(docs, id_col, text_col, size).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
