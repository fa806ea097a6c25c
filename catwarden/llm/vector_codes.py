"""Product codes of vectors: slice-and-intersect bitmasks find the nearest entry.

Components become integers floor(4096 * x); a vector is cut into equal parts,
and each part is coded by the nearest entry of its position's codebook (squared
Euclidean distance, ties to the lower index). Codebooks are trained by rounds of
assigning and averaging over all rows.

The nearest entry is found without comparing all of them. For every dimension
of a part the entries' coordinates are sorted, and each place in that order
carries a prefix mask: the uint64 set of the entries before it. The distance to
the entry with the nearest coordinate in the widest dimension is the initial
radius; in each dimension the range [x - radius, x + radius] is two binary
searches, and the xor of two prefix masks is the set of entries in it. The AND
over all dimensions holds every entry within the radius, the nearest among
them, so comparing only those is exact.

Defined results: rows whose vector is null, empty or holds a null or non-finite
component are dropped. All vectors have the length of the row with the smallest
id; rows of other lengths are dropped. A length that is no multiple of the
number of parts is padded with zeros. Scaled components beyond +-``bound(n)``
(2^27 for 64 dimensions) are clamped to it, so that every distance fits a long.
Rows without an id sort last among the seeds; repeated ids by their vectors.
With fewer rows than entries the codebook is as short as the rows. An empty
table gives an empty result. Other columns pass through, but for columns called
like an added one, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import kept_in_worker, unused

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
SMALL_TOTALS = 10_000  # so many label totals are broadcast; more are joined by a shuffle


def bound(dims: int) -> int:
    """The largest scaled component: (2 * bound)^2 * dims stays below 2^62."""
    return 1 << ((62 - max(1, dims - 1).bit_length()) // 2 - 1)


def scaled(vectors, dims: int, parts: int) -> np.ndarray:
    """Integers of a batch of vectors, shape (rows, parts, dimensions of a part)."""
    width = -(-dims // parts)
    out = np.zeros((len(vectors), width * parts), dtype=np.int64)
    if len(vectors):
        top = bound(dims)
        with np.errstate(over="ignore"):
            x = np.floor(np.stack(vectors).astype(np.float64) * SCALE)
        out[:, :dims] = np.clip(x, -top, top)
    return out.reshape(len(vectors), parts, width)


class Slices:
    """Sorted coordinates and prefix masks of one codebook."""

    def __init__(self, entries: np.ndarray):
        if not 0 < len(entries) <= 64:
            raise ValueError("a codebook has 1 to 64 entries")
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.coords = np.take_along_axis(entries, self.order, axis=0)
        bits = np.uint64(1) << self.order.astype(np.uint64)
        self.prefix = np.zeros((len(entries) + 1, entries.shape[1]), dtype=np.uint64)
        np.bitwise_or.accumulate(bits, axis=0, out=self.prefix[1:])
        self.widest = int(np.argmax(self.coords[-1] - self.coords[0]))

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """For each row a mask of entries that holds all nearest ones."""
        coords = self.coords[:, self.widest]
        right = np.searchsorted(coords, x[:, self.widest]).clip(0, len(coords) - 1)
        left = (right - 1).clip(0)
        nearer = np.abs(coords[left] - x[:, self.widest]) <= np.abs(coords[right] - x[:, self.widest])
        seed = self.order[np.where(nearer, left, right), self.widest]
        apart = x - self.entries[seed]
        radius = np.sqrt((apart * apart).sum(axis=1).astype(np.float64)).astype(np.int64) + 2
        mask = np.full(len(x), ~np.uint64(0))
        for j in range(x.shape[1]):
            low = np.searchsorted(self.coords[:, j], x[:, j] - radius, side="left")
            high = np.searchsorted(self.coords[:, j], x[:, j] + radius, side="right")
            mask &= self.prefix[high, j] ^ self.prefix[low, j]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row."""
        mask = self.candidates(x)
        index = np.zeros(len(x), dtype=np.int64)
        best = np.full(len(x), np.iinfo(np.int64).max)
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(mask & (np.uint64(1) << np.uint64(e)))
            apart = x[rows] - entry
            dist = (apart * apart).sum(axis=1)
            better = dist < best[rows]
            index[rows[better]], best[rows[better]] = e, dist[better]
        return index, best


@dataclass
class Codebooks:
    """``entries``: integers of shape (parts, entries, dimensions of a part)."""

    dims: int
    entries: np.ndarray

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position; padding is left out."""
        width = self.entries.shape[2]
        flat = [str(v) for p, part in enumerate(self.entries.tolist()) for entry in part
                for j, v in enumerate(entry) if p * width + j < self.dims]
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is there, not empty and all finite."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.coalesce(bad, F.lit(True)))


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS,
        entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of all usable rows; None if there are none.

    Each round is one job: tasks assign their rows and add them up, so that
    only ``entries * dimensions`` sums leave a task or reach the driver.
    """
    vectors = usable(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), "v")
    seeds = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    if not seeds:
        return None
    dims = len(seeds[0]["v"])
    vectors = vectors.where(F.size("v") == dims)
    seeds = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = Codebooks(dims, scaled([np.array(r["v"], dtype=np.float64) for r in seeds], dims, parts).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        _average(vectors.select("v"), books)
    return books


_SUMS = "part int, entry int, place int, total bigint, n bigint"


def _average(vectors: DataFrame, books: Codebooks) -> None:
    """One round: assign all parts, then replace the entries that were used."""
    shared = vectors.sparkSession.sparkContext.broadcast(books.entries)
    dims = books.dims

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = shared.value
        parts, k, width = now.shape
        slices = [Slices(e) for e in now]
        total, n = np.zeros(now.shape, dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
        for batch in batches:
            x = scaled(batch["v"].to_list(), dims, parts)
            for p in range(parts):
                index, _ = slices[p].nearest(x[:, p])
                n[p] += np.bincount(index, minlength=k)
                np.add.at(total[p], index, x[:, p])
        part, entry, place = np.indices(now.shape).reshape(3, -1)
        used = n[part, entry] > 0
        yield pd.DataFrame({"part": part, "entry": entry, "place": place, "total": total.ravel(), "n": n[part, entry]})[used]

    sums = (vectors.mapInPandas(run, _SUMS).groupBy("part", "entry", "place")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect())
    for r in sums:
        books.entries[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    shared.unpersist()


CODES = T.StructType([T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])


def encode(df: DataFrame, books: Codebooks, vec_col: str = "embedding", codes_col: str = "codes", error_col: str = "error") -> DataFrame:
    """Usable rows of ``df`` with the entry of each part and the squared
    distance summed over the parts."""
    key = books.sha256()
    shared = df.sparkSession.sparkContext.broadcast(books.entries)
    dims = books.dims

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        slices = kept_in_worker(key, lambda: [Slices(e) for e in shared.value])
        for vectors in batches:
            x = scaled(vectors.to_list(), dims, len(slices))
            found = [s.nearest(x[:, p]) for p, s in enumerate(slices)]
            codes = np.stack([i for i, _ in found], axis=1).astype(np.int32)
            yield pd.DataFrame({"codes": list(codes), "error": sum(d for _, d in found)})

    made = unused("coded", [*df.columns, codes_col, error_col])
    return (usable(df, vec_col).where(F.size(vec_col) == dims).withColumn(made, F.pandas_udf(run, CODES)(F.col(vec_col)))
            .withColumn(codes_col, F.col(made)["codes"]).withColumn(error_col, F.col(made)["error"]).drop(made))


def decode(df: DataFrame, books: Codebooks, codes_col: str = "codes", out_col: str = "decoded") -> DataFrame:
    """``df`` with the vector that the codes stand for."""
    rows = [[[v / SCALE for v in entry] for entry in part] for part in books.entries.tolist()]
    book = F.lit([[v for v in part] for part in rows])
    whole = F.flatten(F.transform(codes_col, lambda c, p: book[p][c]))
    return df.withColumn(out_col, F.slice(whole, 1, books.dims))


def with_group_error(df: DataFrame, label_col: str = "label", error_col: str = "error", out_col: str = "label_error") -> DataFrame:
    """``df`` with the error summed over the rows of the same label (null is a
    label). Tasks add up their rows first, so a label that holds most rows is
    one row a task; few totals are broadcast, many are joined by a shuffle."""
    label, there = unused("_label", df.columns), unused("_none", df.columns)
    totals = df.groupBy(F.col(label_col).alias(label)).agg(F.sum(error_col).alias(out_col)).withColumn(there, F.lit(True))
    few = totals.limit(SMALL_TOTALS + 1).count() <= SMALL_TOTALS
    base = df.drop(out_col) if out_col in df.columns else df
    return base.join(F.broadcast(totals) if few else totals, F.col(label_col).eqNullSafe(F.col(label))).drop(label, there)
