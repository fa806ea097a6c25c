"""Alignment of two tokenizers by pointer jumping.

A text is encoded by a byte-level BPE (A, with a blank in front) and by a
piece model with byte fallback (B, which puts the blank itself). Both token
sequences cover the same bytes. Every token points to the farthest-right token
of the other side that overlaps it, if that one ends behind it; where an A and
a B token end together, A points to B and B to itself. Doubling the successors
(``p = p[p]``, one vectorised step for all texts of a batch) leads every token
to the terminal token of its component: the groups between common ends.

A link is an A and a B token occurrence that end together. Corpus-wide counts
of linked id pairs are added up by batch and then by a shuffle; the
``HEAVY_PAIRS`` most frequent pairs are broadcast to look up the documents'
links, all other pairs go by a join.

Defined results: null and empty texts, and texts whose joined token bytes
differ from blank + text (for B: any text with U+2581, or one that the model's
normaliser changes), have no tokens: zeros and an empty ``groups``. Special
tokens in a text are plain text. Repeated rows are counted each. Empty tables
give empty results. Other columns pass through; a column called as the added
one is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import forget, kept_in_worker, unused, written

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
HEAVY_PAIRS = 250_000  # counts of so many pairs are broadcast: at most 17 bytes each
BATCH_CHARS = 1_000_000  # texts aligned at once, but for longer ones, which go alone
MEMO = 400_000
MEMO_CHARS = 64

# fixed values: the split of byte-level BPE before merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# letters and marks up to here have had the same classes in all versions of Unicode in use
_SETTLED = re.compile("[\x00-ɏ‐-‧]*")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print
    stand for themselves, the others for 256 and up in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(odd)}


class BytePairs:
    """Side A: a tokenizers file of a byte-level BPE.

    Texts of settled characters are encoded with the same vocabulary as merge
    ranks by tiktoken, which is several times faster and gives the same ids;
    all others by the file itself.
    """

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.whole.encode_special_tokens = True
        model = json.loads(spec)["model"]
        alphabet = byte_alphabet()
        vocab = model["vocab"]
        self.raw = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            if all(c in alphabet for c in token):
                self.raw[i] = bytes(alphabet[c] for c in token)
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ranked = [vocab[m] for m in merges]
        self.fast = None
        if ranked == sorted(ranked) and all(x in vocab for x in alphabet):
            ranks = {self.raw[vocab[t]]: vocab[t] for t in [*alphabet, *merges]}
            self.fast = tiktoken.Encoding("side-a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray | None:
        """Ids of the text; None if their bytes are not blank + text."""
        if self.fast is not None and _SETTLED.fullmatch(text):  # merges only join neighbouring bytes
            return self.fast.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        ids = np.array(self.whole.encode(" " + text, add_special_tokens=False).ids, dtype=np.int64)
        return ids if b"".join(map(self.raw.__getitem__, ids.tolist())) == (" " + text).encode() else None


class Pieces:
    """Side B: a piece model with byte fallback.

    No piece holds a blank behind another character or a line end, so a text
    falls apart at these places without changing its tokens, and equal parts are
    looked up in a bounded memo.
    """

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace("▁", " ").encode() for p in proto.pieces]
        norm = proto.normalizer_spec
        whole = any(re.search("[^▁]▁|\n", p.piece) for p in proto.pieces if p.type in (1, 4))
        self.splits = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not whole
        self.memo: dict[str, bytes | None] = {}
        self.line_end = self.model.encode("\n")[-1]

    def _learn(self, parts: list[str]) -> dict[str, bytes | None]:
        """Ids (bytes of int32) of parts without line ends; None if their bytes
        differ from the part. Parts are encoded together, a line end between two."""
        ids = np.array(self.model.encode("\n" + "\n".join(parts)), dtype=np.int32)
        cuts = np.append(np.flatnonzero(ids == self.line_end), len(ids))
        raw = [self.raw[x] for x in ids.tolist()]
        same = b"".join(raw[cuts[0] + 1:]) == "\n".join(parts).encode()
        out: dict[str, bytes | None] = {}
        at = ids.tobytes()
        for part, a, b in zip(parts, (cuts[:-1] + 1).tolist(), cuts[1:].tolist()):
            out[part] = at[4 * a:4 * b] if same or b"".join(raw[a:b]) == part.encode() else None
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text; None if their bytes are not blank + text."""
        if not self.splits:
            out = [np.array(x, dtype=np.int64) for x in self.model.encode(texts)]
            return [x if b"".join(map(self.raw.__getitem__, x.tolist())) == (" " + t).encode() else None for x, t in zip(out, texts)]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        memo.setdefault("\n", np.array([self.line_end], dtype=np.int32).tobytes())
        all_parts = [_PARTS.findall(" " + t) for t in texts]
        out, long = [], {}
        new = [p for p in set().union(*all_parts) if p not in memo]
        for i in range(0, len(new), 2_000):
            for part, ids in self._learn(new[i:i + 2_000]).items():
                (memo if len(part) <= MEMO_CHARS else long)[part] = ids
        for parts in all_parts:
            got = [memo[p] if p in memo else long[p] for p in parts] if long else list(map(memo.__getitem__, parts))
            out.append(None if None in got else np.frombuffer(b"".join(got), dtype=np.int32).astype(np.int64))
        return out


_PARTS = re.compile("\n| *[^ \n]+| +")


def jump(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token) for two sequences of
    ends (ascending, the last ones equal); groups are numbered from 0."""
    na, nb = len(ends_a), len(ends_b)
    if not na:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    size = int(ends_a[-1]) + 1
    before_a, before_b = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
    before_a[ends_a] = 1
    before_b[ends_b] = 1
    over_b = np.cumsum(before_b, out=before_b)[ends_a - 1]  # the B token over an A token's last byte
    over_a = np.cumsum(before_a, out=before_a)[ends_b - 1]
    p = np.empty(na + nb, dtype=np.int64)
    p[:na] = na + over_b
    p[na:] = np.where(ends_a[over_a] > ends_b, over_a, np.arange(na, na + nb))
    while True:
        further = p[p]
        if np.array_equal(further, p):
            break
        p = further
    number = np.cumsum(p[na:] == np.arange(na, na + nb)) - 1
    return number[p[:na] - na], number[p[na:] - na]


class Aligner:
    def __init__(self, spec: str, model: bytes):
        self.a, self.b = BytePairs(spec), Pieces(model)
        self.len_a = np.array([len(x) for x in self.a.raw])
        self.len_b = np.array([len(x) for x in self.b.raw])
        na, nb = len(self.a.raw), len(self.b.raw)
        # the written form of a token with what follows it
        self.forms = [f"{i}{s}" for s in ",|" for i in range(na)] + [f"{i}{s}" for s in (",", ";", "") for i in range(nb)]
        self.pieces = nb

    def align(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, groups, pairs, times) of each text; pairs are
        a * pieces + b in ascending order."""
        coded = {i: self.a.encode(t) for i, t in enumerate(texts) if t and "▁" not in t}
        coded = {i: (a, b) for (i, a), b in zip(coded.items(), self.b.encode([texts[i] for i in coded])) if a is not None and b is not None}
        live = list(coded)
        none = np.zeros(0, dtype=np.int64)
        out = [(0, 0, 0, "", none, none)] * len(texts)
        if not live:
            return out
        a, b = (np.concatenate([coded[i][s] for i in live]) for s in (0, 1))
        from_a, from_b = (np.cumsum([0, *(len(coded[i][s]) for i in live)]) for s in (0, 1))
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        group_a, group_b = jump(ends_a, ends_b)
        last_a = np.append(group_a[1:] != group_a[:-1], True)
        last_b = np.append(group_b[1:] != group_b[:-1], True)
        links = a[last_a] * self.pieces + b[last_b]  # one for each group: where both sides end
        from_g = np.append(group_b[from_b[:-1]], len(links))

        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        form = np.empty(len(a) + len(b), dtype=np.int64)
        form[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]] = a + np.where(last_a, len(self.a.raw), 0)
        follow = np.where(last_b, 1, 0)
        follow[from_b[1:] - 1] = 2
        form[np.arange(len(b)) + np.cumsum(size_a)[group_b]] = 2 * len(self.a.raw) + b + follow * self.pieces

        forms = self.forms.__getitem__
        for k, i in enumerate(live):
            at, end = from_a[k] + from_b[k], from_a[k + 1] + from_b[k + 1]
            pairs, times = np.unique(links[from_g[k]:from_g[k + 1]], return_counts=True)
            out[i] = (int(from_a[k + 1] - from_a[k]), int(from_b[k + 1] - from_b[k]), int(from_g[k + 1] - from_g[k]),
                      "".join(map(forms, form[at:end].tolist())), pairs, times)
        return out


ALIGNED = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("n_a", "n_b", "n_groups")] + [T.StructField("groups", T.StringType())]
    + [T.StructField(x, T.ArrayType(T.LongType())) for x in ("pairs", "times", "batch_pairs", "batch_times")])


def _shared(df: DataFrame, a: str, b: str):
    """Both vocabulary files (a few MB) to every worker."""
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        spec, model = f.read(), g.read()
    return df.sparkSession.sparkContext.broadcast((spec, model)), hashlib.sha256(spec.encode() + model).hexdigest()


def align(df: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, text_col: str = "text", out_col: str = "aligned") -> DataFrame:
    """``df`` with a struct: numbers of tokens and groups, the groups as text
    (``a1,a2|b1;a3|b2,b3``: ids of A and B in order), and the linked id pairs
    (a * size of B's vocabulary + b) with their number of links. ``batch_pairs``
    and ``batch_times`` hold, on one row of a batch of texts, the sums of the
    whole batch; they are null on the others."""
    shared, key = _shared(df, a, b)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        both = kept_in_worker(key, lambda: Aligner(*shared.value))
        for texts in batches:
            rows, part, chars = [], [], 0
            for t in texts:
                if part and chars + len(t or "") > BATCH_CHARS:
                    rows += both.align(part)
                    part, chars = [], 0
                part.append(t)
                chars += len(t or "")
            rows += both.align(part)
            out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "groups", "pairs", "times"])
            sums, counts = [None] * len(rows), [None] * len(rows)
            if rows:
                sums[0], where = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)
                counts[0] = np.bincount(where, weights=np.concatenate([r[5] for r in rows]), minlength=len(sums[0])).astype(np.int64)
            yield out.assign(batch_pairs=pd.Series(sums, dtype=object), batch_times=pd.Series(counts, dtype=object))

    return df.withColumn(out_col, F.pandas_udf(run, ALIGNED)(F.col(text_col)))


def pair_counts(aligned: DataFrame, pieces: int, col: str = "aligned") -> DataFrame:
    """(pair, n, best) of all linked id pairs: links corpus-wide, and whether
    no other pair of the same B id has more. Batches are added up first; a B id
    has at most as many pairs as A has ids."""
    each = aligned.where(F.col(f"{col}.batch_pairs").isNotNull()).select(
        F.explode(F.arrays_zip(F.col(f"{col}.batch_pairs").alias("p"), F.col(f"{col}.batch_times").alias("t"))).alias("x"))
    counts = each.groupBy(F.col("x.p").alias("pair")).agg(F.sum("x.t").alias("n"))
    b = F.col("pair") % F.lit(pieces)
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(top, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


LOOKED_UP = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("n_best", "count_sum")]
    + [T.StructField(x, T.ArrayType(T.LongType())) for x in ("pairs", "times")])


def _looked_up(df: DataFrame, heavy, col: str, out: str) -> DataFrame:
    """Sums over the links whose pairs are broadcast; the others are left as arrays."""
    shared = df.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, n, best = shared.value
        for batch in batches:
            rows = []
            for p, t in zip(batch["pairs"], batch["times"]):
                at = np.searchsorted(pairs, p).clip(0, max(0, len(pairs) - 1))
                there = pairs[at] == p if len(pairs) else np.zeros(len(p), dtype=bool)
                at, k = at[there], t[there]
                rows.append((int(k[best[at]].sum()), int((k * n[at]).sum()), p[~there], t[~there]))
            yield pd.DataFrame(rows, columns=["n_best", "count_sum", "pairs", "times"])

    return df.withColumn(out, F.pandas_udf(run, LOOKED_UP)(F.struct(F.col(f"{col}.pairs").alias("pairs"), F.col(f"{col}.times").alias("times"))))


def with_link_counts(aligned: DataFrame, b: str = TOKENIZER_B, col: str = "aligned", heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """``aligned`` (of ``align``) with n_links, n_best and count_sum of each row.

    The rows are written once (all but what was dropped before), since counts
    need the whole corpus before the first row can be finished.
    """
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=b).get_piece_size()
    row, got, key = (unused(x, aligned.columns) for x in ("_row", "_got", "_key"))
    base = written(aligned.withColumn(row, F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(base, pieces, col), "pair-counts")
    top = counts.orderBy(F.col("n").desc(), "pair").limit(heavy_pairs).orderBy("pair").toArrow()
    heavy = tuple(top[x].to_numpy() for x in ("pair", "n", "best"))
    names = [x for x in aligned.columns if x.lower() not in (col.lower(), "n_links", "n_best", "count_sum")]
    found = written(_looked_up(base, heavy, col, got).select(
        *names, F.col(col).dropFields("pairs", "times", "batch_pairs", "batch_times").alias(col), row, got,
        F.aggregate(f"{col}.times", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_links")), "looked-up")
    forget(base)
    rest = (found.select(F.col(row).alias(key), F.explode(F.arrays_zip(F.col(f"{got}.pairs").alias("p"), F.col(f"{got}.times").alias("t"))).alias("x"))
            .select(key, F.col("x.p").alias("pair"), F.col("x.t").alias("t")).join(counts, "pair").groupBy(key)
            .agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum")))
    both = found.join(rest, F.col(row) == F.col(key), "left")
    return both.select(*names, col, "n_links", *[(F.col(f"{got}.{x}") + F.coalesce(rest[x], F.lit(0))).alias(x) for x in ("n_best", "count_sum")])
