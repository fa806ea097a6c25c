"""SentencePiece encoding and decoding by an Aho-Corasick-driven Viterbi.

The pieces of a model file are loaded into one automaton. A text is encoded in
a single pass: at each end position the automaton (its state and, through the
output links, every shorter piece that ends there) relaxes the best score
``best[end] = max(best[end - len(piece)] + score)``; walking the choices back
gives the pieces. This is the unigram rule of SentencePiece: the segmentation
with the highest sum of scores. It reads pieces and scores of any model file; for a
file trained for BPE the result is the best path over these pieces (tested
against every segmentation), not the result of BPE merges.

Normalisation is the identity with a dummy prefix: a blank is put before a
non-empty text and blanks become U+2581. Characters outside the pieces become
byte pieces (``<0xNN>``), or the unknown piece if the model has no bytes. A
U+2581 that stands in the text itself is encoded as its bytes, so decoding
gives back every text exactly.

No piece holds a blank after another character, so a text falls apart at these
places without changing the best segmentation; equal parts are looked up in a
bounded memo instead of being decoded again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import kept_in_worker, unused

BLANK = "▁"
MEMO = 500_000  # distinct parts kept by a worker
MEMO_CHARS = 64  # longer parts are rare and not kept
UNK_PENALTY = 10.0
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.surface: list[str | int | None] = []  # text of a piece, a byte's value, or None for control pieces
        self.bytes: dict[int, int] = {}
        self.unk = proto.trainer_spec.unk_id
        automaton = ahocorasick.Automaton()
        chars: set[str] = set()  # of all pieces
        scores = []
        self.splits = True
        for i, p in enumerate(proto.pieces):
            if p.type in (1, 4):  # normal, user defined
                automaton.add_word(p.piece, (i, float(p.score), len(p.piece)))
                self.surface.append(p.piece)
                scores.append(p.score)
                chars.update(p.piece)
                if re.search(f"[^{BLANK}]{BLANK}", p.piece):
                    self.splits = False
            elif p.type == 6:
                value = int(p.piece[3:5], 16)
                self.bytes[value] = i
                self.surface.append(value)
            else:
                self.surface.append(None)
        self.unk_score = (min(scores) if scores else 0.0) - UNK_PENALTY
        self.automaton = automaton
        if scores:
            automaton.make_automaton()
        self.loaded = bool(scores)
        self.single = frozenset(x for x in self.surface if isinstance(x, str) and len(x) == 1)
        self.packed = [np.int32(i).tobytes() for i in range(len(self.surface))]
        # what each id stands for in UTF-8
        self.raw = [bytes([x]) if isinstance(x, int) else x.replace(BLANK, " ").encode() if x else b"" for x in self.surface]
        if 0 <= self.unk < len(self.raw):
            self.raw[self.unk] = " \u2047 ".encode()
        self.fallback = len(self.bytes) == 256
        # line ends are parts of their own unless a piece holds one
        self.parts = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+" if "\n" not in chars else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.memo: dict[str, bytes] = {}

    def _unknown(self, ch: str) -> bytes:
        ids = [self.bytes[b] for b in ch.encode()] if self.fallback else [self.unk]
        return np.array(ids, dtype=np.int32).tobytes()

    def _viterbi(self, s: str) -> bytes:
        """Ids (as bytes of int32) of the best segmentation of ``s``."""
        n = len(s)
        best = [0.0] + [-np.inf] * n
        last: list = [None] * (n + 1)  # (id, score, length) of the piece that ends there; None: unknown
        odd = [k + 1 for k, ch in enumerate(s) if ch not in self.single]  # ends of characters that are no pieces
        todo = 0
        for end, piece in (self.automaton.iter(s) if self.loaded else ()):
            end += 1
            while todo < len(odd) and odd[todo] < end:
                self._relax_unknown(best, last, odd[todo])
                todo += 1
            score = best[end - piece[2]] + piece[1]
            if score > best[end]:
                best[end], last[end] = score, piece
        for k in odd[todo:]:
            self._relax_unknown(best, last, k)
        out, at = [], n
        while at:
            piece = last[at]
            if piece is None:
                out.append(self._unknown(s[at - 1]))
                at -= 1
            else:
                out.append(self.packed[piece[0]])
                at -= piece[2]
        return b"".join(reversed(out))

    def _relax_unknown(self, best: list, last: list, end: int) -> None:
        score = best[end - 1] + self.unk_score
        if score > best[end]:
            best[end], last[end] = score, None

    def _part(self, s: str) -> bytes:
        got = self.memo.get(s)
        if got is None:
            got = self._viterbi(s)
            if len(s) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[s] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        out: list[bytes] = []
        for k, run in enumerate(text.split(BLANK) if text else ()):
            if k:  # a literal U+2581 is kept apart from blanks by its bytes
                out.append(self._unknown(BLANK))
            s = run.replace(" ", BLANK) if k else BLANK + run.replace(" ", BLANK)
            if not s:
                continue
            memo, part = self.memo.get, self._part
            out.extend([memo(p) or part(p) for p in (self.parts.findall(s) if self.splits else (s,))])
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids) -> str:
        """The text of ``ids``; invalid byte runs become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, np.asarray(ids).tolist())).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def _model(df: DataFrame, path: str):
    """The model file's bytes (below a few MB: a vocabulary) to every worker."""
    import hashlib

    raw = open(path, "rb").read()
    return df.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()


def encode(df: DataFrame, model: str = DEFAULT_MODEL, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with the piece ids of each whole text in ``out_col`` (array of
    int). Null and empty texts have no ids. Other columns pass through; a
    column already named ``out_col`` is replaced."""
    shared, key = _model(df, model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = kept_in_worker(key, lambda: Codec(shared.value))
        for texts in batches:
            yield pd.Series([c.encode(t) for t in texts], dtype=object)

    return df.withColumn(out_col, F.pandas_udf(run, T.ArrayType(T.IntegerType()))(F.col(text_col)))


def decode(df: DataFrame, model: str = DEFAULT_MODEL, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col`` in ``out_col``; null or empty ids give an empty text."""
    shared, key = _model(df, model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = kept_in_worker(key, lambda: Codec(shared.value))
        for ids in batches:
            yield pd.Series(["" if x is None else c.decode(x) for x in ids], dtype=object)

    return df.withColumn(out_col, F.pandas_udf(run, T.StringType())(F.col(ids_col)))


CODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])


def encode_checked(df: DataFrame, model: str = DEFAULT_MODEL, text_col: str = "text",
                   ids_col: str = "ids", check_col: str = "round_trip") -> DataFrame:
    """``df`` with the piece ids of each whole text and whether decoding them
    gives the text back (a null text: an empty one). Both are done in one pass,
    so that a task needs one worker with one automaton. Other columns pass
    through, but for two called as the added ones, which are replaced."""
    shared, key = _model(df, model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = kept_in_worker(key, lambda: Codec(shared.value))
        for texts in batches:
            ids = [c.encode(t) for t in texts]
            same = [c.decode(i) == (t or "") for i, t in zip(ids, texts)]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "round_trip": pd.Series(same, dtype=bool)})

    coded = unused("coded", [*df.columns, ids_col, check_col])
    return (df.withColumn(coded, F.pandas_udf(run, CODED)(F.col(text_col)))
            .withColumn(ids_col, F.col(coded)["ids"]).withColumn(check_col, F.col(coded)["round_trip"]).drop(coded))


def round_trips(decoded: Column, text: Column) -> Column:
    return decoded == F.coalesce(text, F.lit(""))
