"""Statements of scripts that are too large for one task.

``scripts.split_script`` reads a script from its first character to its last.
Here a script comes as chunks of whole lines, and each chunk is read on its
own, twice:

1. for every state the chunk could be entered with, the state it is left with
   (one *map* a chunk). Between two lines a script is in plain text, in a quoted
   text or in a comment; no statement is open, or one without or with text; and a
   terminator holds. Terminators that do not occur in the chunk all act
   alike, so they share one entry of the map.
2. with the state it really is entered with, which follows from the maps of the
   chunks before it by composition (blocks of maps first, then the blocks).

Statements that begin and end in one chunk come out of step 2 as they are; the
pieces of the others are put together by the number of the statement.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .scripts import (_BLANKS, _EOL, BATCH_BYTES, CHARSET_SCAN_LINES, ROWS_PER_FRAME, STATEMENT_SCHEMA, _grammar, _readable, codec_for,
                      script_charset, small_batches)

CHUNK_BYTES = 1 << 20
BLOCK = 1024  # maps that one task composes
BOM = b"\xef\xbb\xbf"
PLAIN, QUOTED, COMMENT = "plain", "quoted", "comment"
CLOSED, BLANK, SOLID = 0, 1, 2  # the open statement: none, without text so far, with text
ENTRIES = [(PLAIN, CLOSED), (PLAIN, BLANK), (PLAIN, SOLID), (QUOTED, SOLID), (COMMENT, CLOSED), (COMMENT, BLANK), (COMMENT, SOLID)]
START = (PLAIN, CLOSED, ";")

_TERM = re.compile(r"(?=SET[ \t]+TERM[ \t]+(\S+))", re.IGNORECASE)
# fixed values: what Python's str.strip takes for blank
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000)))


# ---- chunks of files -----------------------------------------------------------------

def _gather(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, piece, held, size = None, 0, [], 0

        def flush():
            return pd.DataFrame({"path": [at[0]], "block": [at[1]], "piece": [piece], "content": [b"".join(held)]})

        for pdf in batches:
            for path, block, line in zip(pdf["path"], pdf["block"], pdf["line"]):
                if (path, block) != at or size >= limit:
                    if held:
                        yield flush()
                    piece, held, size = (piece + 1 if (path, block) == at else 0), [], 0
                    at = (path, block)
                held += (bytes(line), b"\n")
                size += len(line) + 1
        if held:
            yield flush()
    return run


def file_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, chunk, content): the files under ``path`` as chunks of about
    ``chunk_bytes`` bytes that end with a line. Spark cuts large files into ranges
    read by different tasks; no task holds more than a chunk or a line. A byte
    order mark and a missing last line end, which the line reader hides, are
    restored by the size of the file. Spark lists no empty files, so they have
    no chunk. The chunks are checkpointed, as they are read more than once."""
    ensure_checkpoint_dir(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))
    sizes = lines.groupBy("path").agg((F.max("size") - F.sum(F.octet_length("line") + 1)).alias("hidden"), F.max("block").alias("last_block"))
    pieces = lines.select("path", "block", "line").mapInPandas(_gather(chunk_bytes), "path string, block bigint, piece bigint, content binary")
    pieces = pieces.checkpoint(eager=True)
    order = Window.partitionBy("path").orderBy("block", "piece")
    numbered = (pieces.select("path", "block", "piece").withColumn("chunk", F.row_number().over(order).cast("bigint") - 1)
                .withColumn("last", F.lead("piece").over(order).isNull()).join(sizes, "path"))
    body = F.when(F.col("last") & F.col("hidden").isin(-1, 2), F.expr("substring(content, 1, octet_length(content) - 1)")).otherwise(F.col("content"))
    body = F.when((F.col("chunk") == 0) & (F.col("hidden") >= 2), F.concat(F.lit(BOM), body)).otherwise(body)
    return pieces.join(numbered, ["path", "block", "piece"]).select("path", "chunk", body.alias("content")).checkpoint(eager=True)


# ---- one chunk ------------------------------------------------------------------------

class _Reader:
    """Reads one chunk from a state; ``pieces`` gathers its statements."""

    def __init__(self, text: str, state: tuple[str, int, str], last: bool = True):
        self.text, self.last = text, last
        self.mode, self.open, self.terminator = state
        self.pieces: list[tuple[int, int | None, int | None, str, bool]] = []  # index, solid index, line, text, whole
        self.parts: list[str] = []
        self.index = self.solid = 0
        self.solid_no: int | None = None
        self.start: int | None = None
        self.line, self.busy, self.seen = 1, 0, 0

    def cover(self, piece: str) -> int:
        """Count the lines that ``piece`` stands on; the line it ends on."""
        end = self.line + len(_EOL.findall(piece))
        if self.mode != PLAIN and not self.last:
            end -= 1  # the next chunk counts the line that it begins with
        self.busy += max(0, end - max(self.line - 1, self.seen))
        self.seen = max(self.seen, end)
        return end

    def take(self, piece: str) -> None:
        if self.open == CLOSED:
            self.open, self.start = BLANK, self.line
            self.index += 1
        if self.open == BLANK and piece.strip():
            self.open = SOLID
            self.solid += 1
            self.solid_no = self.solid
        self.parts.append(piece)

    def emit(self, ended: bool) -> None:
        text, whole = "".join(self.parts), ended and self.start is not None
        if whole:
            text = text.strip()
        if text and (not whole or self.solid_no):
            self.pieces.append((self.index, self.solid_no, self.start, text, whole))
        self.parts, self.start, self.solid_no = [], None, None

    def read(self, known: dict | None = None) -> tuple[str, int, str]:
        """The state behind the chunk. ``known``: states behind the chunk by place
        and state between lines; reading stops at a place that was met before."""
        text, at, met = self.text, 0, []
        if self.mode != PLAIN:
            mark = "'" if self.mode == QUOTED else "*/"
            to = text.find(mark)
            at = len(text) if to < 0 else to + len(mark)
            if to >= 0:
                mode, self.mode = self.mode, PLAIN
            else:
                mode = self.mode
            if mode == QUOTED:
                self.take(text[:at])
            self.line = self.cover(text[:at])
        directive, token = _grammar(self.terminator)
        end_state = None
        while at < len(text):
            if self.open == CLOSED and (m := directive.match(text, at)):
                at = m.end()
                if named := m["terminator"]:
                    self.terminator = named.removesuffix(self.terminator) or named
                    directive, token = _grammar(self.terminator)
                continue
            m = token.match(text, at)
            at, piece, kind = m.end(), m[0], m.lastgroup
            if kind == "eol":
                if self.open != CLOSED:
                    self.cover("")
                    self.take("\n")
                self.line += 1
                if known is not None:
                    key = (at, self.open, self.terminator)
                    if key in known:
                        end_state = known[key]
                        break
                    met.append(key)
                continue
            if kind == "plain" and self.open == CLOSED:
                piece = piece.lstrip(_BLANKS)
                if not piece:
                    continue
            if kind == "end":
                self.cover(piece)
                if self.open != CLOSED:
                    self.emit(True)
                    self.open = CLOSED
                continue
            if at == len(text):  # only here can a quoted text or a comment be left open
                if kind == "quoted" and piece[0] == "'" and (len(piece) < 2 or piece[-1] != "'"):
                    self.mode = QUOTED
                elif kind == "remark" and piece[:2] == "/*" and (len(piece) < 4 or piece[-2:] != "*/"):
                    self.mode = COMMENT
            if kind == "remark":
                # a piece before this chunk ends with a line end or a blank
                if self.open != CLOSED and self.parts and not self.parts[-1][-1].isspace():
                    self.take(" ")
            else:
                self.take(piece)
            self.line = self.cover(piece)
        if end_state is None:
            end_state = (self.mode, self.open, self.terminator)
            if self.open != CLOSED:
                self.emit(False)
        if known is not None:
            known.update((k, end_state) for k in met)
        return end_state


def terminators(words: list[str]) -> list[str]:
    """What may hold as terminator where ``words`` follow SET TERM: a word, or
    what is left of it without the terminator that held before."""
    found = {";"}
    while True:
        more = {w.removesuffix(t) or w for w in words for t in found} - found
        if not more:
            return sorted(found)
        found |= more


def chunk_map(text: str, candidates: list[str]) -> dict:
    """{(mode, open, terminator or None): state}; None stands for every
    terminator that does not occur in the chunk, on entry and behind it."""
    absent = "\ue000"
    while absent in text:
        absent += "\ue000"
    out, known = {}, {}
    for term in [absent, *(c for c in candidates if c in text)]:
        for mode, open_ in ENTRIES:
            m, o, t = _Reader(text, (mode, open_, term)).read(known)
            out[mode, open_, None if term == absent else term] = (m, o, None if t == absent else t)
    return out


def step(mapping: dict, state: tuple) -> tuple:
    mode, open_, term = state
    if state in mapping and term is not None:
        return mapping[state]
    m, o, t = mapping[mode, open_, None]
    return m, o, term if t is None else t


def compose(maps: list[dict]) -> dict:
    """The map of chunks that follow one another."""
    out = {}
    for term in {t for m in maps for _, _, t in m}:
        for mode, open_ in ENTRIES:
            state = (mode, open_, term)
            for m in maps:
                state = step(m, state)
            out[mode, open_, term] = state
    return out


def _pack(mapping: dict) -> str:
    return json.dumps([[*k, *v] for k, v in mapping.items()])


def _unpack(text: str) -> dict:
    return {tuple(r[:3]): tuple(r[3:]) for r in json.loads(text)}


def _decoded(content, charset: str, marked: bool, first: bool) -> str:
    codec = "utf-8" if marked else codec_for(charset)
    if "\n".encode(codec) != b"\n":
        raise ValueError(f"{charset}: this character set does not part at line ends; take script_statements")
    data = bytes(content or b"")
    return data[len(BOM) if marked and first else 0:].decode(codec, errors="surrogateescape")


# ---- all chunks -----------------------------------------------------------------------

def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "chunk": pdf["chunk"], "words": [
            sorted(set(_TERM.findall(_decoded(c, s, b, n == 0)))) for c, s, b, n in zip(pdf["content"], pdf["charset"], pdf["marked"], pdf["chunk"])]})


def _maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(p, n, _pack(chunk_map(_decoded(c, s, b, n == 0), terminators(list(w)))))
                for p, n, c, s, b, w in zip(pdf["path"], pdf["chunk"], pdf["content"], pdf["charset"], pdf["marked"], pdf["words"])]
        yield pd.DataFrame(rows, columns=["path", "chunk", "map"])


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    return pd.DataFrame({"path": [pdf["path"].iloc[0]], "block": [pdf["block"].iloc[0]], "map": [_pack(compose([_unpack(m) for m in pdf["map"]]))]})


def _entered(place: str):
    """Maps in order and the state before the first -> the state before each."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(place)
        state, out = tuple(json.loads(pdf["first"].iloc[0])), []
        for m in pdf["map"]:
            out.append(json.dumps(state))
            state = step(_unpack(m), state)
        return pd.DataFrame({"path": pdf["path"], place: pdf[place], "entry": out})
    return run


PIECE_SCHEMA = ("path string, chunk bigint, idx bigint, solid bigint, line bigint, text string, whole boolean, error string, "
                "n_open bigint, n_solid bigint, eols bigint, busy bigint, tail bigint")


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, rows, size = [f.split()[0] for f in PIECE_SCHEMA.split(", ")], [], 0
    for pdf in batches:
        for path, n, content, charset, marked, entry, last in zip(*(pdf[c] for c in ("path", "chunk", "content", "charset", "marked", "entry", "last"))):
            text = _decoded(content, charset, marked, n == 0)
            reader = _Reader(text, tuple(json.loads(entry)), last)
            reader.read()
            for idx, solid, line, piece, whole in reader.pieces:
                shown, error = _readable(piece)
                rows.append((path, n, idx, solid, line, shown, whole, error, None, None, None, None, None))
                size += len(shown)
                if len(rows) >= ROWS_PER_FRAME or size >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names).astype(object)
                    rows, size = [], 0
            tail = int(text != "" and text[-1] not in "\r\n")
            rows.append((path, n, -1, None, None, None, None, None, reader.index, reader.solid, len(_EOL.findall(text)), reader.busy, tail))
    if rows:
        yield pd.DataFrame(rows, columns=names).astype(object)


def chunk_statements(chunks: DataFrame) -> DataFrame:
    """S05 for scripts of any size: (path, chunk, content) -> the rows of
    ``scripts.script_statements``, equal to those of the whole content.

    Chunks are numbered from 0 in the order of the script (gaps are allowed, chunk 0
    is the first) and end with ``\\n``, but for the last; null content is
    empty. What is gathered in one task is a row of counts a chunk of one
    file, ``BLOCK`` maps, a row a block of one file, the distinct words that follow
    SET TERM in a file (a script has a few), and the text of one statement.
    """
    spark = chunks.sparkSession
    ensure_checkpoint_dir(spark)
    small_batches(spark)
    chunks = chunks.select("path", "chunk", "content")
    order = Window.partitionBy("path").orderBy("chunk")
    text = F.decode("content", "ISO-8859-1")
    # seq is the place among the chunks of the file; the head is what the character set is looked for in
    counts = (chunks.select("path", "chunk", F.coalesce(F.regexp_count(text, F.lit("\n")), F.lit(0)).alias("n"),
                            F.coalesce(F.col("content").startswith(F.lit(BOM)) & (F.col("chunk") == 0), F.lit(False)).alias("marked"))
              .withColumn("seq", F.row_number().over(order).cast("bigint") - 1).withColumn("last", F.lead("chunk").over(order).isNull())
              .withColumn("before", F.sum("n").over(order) - F.col("n")).checkpoint(eager=True))
    near = counts.where(F.col("before") < CHARSET_SCAN_LINES).select("path", "chunk")
    first_lines = F.regexp_replace(F.substring_index(text, "\n", CHARSET_SCAN_LINES), "\n\\z", "")
    heads = (chunks.join(near, ["path", "chunk"]).select("path", "chunk", F.coalesce(first_lines, F.lit("")).alias("head")).groupBy("path")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "head"))), lambda x: x["head"]), "\n").alias("head")))
    head = F.encode("head", "ISO-8859-1")
    known = counts.join(heads.select("path", script_charset(head).alias("charset")), "path")
    marked = F.max("marked").over(Window.partitionBy("path"))
    known = known.select("path", "chunk", "seq", "last", "charset", marked.alias("marked")).checkpoint(eager=True)
    read = chunks.join(known, ["path", "chunk"])
    words = read.select("path", "chunk", "content", "charset", "marked").mapInPandas(_words, "path string, chunk bigint, words array<string>")
    named = words.select("path", F.explode("words").alias("word")).distinct().groupBy("path").agg(F.collect_set("word").alias("words"))
    known = known.join(named, "path", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    maps = (chunks.join(known, ["path", "chunk"]).select("path", "chunk", "content", "charset", "marked", "words")
            .mapInPandas(_maps, "path string, chunk bigint, map string"))
    maps = (maps.join(known.select("path", "chunk", "seq"), ["path", "chunk"]).withColumn("block", F.floor(F.col("seq") / BLOCK).cast("bigint"))
            .checkpoint(eager=True))
    blocks = maps.groupBy("path", "block").applyInPandas(_composed, "path string, block bigint, map string")
    begun = (blocks.withColumn("first", F.lit(json.dumps(START))).groupBy("path")
             .applyInPandas(_entered("block"), "path string, block bigint, entry string").withColumnRenamed("entry", "first"))
    entries = (maps.join(begun, ["path", "block"]).groupBy("path", "block")
               .applyInPandas(_entered("chunk"), "path string, chunk bigint, entry string"))
    cut = (chunks.join(known.drop("words"), ["path", "chunk"]).join(entries, ["path", "chunk"])
           .select("path", "chunk", "content", "charset", "marked", "entry", "last").mapInPandas(_cut, PIECE_SCHEMA).checkpoint(eager=True))

    def earlier(c: str):
        return F.sum(c).over(order) - F.col(c)

    whole_file = Window.partitionBy("path")
    stats = cut.where("idx < 0").select(
        "path", "chunk", earlier("n_open").alias("opened"), earlier("n_solid").alias("solid_before"), earlier("eols").alias("lines_before"),
        (F.sum("eols").over(whole_file) + F.max_by("tail", "chunk").over(whole_file)).alias("lines_read"),
        F.sum("busy").over(whole_file).alias("lines_processed"), F.sum("n_solid").over(whole_file).alias("n_statements"))
    stats = stats.join(known.select("path", "chunk", "charset"), ["path", "chunk"])
    pieces = (cut.where("idx >= 0").select("path", "chunk", "idx", "solid", "line", "text", "whole", "error").join(stats, ["path", "chunk"])
              .withColumn("stmt_no", F.col("solid_before") + F.col("solid")).withColumn("start_line", F.col("lines_before") + F.col("line")))
    same = ["path", "charset", "lines_read", "lines_processed"]
    complete = pieces.where("whole").select(*same, "stmt_no", "start_line", F.col("text").alias("sql_text"), F.col("error").alias("decode_error"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "")
    crossing = (pieces.where("not whole").groupBy(*same, (F.col("opened") + F.col("idx")).alias("g"))
                .agg(F.max("stmt_no").alias("stmt_no"), F.min("start_line").alias("start_line"),
                     F.trim(joined, F.lit(SPACES)).alias("sql_text"), F.max("error").alias("decode_error"))
                .where("stmt_no is not null").drop("g"))
    nothing = stats.where("n_statements = 0").groupBy(*same).agg(
        F.lit(0).cast("bigint").alias("stmt_no"), F.lit(0).cast("bigint").alias("start_line"),
        F.lit(None).cast("string").alias("sql_text"), F.lit(None).cast("string").alias("decode_error"))
    return complete.unionByName(crossing).unionByName(nothing).select(*STATEMENT_SCHEMA.names)
