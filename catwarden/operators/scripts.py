"""SQL script corpora as DataFrames.

A corpus is ``(path, content)`` rows — what ``spark.read.format("binaryFile")``
returns. Statement splitting is stateful inside a file (string, comment and
``SET TERM`` delimiter state), so the unit of parallelism is the file: each
file is one row and ``mapInPandas`` splits it inside a task. Everything else
(charset sniffing, classification, profiling) is built-in expressions.
"""

from __future__ import annotations

import functools
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Charset names (SET NAMES) -> Python codec.
CHARSET_CODECS = {
    "WIN1252": "cp1252",
    "ISO8859_1": "latin-1",
    "ISO-8859-1": "latin-1",
    "UTF8": "utf-8",
    "UTF-8": "utf-8",
}
CHARSET_SCAN_LINES = 200
# Characters ignored at the start of a line when looking for
# blank lines and SET directives.
LEAD_CHARS = "\ufeff\u200b\u00a0\u2060 \t"

STATEMENT_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("charset", T.StringType()),
    T.StructField("stmt_no", T.LongType()),
    T.StructField("start_line", T.LongType()),
    T.StructField("sql_text", T.StringType()),
    T.StructField("decode_error", T.StringType()),
    T.StructField("lines_read", T.LongType()),
    T.StructField("lines_processed", T.LongType()),
])


# ---- S06: charset ------------------------------------------------------------------

def script_charset(content: Column) -> Column:
    """First ``SET NAMES x`` among the first 200 lines, upper-cased, else UTF8.
    Bytes are viewed as ISO-8859-1 (one char per byte) for the sniff."""
    text = F.decode(content, "ISO-8859-1")
    text = F.regexp_replace(text, "^ï»¿", "")  # UTF-8 byte order mark
    lines = F.slice(F.split(text, r"\r\n|\n|\r", CHARSET_SCAN_LINES + 1), 1, CHARSET_SCAN_LINES)
    hits = F.filter(lines, lambda l: F.upper(F.regexp_replace(l, r"^\s+", "")).startswith("SET NAMES")
                    & (F.size(F.split(F.trim(l), " +")) >= 3))
    first = F.try_element_at(hits, F.lit(1))
    name = F.upper(F.trim(F.replace(F.try_element_at(F.split(F.trim(first), " +"), F.lit(3)), F.lit(";"), F.lit(""))))
    return F.coalesce(name, F.lit("UTF8"))


def codec_for(charset: str | None) -> str:
    if not charset or not charset.strip():
        return "utf-8"
    name = charset.strip().upper()
    if name in CHARSET_CODECS:
        return CHARSET_CODECS[name]
    try:
        import codecs
        return codecs.lookup(name).name
    except LookupError:
        return "utf-8"


def decode_script(data: bytes, charset: str | None) -> str:
    """The script's text. A byte that is not valid in the character set stands
    in it as a lone surrogate, which marks the statement that holds it."""
    codec = codec_for(charset)
    if data.startswith(b"\xef\xbb\xbf"):
        data, codec = data[3:], "utf-8"
    return data.decode(codec, errors="surrogateescape")


# ---- S05: statements -----------------------------------------------------------------

_EOL = re.compile(r"\r\n|\n|\r")
_BLANKS = LEAD_CHARS + "\f\v"
_NOT_DECODED = re.compile("[\udc80-\udcff]")
ROWS_PER_FRAME = 5_000
BATCH_BYTES = 4 << 20  # of files or statements that a Python worker holds at a time, and of the text of a frame


class Script(NamedTuple):
    statements: list[tuple[int, int, str]]  # number, line of its first character, text
    lines_read: int
    lines_processed: int  # lines that hold a part of a statement or a comment


@functools.lru_cache(maxsize=64)
def _grammar(terminator: str) -> tuple[re.Pattern, re.Pattern]:
    """(directive that may stand between statements, token) under a terminator."""
    end, first = re.escape(terminator), re.escape(terminator[0])
    directive = re.compile(
        rf"[{_BLANKS}]*SET[ \t]+(?:TERM[ \t]+(?P<terminator>\S+)(?:[ \t]*{end})?"
        rf"|(?:SQL[ \t]+DIALECT|NAMES)\b(?:(?!{end})[^\r\n])*(?:{end})?)", re.IGNORECASE)
    token = re.compile(
        rf"(?P<quoted>'[^']*(?:'|\Z)|\"[^\"\r\n]*\")|(?P<remark>--[^\r\n]*|/\*(?s:.*?)(?:\*/|\Z))"
        rf"|(?P<eol>\r\n|\n|\r)|(?P<end>{end})|(?P<plain>[^'\"/\-\r\n{first}]+|.)")
    return directive, token


def split_script(text: str) -> Script:
    """The statements of a script, cut at its terminator (``;`` until ``SET
    TERM`` names another, of any length).

    Quoted text is kept as it is, line ends included; line ends elsewhere
    become ``\\n``; a comment counts as a blank. ``SET TERM``, ``SET SQL
    DIALECT`` and ``SET NAMES`` are directives where a statement could begin
    and text elsewhere. What follows the last terminator is a statement too.
    """
    terminator, at, line, start = ";", 0, 1, 0
    directive, token = _grammar(terminator)
    found: list[tuple[int, int, str]] = []
    parts: list[str] = []  # of the statement that is open
    busy = seen = 0  # lines with work, the last of them

    def finish() -> None:
        sql = "".join(parts).strip()
        if sql:
            found.append((len(found) + 1, start, sql))
        parts.clear()

    while at < len(text):
        if not parts and (m := directive.match(text, at)):
            at = m.end()
            if named := m["terminator"]:
                terminator = named.removesuffix(terminator) or named
                directive, token = _grammar(terminator)
            continue
        m = token.match(text, at)
        at, piece, kind = m.end(), m[0], m.lastgroup
        if not parts and kind == "plain":
            piece = piece.lstrip(_BLANKS)
            if not piece:
                continue
        if kind == "eol" and not parts:
            line += 1
            continue
        last = line + (len(_EOL.findall(piece)) if kind in ("quoted", "remark") else 0)
        busy += last - max(line - 1, seen)
        seen = last
        if kind == "end":
            finish()
        elif kind == "remark":
            if parts and not parts[-1][-1].isspace():
                parts.append(" ")
        else:
            if not parts:
                start = line
            parts.append("\n" if kind == "eol" else piece)
        line = last + (kind == "eol")
    finish()
    n_lines = len(_EOL.findall(text)) + (text != "" and text[-1] not in "\r\n")
    return Script(found, n_lines, busy)


def _readable(sql: str) -> tuple[str, str | None]:
    """(text, error): bytes that could not be decoded are spelled out, and the error says so."""
    if not _NOT_DECODED.search(sql):
        return sql, None
    return (sql.encode("utf-8", "surrogateescape").decode("utf-8", "backslashreplace"),
            "Bytes that are not valid in the character set of the script.")


def small_batches(spark: SparkSession) -> None:
    """Bytes of an Arrow batch, lowered where the session asks for more, so
    that a worker's memory hangs on the largest file and not on how many there are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(key).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = STATEMENT_SCHEMA.names
    rows: list[tuple] = []
    size = 0
    for pdf in batches:
        for path, content, charset in zip(pdf["path"], pdf["content"], pdf["charset"]):
            script = split_script(decode_script(bytes(content), charset))
            tail = (script.lines_read, script.lines_processed)
            # a file without statements keeps one row, so that outcomes show it
            for no, start, sql in script.statements or [(0, 0, None)]:
                rows.append((path, charset, no, start, *(_readable(sql) if sql else (None, None)), *tail))
                size += len(sql or "")
                if len(rows) >= ROWS_PER_FRAME or size >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


def script_statements(files: DataFrame) -> DataFrame:
    """``(path, content)`` -> one row per statement. A file with no
    statement keeps one row with ``stmt_no = 0`` and NULL text; a statement
    with bytes that its character set lacks has a ``decode_error``."""
    small_batches(files.sparkSession)
    f = files.select("path", "content", script_charset(F.col("content")).alias("charset"))
    return f.mapInPandas(_split_batches, STATEMENT_SCHEMA)


def read_scripts(spark: SparkSession, pattern: str) -> DataFrame:
    """``*``/``?`` pattern -> files; an empty match is an error."""
    import os
    directory, glob = os.path.split(pattern)
    if not glob or not any(ch in glob for ch in "*?"):
        directory, glob = pattern, None
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        df = reader.load(directory).select("path", "content")
    except Exception as e:  # AnalysisException for a missing path
        raise FileNotFoundError(f"No input matches {pattern}") from e
    if df.isEmpty():
        raise FileNotFoundError(f"No input matches {pattern}")
    return df


# ---- F16 / F20: classification ---------------------------------------------------------

TARGET_TABLE = (r'(?is)^\s*(?:UPDATE\s+OR\s+INSERT\s+INTO|INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO)'
                r'\s+("[^"]+"|[^\s(),;]+)')


def target_table(sql: Column) -> Column:
    """F16: target of INSERT / UPDATE OR INSERT / UPDATE / DELETE / MERGE, upper."""
    raw = F.regexp_extract(sql, TARGET_TABLE, 1)
    return F.when(raw == "", F.lit(None)).otherwise(F.upper(raw))


# DDL statement shapes -> object kind.
KIND_PATTERNS = [
    ("DOMAIN", r"(?is)^\s*CREATE\s+DOMAIN\s+(\"[^\"]+\"|[^\s(;]+)"),
    ("SEQUENCE", r"(?is)^\s*CREATE\s+(?:SEQUENCE|GENERATOR)\s+(\"[^\"]+\"|[^\s(;]+)"),
    ("PROCEDURE", r"(?is)^\s*(?:CREATE\s+OR\s+ALTER|CREATE|ALTER|RECREATE)\s+PROCEDURE\s+(\"[^\"]+\"|[^\s(;]+)"),
    ("FUNCTION", r"(?is)^\s*(?:CREATE\s+OR\s+ALTER|CREATE|ALTER|RECREATE)\s+FUNCTION\s+(\"[^\"]+\"|[^\s(;]+)"),
    ("EXTERNAL", r"(?is)^\s*DECLARE\s+EXTERNAL\s+FUNCTION\s+(\"[^\"]+\"|[^\s(;]+)"),
    ("VIEW", r"(?is)^\s*(?:CREATE\s+OR\s+ALTER|CREATE|RECREATE)\s+VIEW\s+(\"[^\"]+\"|[^\s(;]+)"),
    ("TRIGGER", r"(?is)^\s*(?:CREATE\s+OR\s+ALTER|CREATE|RECREATE)\s+TRIGGER\s+(\"[^\"]+\"|[^\s(;]+)"),
    ("TABLE", r"(?is)^\s*(?:CREATE|RECREATE)\s+TABLE\s+(\"[^\"]+\"|[^\s(;]+)"),
    ("CONSTRAINT", r"(?is)^\s*ALTER\s+TABLE\s+(?:\"[^\"]+\"|[^\s(;]+)\s+ADD\s+CONSTRAINT\s+(\"[^\"]+\"|[^\s(;]+)"),
    ("INDEX", r"(?is)^\s*CREATE\s+(?:UNIQUE\s+)?(?:ASC(?:ENDING)?\s+|DESC(?:ENDING)?\s+)?INDEX\s+(\"[^\"]+\"|[^\s(;]+)"),
]


def _unquote_upper(c: Column) -> Column:
    return F.upper(F.when(c.startswith('"'), F.regexp_extract(c, r'^"([^"]+)"', 1)).otherwise(c))


def statement_kind(sql: Column) -> tuple[Column, Column]:
    """(kind, name) of a DDL statement; NULLs when not DDL."""
    kind = None
    name = None
    for k, pat in KIND_PATTERNS:
        hit = sql.rlike(pat)
        kind = F.when(hit, F.lit(k)) if kind is None else kind.when(hit, F.lit(k))
        name = (F.when(hit, _unquote_upper(F.regexp_extract(sql, pat, 1))) if name is None
                else name.when(hit, _unquote_upper(F.regexp_extract(sql, pat, 1))))
    return kind, name


# Which re-declarations keep the first definition (others keep the last).
FIRST_WINS = ("SEQUENCE", "DOMAIN", "COLUMN")


def latest_definition(ddl: DataFrame, keys: list[str]) -> DataFrame:
    """One definition per (keys, kind, name): last statement wins except
    sequences/domains/columns where the first wins. Aggregated with
    ``max_by``/``min_by`` so a hot name is combined map-side."""
    order = F.struct("file_rank", "stmt_no") if "file_rank" in ddl.columns else F.col("stmt_no")
    g = ddl.groupBy(*keys, "kind", "name").agg(
        F.max_by(F.struct("stmt_no", "sql_text"), order).alias("_last"),
        F.min_by(F.struct("stmt_no", "sql_text"), order).alias("_first"),
        F.count(F.lit(1)).alias("declarations"))
    pick = F.when(F.col("kind").isin(*FIRST_WINS), F.col("_first")).otherwise(F.col("_last"))
    return g.select(*keys, "kind", "name", pick["stmt_no"].alias("stmt_no"), pick["sql_text"].alias("sql_text"),
                    "declarations")


# ---- F17 / S15: INSERT parsing -----------------------------------------------------------

PARSE_SCHEMA = T.StructType([
    T.StructField("table", T.StringType()),
    T.StructField("columns", T.ArrayType(T.StringType())),  # NULL without a column list
    T.StructField("values", T.ArrayType(T.StringType())),
    T.StructField("n_columns", T.IntegerType()),
    T.StructField("n_values", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("verb", T.StringType()),  # INSERT, UPSERT, QUERY (an INSERT from a query) or the first word
    T.StructField("matching", T.ArrayType(T.StringType())),
])

_LEXEME = re.compile(
    r"""(?P<quoted>"[^"]*(?:""[^"]*)*")|'[^']*(?:''[^']*)*'|(?P<mark>[(),])|(?P<word>[^\W\d][\w$]*)|(?P<loose>['"])""")
_INTO = re.compile(r"(?P<verb>UPDATE OR INSERT|INSERT) INTO (?P<table>\S+)")
_VALUES = re.compile(_INTO.pattern + r"(?P<columns> LIST)?(?: OVERRIDING \S+ VALUE)? VALUES LIST(?P<matching> MATCHING LIST)?(?: RETURNING\b.*)?")


def _outline(sql: str) -> tuple[list[str], list[str], list[list[str]], str | None]:
    """What stands outside every bracket: the outline (words in upper case,
    NAME for a quoted name, LIST for a bracketed list), the words as written,
    the items of each list, and what is wrong with quotes or brackets."""
    outline, written, lists = [], [], []
    depth, edges = 0, []
    for m in _LEXEME.finditer(sql):
        kind = m.lastgroup
        if kind == "loose":
            return outline, written, lists, "A quote is not closed."
        if kind == "mark":
            if m[0] == "(":
                depth += 1
                if depth == 1:
                    edges = [m.start()]
            elif m[0] == ")":
                depth -= 1
                if depth < 0:
                    return outline, written, lists, "A bracket is closed that was not opened."
                if depth == 0:
                    edges.append(m.start())
                    items = [sql[a + 1:b].strip() for a, b in zip(edges, edges[1:])]
                    lists.append([] if items == [""] else items)
                    outline.append("LIST")
                    written.append("")
            elif depth == 1:
                edges.append(m.start())
        elif kind and depth == 0:
            outline.append("NAME" if kind == "quoted" else m[0].upper())
            written.append(m[0])
    return outline, written, lists, "A bracket is not closed." if depth else None


def parse_insert_text(sql: str | None) -> tuple:
    """F17 for one statement, in the fields of PARSE_SCHEMA."""
    outline, written, lists, fault = _outline(sql or "")
    if not outline:
        return None, None, None, 0, 0, fault or "The statement is empty.", None, None
    shape = " ".join(outline)
    into = _INTO.match(shape)
    if not into:
        if outline[0] in ("LIST", "NAME"):
            return None, None, None, 0, 0, fault or "The statement does not begin with a word.", None, None
        return None, None, None, 0, 0, fault, outline[0], None
    verb = "UPSERT" if into["verb"] != "INSERT" else "INSERT"
    name = written[len(into["verb"].split()) + 1]
    table = (name[1:-1].replace('""', '"') if name.startswith('"') else name).upper()
    whole = None if fault else _VALUES.fullmatch(shape)
    if not whole:
        if not fault and re.search(r"\b(?:SELECT|WITH)\b", shape):
            return table, None, None, 0, 0, None, "QUERY", None
        return table, None, None, 0, 0, fault or "No list of values was found.", verb, None
    columns = lists[0] if whole["columns"] else None
    values = lists[1 if whole["columns"] else 0]
    matching = lists[-1] if whole["matching"] else None
    n_columns = len(values) if columns is None else len(columns)
    # fixed value: the text of this message
    error = None if n_columns == len(values) else f"Column count ({n_columns}) differs from value count ({len(values)})."
    return table, columns, values, n_columns, len(values), error, verb, matching


def _parse_series(s: pd.Series) -> pd.DataFrame:
    rows = [parse_insert_text(x) for x in s]
    return pd.DataFrame(rows, columns=[f.name for f in PARSE_SCHEMA.fields])


def parse_insert(sql: Column) -> Column:
    """Arrow-batched parse of INSERT / UPDATE OR INSERT statements."""
    from pyspark.sql.functions import pandas_udf
    udf = pandas_udf(_parse_series, PARSE_SCHEMA)
    return udf(sql)


def sql_value(item: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """SQL literal text -> (typed value, ok flag). Strings unquote '' -> '."""
    t = F.trim(item)
    is_null = F.upper(t) == "NULL"
    quoted = t.rlike(r"(?s)^'.*'\z")  # a literal may hold line ends
    text = F.when(quoted, F.replace(F.regexp_extract(t, r"(?s)^'(.*)'$", 1), F.lit("''"), F.lit("'"))).otherwise(t)
    if isinstance(dtype, T.StringType):
        val = F.when(is_null, F.lit(None)).otherwise(text)
        ok = is_null | quoted
    else:
        val = F.when(is_null, F.lit(None).cast(dtype)).otherwise(text.try_cast(dtype))
        ok = is_null | val.isNotNull()
    return val, ok


def _names(items: Column) -> Column:
    return F.transform(items, lambda c: F.upper(F.trim(F.replace(c, F.lit('"'), F.lit("")))))


def replay(statements: DataFrame, target: str, schema: T.StructType, key: list[str] | None = None,
           fail_fast: bool = False) -> DataFrame:
    """S15 + S11: every statement with its one ``fate`` and the ``reason``.

    * ``loaded``: an INSERT into ``target``; its typed values are in the struct
      ``row`` and the names of the columns it gives in ``given``.
    * ``merged``: an UPDATE OR INSERT, likewise.
    * ``quarantined``: a statement on ``target`` that is not well formed, or
      one that names unknown or repeated columns, has another number of values
      than columns, values that do not convert, or bytes that do not decode;
      with ``key``, also one that gives no key or merges by other columns.
    * ``not_applicable``: other statements, and those on other tables.

    Without a column list the values are those of ``schema`` in order. With
    ``fail_fast`` the job ends at a statement that would be quarantined.
    """
    fields = {f.name.upper(): f for f in schema.fields}
    known = F.array(*[F.lit(n) for n in fields])
    p = statements.withColumn("_p", parse_insert(F.col("sql_text")))
    given = F.coalesce(_names(F.col("_p.columns")), known)
    p = p.withColumn("given", given).withColumn("matching", _names(F.col("_p.matching")))
    values, ok = [], F.lit(True)
    for name, f in fields.items():
        at = F.array_position("given", F.lit(name)).cast("int")
        v, good = sql_value(F.get(F.col("_p.values"), at - 1), f.dataType)
        values.append(F.when(at > 0, v).alias(f.name))
        ok = ok & ((at == 0) | F.coalesce(good, F.lit(False)))
    unknown = F.array_except("given", known)
    reason = (F.when(F.col("_p.error").isNotNull(), F.col("_p.error"))
               .when(F.size(F.array_distinct("given")) < F.size("given"), F.lit("A column is given twice."))
               .when(F.size(unknown) > 0, F.concat(F.lit("Column unknown: "), F.array_join(unknown, ", ")))
               .when(F.size("given") != F.size("_p.values"),
                     F.concat(F.lit("Column count ("), F.size("given").cast("string"), F.lit(") differs from value count ("),
                              F.size("_p.values").cast("string"), F.lit(").")))
               .when(~ok, F.lit("Conversion error")))
    if key:
        wanted = F.array_sort(F.array(*[F.lit(k.upper()) for k in key]))
        empty = F.lit(False)
        for k in key:
            empty = empty | F.col("row")[fields[k.upper()].name].isNull()
        by_key = F.col("matching").isNull() | (F.array_sort(F.array_distinct("matching")) == wanted)
        reason = (reason.when(~by_key, F.lit("MATCHING names other columns than the key."))
                        .when(empty, F.lit("The key has no value.")))
    else:
        reason = reason.when(F.size(F.array_except("matching", F.col("given"))) > 0, F.lit("MATCHING names a column without a value."))
    if "decode_error" in statements.columns:
        reason = F.coalesce("decode_error", reason)
    insert = F.col("_p.verb").isin("INSERT", "UPSERT")
    staged = p.withColumn("row", F.struct(*values)).withColumn("_why", reason)
    fate = (F.when(F.col("sql_text").isNull(), "not_applicable")
             .when(F.col("_p.verb").isNull(), "quarantined")
             .when(~insert | (F.col("_p.table") != target.upper()), "not_applicable")
             .when(F.col("_why").isNotNull(), "quarantined")
             .when(F.col("_p.verb") == "UPSERT", "merged").otherwise("loaded"))
    out = staged.withColumn("fate", fate)
    if fail_fast:
        stop = F.raise_error(F.concat(F.lit("Replay stopped: "), F.col("_why"), F.lit(" "), F.col("sql_text")))
        out = out.withColumn("fate", F.when(F.col("fate") == "quarantined", stop.cast("string")).otherwise(F.col("fate")))
    why = (F.when(F.col("fate") == "quarantined", F.col("_why"))
            .when(F.col("sql_text").isNull(), F.lit("No statement."))
            .when((F.col("fate") == "not_applicable") & insert, F.lit("Another table."))
            .when(F.col("_p.verb") == "QUERY", F.lit("An INSERT from a query."))
            .when(F.col("fate") == "not_applicable", F.concat(F.col("_p.verb"), F.lit(" is not replayed."))))
    return out.select(*statements.columns, "fate", why.alias("reason"), "given", "row")


def load_inserts(statements: DataFrame, target: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """S15 + S11: ``(rows, quarantine)`` of the INSERT statements for
    ``target``: typed rows, and the statements that were put aside with the
    reason as ``error``."""
    r = replay(statements, target, schema)
    keep = [c for c in statements.columns if c != "sql_text"]
    good = r.where(F.col("fate") == "loaded").select(*keep, "row.*")
    bad = r.where(F.col("fate") == "quarantined").select(*keep, "sql_text", F.col("reason").alias("error"))
    return good, bad


def settle_keys(replayed: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``replayed`` with the INSERTs whose key was there before put aside.

    The first statement on a key makes its row, whichever kind it is; a later
    INSERT is a duplicate. First statements come from a partial aggregate, so
    a key with very many statements is not gathered in one task.
    """
    at = F.struct(*order)
    keys = [F.col("row")[k].alias(f"_k{i}") for i, k in enumerate(key)]
    names = [f"_k{i}" for i in range(len(key))]
    live = F.col("fate").isin("loaded", "merged")
    first = replayed.where(live).select(*keys, at.alias("_at")).groupBy(*names).agg(F.min("_at").alias("_first"))
    late = (F.col("fate") == "loaded") & (at > F.col("_first"))
    marked = replayed.select("*", *[F.when(live, k).alias(n) for k, n in zip(keys, names)]).join(first, names, "left")
    return marked.withColumn("_late", F.coalesce(late, F.lit(False))).select(
        *[c for c in replayed.columns if c not in ("fate", "reason")],
        F.when(F.col("_late"), "quarantined").otherwise(F.col("fate")).alias("fate"),
        F.when(F.col("_late"), "The key is there already.").otherwise(F.col("reason")).alias("reason"))


def replay_table(settled: DataFrame, schema: T.StructType, key: list[str], order: list[str]) -> DataFrame:
    """The table after the replay of ``settled``. A column has the value
    of the last statement on its key that gives it, else NULL (one partial
    aggregate for all columns)."""
    rows = settled.where(F.col("fate").isin("loaded", "merged")).select("row.*", "given", F.struct(*order).alias("_at"))
    last = [F.max_by(F.struct(F.col(f.name).alias("v")), F.when(F.array_contains("given", f.name.upper()), F.col("_at"))).alias(f.name)
            for f in schema.fields if f.name not in key]
    table = rows.groupBy(*key).agg(*last) if last else rows.select(*key).distinct()
    return table.select(*[F.col(f.name) if f.name in key else F.col(f.name)["v"].alias(f.name) for f in schema.fields])


@dataclass(frozen=True)
class RunMetrics:
    """What a run has done: commands and errors from metrics that Spark
    gathers while the rows pass, seconds of the action, commands a second."""

    commands: int
    errors: int
    seconds: float

    @property
    def rate(self) -> float:
        return self.commands / self.seconds if self.seconds > 0 else 0.0


def measured_write(results: DataFrame, failed: Column, path: str, fmt: str = "parquet") -> RunMetrics:
    """Write the rows of a run and count them on the way (``observe``): no
    second pass over the input. ``failed``: whether a row is an error (null: not)."""
    seen = Observation("run")
    counted = results.observe(seen, F.count(F.lit(1)).alias("commands"), F.count_if(F.coalesce(failed, F.lit(False))).alias("errors"))
    start = time.monotonic()
    counted.write.mode("overwrite").format(fmt).save(path)
    took = time.monotonic() - start
    return RunMetrics(seen.get["commands"], seen.get["errors"], took)
