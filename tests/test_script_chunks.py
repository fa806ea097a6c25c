"""Scripts read in chunks equal scripts read in one pass."""

import os
import random
import tempfile
from functools import reduce

import pytest

from catwarden.operators import script_chunks as C
from catwarden.operators import scripts as S

BITS = ["'", "'", "\n", "\n", "\r\n", "\r", ";", ";", "^", "SET TERM ^ ;\n", "SET TERM ; ^\n", "SET TERM ^^;", "SET TERM ;^^\n",
        "set term a;b ;", "--x", "/*", "*/", " ", "a", 'b"', '"', "SELECT 1", "SET NAMES UTF8;", chr(0x3000), " ", "/", "-", "''",
        "\x1c", "SET SQL DIALECT 3;\n", "/*/", "a;b"]


def _script(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


def _parts(text, rng):
    """The text as whole lines, a few a chunk."""
    lines = [line + "\n" for line in text.split("\n")]
    lines = lines[:-1] + ([lines[-1][:-1]] if lines[-1] != "\n" else [])
    out, at = [], 0
    while at < len(lines):
        n = rng.choice([1, 1, 2, 3, 7])
        out.append("".join(lines[at:at + n]))
        at += n
    return out or [""]


def test_maps_compose_to_the_states_of_one_pass():
    rng = random.Random(5)
    for _ in range(1500):
        parts = _parts(_script(rng, rng.randrange(40)), rng)
        cand = C.terminators(sorted({w for p in parts for w in C._TERM.findall(p)}))
        maps = [C.chunk_map(p, cand) for p in parts]
        state = C.START
        for n, (p, m) in enumerate(zip(parts, maps)):
            after = C._Reader(p, state, n == len(parts) - 1).read()
            assert after == C.step(m, state)
            state = after
        cut = len(maps) // 2
        if cut:
            assert C.step(C.compose(maps[cut:]), C.step(C.compose(maps[:cut]), C.START)) == reduce(lambda s, m: C.step(m, s), maps, C.START)


def test_terminators_hold_what_is_left_of_a_word():
    assert set(C.terminators(["^;", "!!", ";"])) == {";", "^", "^;", "!!"}


def _rows(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.charset, r.stmt_no, r.start_line, r.sql_text, r.decode_error, r.lines_read, r.lines_processed)
                  for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = {f"s{i:02}.sql": _script(rng, 120).encode() for i in range(20)}
    texts["empty.sql"] = b""
    texts["mark.sql"] = C.BOM + "SET NAMES WIN1252;\nSELECT 'é\n';\nSELECT 2".encode()
    texts["mark_end.sql"] = C.BOM + b"SELECT 1;\n"
    texts["win.sql"] = b"\n" * 150 + b"SET NAMES WIN1252 ;\nINSERT INTO A VALUES ('\xe9\n\x81');\n"
    texts["late.sql"] = b"\n" * 230 + b"SET NAMES WIN1252 ;\nSELECT '\xe9\n';\n"
    texts["open.sql"] = b"SELECT 1;\nSELECT 'never\nclosed;\n"
    texts["none.sql"] = b"-- nothing\n\n/* here\n"
    texts["one_line.sql"] = b"SELECT 1; SELECT 2"
    return texts


def test_chunks_equal_the_whole(spark, corpus):
    rng = random.Random(3)
    chunks = [(name, n * 10, bytearray(p.encode("latin-1"))) for name, data in corpus.items()
              for n, p in enumerate(_parts(data.decode("latin-1"), rng))]
    rng.shuffle(chunks)
    df = spark.createDataFrame(chunks, "path string, chunk bigint, content binary")
    whole = spark.createDataFrame([(n, bytearray(d)) for n, d in corpus.items()], "path string, content binary")
    got = C.chunk_statements(df)
    assert got.columns == S.STATEMENT_SCHEMA.names
    assert _rows(got) == _rows(S.script_statements(whole))


def test_files_are_cut_in_ranges(spark, corpus):
    """Ranges of 64 bytes, chunks of 40: byte order marks, line ends and empty files come out as they are."""
    root = tempfile.mkdtemp(prefix="catwarden-chunks-", dir="/tmp")
    for name, data in corpus.items():
        with open(os.path.join(root, name), "wb") as f:
            f.write(data)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        chunks = C.file_chunks(spark, root, 40)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    again = {}
    for r in sorted(chunks.collect(), key=lambda r: r.chunk):
        again[r.path.rsplit("/", 1)[-1]] = again.get(r.path.rsplit("/", 1)[-1], b"") + bytes(r.content)
    listed = {n: d for n, d in corpus.items() if d}  # Spark lists no empty files
    assert again == listed
    whole = spark.createDataFrame([(n, bytearray(d)) for n, d in listed.items()], "path string, content binary")
    assert _rows(C.chunk_statements(chunks)) == _rows(S.script_statements(whole))


def test_blocks_of_maps_and_odd_input(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)
    text = "".join(f"INSERT INTO T VALUES ({i}, 'a\n;b');\n" for i in range(60))
    rows = [("x", n, bytearray(line + b"\n")) for n, line in enumerate(text.encode().split(b"\n")[:-1])]
    df = spark.createDataFrame(rows, "path string, chunk bigint, content binary")
    got = [(r.stmt_no, r.start_line, r.sql_text) for r in C.chunk_statements(df).orderBy("stmt_no").collect()]
    assert got == S.split_script(text).statements
    assert C.chunk_statements(df.limit(0)).count() == 0
    null = spark.createDataFrame([("y", 0, None)], df.schema)
    assert [(r.stmt_no, r.sql_text, r.lines_read) for r in C.chunk_statements(null).collect()] == [(0, None, 0)]
