"""Schema text, exact parts, snapshots, levels, encoded scripts: against plain Python on small tables."""

import json
import os
import random
import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from catwarden.operators import graph as G
from catwarden.operators import monitor as M
from catwarden.operators import schema_text as ST
from catwarden.operators import scripts as S
from catwarden.operators import transfer as X
from catwarden.sources import sinks
from catwarden.sources import snapshots as SN
from catwarden.streaming import monitor_stream as TS
from tests.catalog_builder import DDL, build


def folder():
    return tempfile.mkdtemp(prefix="catwarden-", dir="/tmp")


def whole(spark):
    d = DDL(1)
    d.table("B", ("ID", "INTEGER", False), ("N", "VARCHAR(10)"), ("X", "INTEGER", True, None, "(ID * 2)"))
    d.table("A", ("ID", "BOOLEAN", True, "DEFAULT 0"))
    d.pk("B", "PK_B", "ID").pk("A", "INTEG_7", "ID")
    d.fk("A", "FK_A", ["ID"], "B", ["ID"], dele="CASCADE")
    d.index("B", "IX_B", ["N", "ID"], unique=True, desc=True)
    d.routine("PROCEDURE", "P1", "AS BEGIN EXECUTE PROCEDURE P2(1); END").routine("PROCEDURE", "P2", "BEGIN SUSPEND; END;").routine("PROCEDURE", "P0", " ")
    d.routine("FUNCTION", "F1", "").routine("TRIGGER", "TR", "AS BEGIN END")
    cat = build(spark, d)

    def t(rows, schema):
        return spark.createDataFrame(rows, schema)
    extras = {
        "uniques": t([(1, "B", "UQ", ["N"])], "db_id long, table_name string, name string, cols array<string>"),
        "checks": t([(1, "B", "INTEG_3", "ID > 0")], "db_id long, table_name string, name string, check_sql string"),
        "sequences": t([(1, 'S"q')], "db_id long, name string"), "views": t([(1, "V", " SELECT 1 ")], "db_id long, name string, select_sql string"),
        "exceptions": t([(1, "EX", "isn't"), (1, "EN", None)], "db_id long, name string, message string"),
        "externals": t([(1, "UDF", "DECLARE EXTERNAL FUNCTION \"UDF\"\nMODULE_NAME 'm';\n")], "db_id long, name string, declaration string"),
        "params": t([(1, "P2", "IN", 1, "A", "INTEGER", False, None), (1, "P2", "IN", 2, "B", "INTEGER", True, None), (1, "P2", "IN", 3, "C", "INTEGER", True, "DEFAULT 5"),
                     (1, "P2", "OUT", 1, "R", "INTEGER", True, None)],
                    "db_id long, procedure_name string, direction string, ordinal long, name string, sql_type string, nullable boolean, default_sql string")}
    cols = cat.columns.withColumn("charset", F.when(F.col("column_name") == "N", "win1252"))
    routines = cat.routines.select("*", F.when(F.col("kind") == "TRIGGER", "B").alias("relation_name"), F.when(F.col("kind") == "TRIGGER", 18).alias("trigger_type"),
                                   F.when(F.col("kind") == "TRIGGER", False).alias("active"), F.when(F.col("kind") == "TRIGGER", 4).alias("position"))
    domains = t([(1, "D", "VARCHAR(5)", 1, False, "DEFAULT ''", "CHECK (VALUE > '')", "UTF8"), (1, "RDB$9", "INTEGER", 1, True, None, None, None)],
                "db_id long, name string, sql_type string, bytes_per_char int, nullable boolean, default_sql string, check_sql string, charset string")
    return replace(cat, columns=cols, routines=routines, domains=domains, extras=extras,
                   databases=t([(1, 2, "WIN1252"), (2, 4, None)], "db_id long, major int, charset string"))


TEXT = '''SET NAMES WIN1252;

-- field compatibility audit: checked 6 item(s), issues 1.
-- [CRITICAL] CAMPO_TIPO_INCOMPATIVEL_VERSAO | A.ID | BOOLEAN

SET SQL DIALECT 3;

CREATE DOMAIN "D" AS VARCHAR(5) CHARACTER SET UTF8 DEFAULT '' NOT NULL CHECK (VALUE > '');

CREATE SEQUENCE "S""q";

CREATE TABLE "A" (
    "ID" BOOLEAN DEFAULT 0
);
CREATE TABLE "B" (
    "ID" INTEGER NOT NULL,
    "N" VARCHAR(10),
    "X" COMPUTED BY (ID * 2)
);

ALTER TABLE "A" ADD PRIMARY KEY ("ID");
ALTER TABLE "B" ADD CONSTRAINT "PK_B" PRIMARY KEY ("ID");

ALTER TABLE "B" ADD CONSTRAINT "UQ" UNIQUE ("N");

ALTER TABLE "B" ADD CHECK (ID > 0);

ALTER TABLE "A" ADD CONSTRAINT "FK_A" FOREIGN KEY ("ID") REFERENCES "B" ("ID") ON DELETE CASCADE;

CREATE UNIQUE DESCENDING INDEX "IX_B" ON "B" ("N", "ID");

DECLARE EXTERNAL FUNCTION "UDF"
MODULE_NAME 'm';

CREATE VIEW "V" AS SELECT 1;

CREATE EXCEPTION "EN" '';
CREATE EXCEPTION "EX" 'isn''t';

SET TERM ^;

-- [WARNING] FUNCTION "F1" exists in metadata but has no PSQL source; DDL was not generated for this object.

SET TERM ;^

SET TERM ^;

CREATE OR ALTER PROCEDURE "P2"
(
"A" INTEGER NOT NULL,
"B" INTEGER = null,
"C" INTEGER = 5
)
RETURNS (
"R" INTEGER
)
AS
BEGIN
END
 ^

CREATE OR ALTER PROCEDURE "P1"
AS
BEGIN
END
 ^

-- [WARNING] PROCEDURE "P0" exists in metadata but has no PSQL source; DDL was not generated for this object.

CREATE OR ALTER PROCEDURE "P2"
(
"A" INTEGER NOT NULL,
"B" INTEGER = null,
"C" INTEGER = 5
)
RETURNS (
"R" INTEGER
)
AS
BEGIN SUSPEND; END
 ^

CREATE OR ALTER PROCEDURE "P1"
AS
BEGIN EXECUTE PROCEDURE P2(1); END
 ^

CREATE OR ALTER TRIGGER "TR" FOR "B" INACTIVE AFTER INSERT OR UPDATE POSITION 4
AS
BEGIN END
 ^

SET TERM ;^
'''


def test_schema_text_of_every_kind(spark):
    rendered = ST.render_schema(whole(spark))
    rows = sorted(rendered.collect(), key=lambda r: (r.db_id, r.seq))
    assert "\n".join(r.sql for r in rows if r.db_id == 1) == TEXT
    assert [r.seq for r in rows if r.db_id == 1] == list(range(1, 1 + sum(r.db_id == 1 for r in rows)))
    assert [r.sql for r in rows if r.db_id == 2] == ["SET NAMES UTF8;", "", "-- field compatibility audit: checked 0 item(s), issues 0.", "", "SET SQL DIALECT 3;", ""]
    out = folder()
    ST.write_schema(rendered.where("db_id = 1"), out)
    files = sorted(f for f in os.listdir(f"{out}/db_id=1") if f.endswith(".txt"))
    assert "".join(open(f"{out}/db_id=1/{f}").read() for f in files) == TEXT + "\n"


def test_snapshots_keep_every_kind(spark):
    cat = whole(spark)
    out = folder()
    SN.write_objects(cat, f"{out}/objects")
    back = SN.catalog_from_objects(SN.read_objects(spark, f"{out}/objects"))
    pairs = [(getattr(cat, n), getattr(back, n)) for n in ("tables", "columns", "pks", "pk_cols", "fks", "fk_cols", "indexes", "index_cols", "databases", "domains")]
    pairs += [(cat.extras[n], back.extras[n]) for n in cat.extras] + [(cat.routines, back.routines.where("kind <> 'EXTERNAL'"))]
    for was, now in pairs:
        now = now.select(*was.columns)
        assert sorted(map(str, was.collect())) == sorted(map(str, now.collect()))
    SN.write_documents(cat, f"{out}/documents")
    files = sorted(f for f in os.listdir(f"{out}/documents/db_id=1") if f.endswith(".txt"))
    text = "".join(open(f"{out}/documents/db_id=1/{f}").read() for f in files)
    document = json.loads(text)
    assert [t["Nome"] for t in document["Tabelas"]] == ["A", "B"] and document["Gatilhos"][0]["TipoTrigger"] == 18 and document["CharsetBanco"] == "WIN1252"
    with open(f"{out}/x.schema.json", "w") as f:
        f.write(text)
    again = SN.catalog_from_documents(SN.read_snapshot_documents(spark, f"{out}/x"))
    assert again.columns.count() == cat.columns.count() and again.extras["params"].count() == 4


def greedy(sizes, room):
    out, part, used = [], 1, 0
    for i, b in enumerate(sizes):
        if i and used + b > room:
            part, used = part + 1, 0
        out.append(part)
        used += b
    return out


@pytest.mark.parametrize("partitions", [2, 64])
def test_parts_are_those_of_one_pass(spark, partitions):
    rng = random.Random(5)
    for room, sizes in [(50, [rng.randrange(1, 30) for _ in range(1_500)]), (40, [rng.choice([1, 2, 3, 41, 39, 1_000, 40]) for _ in range(800)]), (3, [1] * 40), (10, [500])]:
        rows = [(i + 1, 0, "x" * (b - 1)) for i, b in enumerate(sizes)]
        parted = sinks.assign_parts(spark.createDataFrame(rows, "row_no long, sub int, line string"), room, [], partitions)
        assert [r.part_no for r in sorted(parted.collect(), key=lambda r: r.row_no)] == greedy(sizes, room)
    none = sinks.assign_parts(spark.createDataFrame([], "row_no long, sub int, line string"), 10, [], partitions)
    assert none.count() == 0


def test_levels_of_long_chains_and_cycles(spark):
    n = 2_000
    edges = [(1, f"a{i}", f"a{i - 1}") for i in range(1, n)] + [(1, f"a{i}", "root") for i in range(n)]
    edges += [(2, f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [(2, "t", "c0"), (2, "u", "t"), (2, "u", "z"), (2, "v", "z")]
    nodes = sorted({(d, x) for d, a, b in edges for x in (a, b)} | {(3, "alone")})
    rounds = []
    got = G.levels(spark.createDataFrame(nodes, "db_id long, node string"), spark.createDataFrame(edges, "db_id long, src string, dst string"))
    rounds.append(got._jdf.queryExecution().analyzed().toString().count("level"))
    want = {(1, "root"): 0, (2, "z"): 0, (2, "v"): 1, (3, "alone"): 0} | {(1, f"a{i}"): i + 1 for i in range(n)}
    assert {(r.db_id, r.node): r.level for r in got.collect()} == want and rounds[0] < 200


def test_scripts_in_other_character_sets(spark):
    lines = [(1, 0, "SELECT 'à €';"), (2, 0, "SELECT '日';"), (3, 0, "INSERT INTO \"T\" VALUES ('a, \"b\" #\\');"), (4, 0, "  x  "), (5, 0, "")]
    df = spark.createDataFrame([(1, *r) for r in lines], "part_no int, row_no long, sub int, line string")
    header = sinks.header_lines("WIN1252")
    script = sinks.with_headers(df, header)
    assert [r.row_no for r in sinks.not_encodable(script, "WIN1252").collect()] == [2]
    assert [r.row_no for r in sinks.not_encodable(script, "ISO8859_1").orderBy("row_no").collect()] == [1, 2]
    out = folder()
    sinks.write_script(script, out, "WIN1252")
    name = [f for f in os.listdir(f"{out}/part_no=1") if f.startswith("part-")][0]
    raw = open(f"{out}/part_no=1/{name}", "rb").read()
    assert raw.decode("cp1252").split("\n")[:-1] == [x or " " for x in (*header, *[x for _, _, x in lines if "日" not in x])]
    assert S.script_statements(S.read_scripts(spark, f"{out}/part_no=1/{name}")).first().sql_text == "SELECT 'à €'"
    with pytest.raises(ValueError):
        sinks.write_script(script, out, "KOI8R")


def test_run_metrics_are_counted_on_the_way(spark):
    df = spark.range(1_000).select("id", F.when(F.col("id") % 10 == 0, True).alias("bad"))
    got = S.measured_write(df, F.col("bad"), folder())
    assert (got.commands, got.errors) == (1_000, 100) and got.seconds > 0 and got.rate > 0


def test_status_of_every_database(spark):
    dbs = spark.createDataFrame([(1, True), (2, True), (3, False), (4, None)], "db_id long, live boolean")
    samples = spark.sql("SELECT 1L AS db_id, timestamp'2024-01-01' AS ts UNION ALL SELECT 3L, timestamp'2024-01-01'")
    failures = spark.sql("SELECT 9L AS db_id, timestamp'2024-01-01' AS ts, 1L AS event_id, 'x' AS message").where("false")
    got = {r.db_id: (r.status, r.attempts) for r in M.fleet_analysis_status(dbs, samples, failures).collect()}
    assert got == {1: ("executed", 1), 2: ("pending", 0), 3: ("not_applicable", 1), 4: ("not_applicable", 0)}


def marks(us, units, span):
    out, since, last = [], 0, us[0] if us else None
    for i, t in enumerate(us):
        since += 1
        if since >= units or t >= last + span:
            out.append(i + 1)
            since, last = 0, t
    return out


def test_progress_marks_batch_and_stream(spark):
    rng = random.Random(8)
    us, t = [], 1_700_000_000_000_000
    for _ in range(2_500):
        t += rng.choice([0, 1, 1_000_000, 3_000_000, 90_000_000])
        us.append(t)
    df = spark.createDataFrame([(i + 1, u) for i, u in enumerate(us)], "row_no long, us long").withColumn("ts", F.timestamp_micros("us"))
    for units, seconds in [(20, 30), (5, 1_000), (100, 2)]:
        assert sorted(r.row_no for r in X.progress_marks(df, "ts", units, seconds).collect()) == marks(us, units, seconds * 1_000_000)
    assert X.progress_marks(df.limit(0), "ts").count() == 0
    src, out = folder(), folder()
    for i in range(4):  # files in order of time, one a trigger
        part = df.where((F.col("row_no") > i * 700) & (F.col("row_no") <= (i + 1) * 700)).withColumn("run", F.lit(3)).coalesce(1)
        part.write.mode("append").parquet(src)
    stream = spark.readStream.schema("row_no long, us long, ts timestamp, run int").option("maxFilesPerTrigger", 1).parquet(src)
    q = TS.start_stream(TS.progress_stream(stream, "run", ["row_no"], "ts", 20, 30), f"{out}/rows", f"{out}/state")
    q.awaitTermination(300)
    assert sorted(r.row_no for r in spark.read.parquet(f"{out}/rows").collect()) == marks(us, 20, 30_000_000)
