"""Schema snapshot documents (S04) <-> relational catalog tables.

A snapshot is one JSON document per database with nested lists. It is read
with an explicit schema (never inferred; missing fields become NULL and take
the model defaults below) and taken apart into *objects*: one row for each
table (with its columns, keys, constraints and indexes, bounded by a table's
limits), view, procedure, function, trigger, exception, domain and sequence, and
one for the database itself. Objects are what is stored and read back
(``write_objects``: JSON rows, a folder for each kind); the catalog tables of
``operators.catalog.Catalog`` come from them and go back to them.
``write_documents`` puts documents together for other readers by range-sorted
writing, so no row and no task holds a whole database.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import Catalog
from .fixtures import keep_rows

S = T.StringType()
I = T.IntegerType()
B = T.BooleanType()
LS = T.ArrayType(S)


def _st(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


# JSON keys of the snapshot document (kept for read compatibility).
COLUMN = _st(("Nome", S), ("TipoSql", S), ("CharsetNome", S), ("BytesPorCaracter", I), ("AceitaNulo", B),
             ("DefaultSql", S), ("ComputedBySql", S))
KEY = _st(("Nome", S), ("Colunas", LS))
CHECK = _st(("Nome", S), ("CheckSql", S))
FK = _st(("Nome", S), ("IndiceSuporteNome", S), ("Colunas", LS), ("TabelaReferencia", S),
         ("ColunasReferencia", LS), ("RegraUpdate", S), ("RegraDelete", S))
INDEX = _st(("Nome", S), ("Unico", B), ("Descendente", B), ("Colunas", LS))
TABLE = _st(("Nome", S), ("Colunas", T.ArrayType(COLUMN)), ("ChavePrimaria", KEY), ("ChavesUnicas", T.ArrayType(KEY)),
            ("RestricoesCheck", T.ArrayType(CHECK)), ("ChavesEstrangeiras", T.ArrayType(FK)),
            ("Indices", T.ArrayType(INDEX)))
PARAM = _st(("Nome", S), ("TipoSql", S), ("AceitaNulo", B), ("DefaultSql", S))
PROC = _st(("Nome", S), ("SourceSql", S), ("IgnorarValidacaoCorpoPsql", B), ("ParametrosEntrada", T.ArrayType(PARAM)),
           ("ParametrosSaida", T.ArrayType(PARAM)))
FUNC = _st(("Nome", S), ("SourceSql", S))
TRIGGER = _st(("Nome", S), ("RelacaoNome", S), ("TipoTrigger", I), ("Ativo", B), ("Sequencia", I), ("SourceSql", S))
DOMAIN = _st(("Nome", S), ("TipoSql", S), ("CharsetNome", S), ("BytesPorCaracter", I), ("AceitaNulo", B),
             ("DefaultSql", S), ("CheckSql", S))
SNAPSHOT_SCHEMA = _st(
    ("VersaoServidor", S), ("VersaoMajor", I), ("CharsetBanco", S), ("Tabelas", T.ArrayType(TABLE)),
    ("Views", T.ArrayType(_st(("Nome", S), ("SelectSql", S)))), ("Procedimentos", T.ArrayType(PROC)),
    ("Funcoes", T.ArrayType(FUNC)), ("FuncoesExternas", T.ArrayType(FUNC)), ("Gatilhos", T.ArrayType(TRIGGER)),
    ("Excecoes", T.ArrayType(_st(("Nome", S), ("Mensagem", S)))), ("Dominios", T.ArrayType(DOMAIN)),
    ("Sequencias", T.ArrayType(_st(("Nome", S),))))


def resolve_snapshot_path(path: str) -> str:
    """``.json`` as is; ``x.sql`` -> sibling ``x.schema.json``; bare prefix -> ``prefix.schema.json``."""
    p = path.strip().strip('"')
    low = p.lower()
    if low.endswith(".json"):
        return p
    if low.endswith(".sql"):
        return p[:-4] + ".schema.json"
    return p + ".schema.json"


def read_snapshot_documents(spark: SparkSession, paths) -> DataFrame:
    """One row per document with ``db_id`` (hash of the file path) and ``source``."""
    paths = [resolve_snapshot_path(p) for p in ([paths] if isinstance(paths, str) else paths)]
    docs = spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", True).json(paths)
    return docs.withColumn("source", F.input_file_name()).withColumn("db_id", F.xxhash64("source"))


# kinds of objects: the document's list (none for the database itself) and the object's schema
KINDS = {f.name: f.dataType.elementType for f in SNAPSHOT_SCHEMA.fields if isinstance(f.dataType, T.ArrayType)}
DATABASE = T.StructType([f for f in SNAPSHOT_SCHEMA.fields if f.name not in KINDS])
#: kinds that more than one catalog table comes from
SHARED_KINDS = ("Tabelas", "Procedimentos", "FuncoesExternas")
SORTED_GROUPS = "spark.sql.execution.replaceHashWithSortAgg"


def objects_from_documents(docs: DataFrame) -> dict[str, DataFrame]:
    """(db_id, object) of every kind; ``database`` also keeps ``source``."""
    out = {k: docs.select("db_id", F.explode(k).alias("object")) for k in KINDS}
    out["database"] = docs.select("db_id", F.struct(*DATABASE.names).alias("object"), "source")
    return out


def catalog_from_documents(docs: DataFrame) -> Catalog:
    return catalog_from_objects(objects_from_documents(docs))


def catalog_from_objects(objects: dict[str, DataFrame]) -> Catalog:
    """Catalog tables of the objects (names kept as written)."""
    t = objects["Tabelas"].select("db_id", F.col("object").alias("t"))
    name = F.col("t.Nome").alias("table_name")
    tables = t.select("db_id", name)
    columns = t.select("db_id", name, F.posexplode("t.Colunas").alias("pos", "c")).select(
        "db_id", "table_name", (F.col("pos") + 1).alias("ordinal"), F.col("c.Nome").alias("column_name"),
        F.col("c.TipoSql").alias("sql_type"), F.col("c.BytesPorCaracter").alias("bytes_per_char"),
        F.coalesce("c.AceitaNulo", F.lit(True)).alias("nullable"), F.col("c.DefaultSql").alias("default_sql"),
        F.col("c.ComputedBySql").alias("computed_sql"), F.col("c.CharsetNome").alias("charset"))
    pk = t.where(F.col("t.ChavePrimaria").isNotNull()).select("db_id", name, F.col("t.ChavePrimaria").alias("k"))
    pks = pk.select("db_id", "table_name", F.col("k.Nome").alias("pk_name"))
    pk_cols = pk.select("db_id", "table_name", F.col("k.Nome").alias("pk_name"), F.posexplode("k.Colunas").alias("pos", "column_name")) \
                .select("db_id", "table_name", "pk_name", (F.col("pos") + 1).alias("ordinal"), "column_name")
    u = t.select("db_id", name, F.explode("t.ChavesUnicas").alias("u"))
    k = t.select("db_id", name, F.explode("t.RestricoesCheck").alias("k"))
    f = t.select("db_id", name, F.explode("t.ChavesEstrangeiras").alias("f"))
    fks = f.select("db_id", "table_name", F.col("f.Nome").alias("fk_name"), F.col("f.TabelaReferencia").alias("ref_table"),
                   F.coalesce("f.IndiceSuporteNome", F.lit("")).alias("support_index"),
                   F.coalesce("f.RegraUpdate", F.lit("RESTRICT")).alias("update_rule"),
                   F.coalesce("f.RegraDelete", F.lit("RESTRICT")).alias("delete_rule"))
    n = F.greatest(F.size(F.coalesce("f.Colunas", F.array())), F.size(F.coalesce("f.ColunasReferencia", F.array())))
    fk_cols = (f.where(n > 0)
                .select("db_id", "table_name", F.col("f.Nome").alias("fk_name"), "f.Colunas", "f.ColunasReferencia",
                        F.explode(F.sequence(F.lit(1), n)).alias("ordinal"))
                .select("db_id", "table_name", "fk_name", "ordinal",
                        F.try_element_at("Colunas", F.col("ordinal")).alias("column_name"),
                        F.try_element_at("ColunasReferencia", F.col("ordinal")).alias("ref_column")))
    i = t.select("db_id", name, F.explode("t.Indices").alias("i"))
    indexes = i.select("db_id", "table_name", F.col("i.Nome").alias("index_name"),
                       F.coalesce("i.Unico", F.lit(False)).alias("is_unique"),
                       F.coalesce("i.Descendente", F.lit(False)).alias("is_desc"))
    index_cols = i.select("db_id", "table_name", F.col("i.Nome").alias("index_name"), F.posexplode("i.Colunas").alias("pos", "column_name")) \
                  .select("db_id", "table_name", "index_name", (F.col("pos") + 1).alias("ordinal"), "column_name")

    def routines(kind, label):
        o = objects[kind].select("db_id", F.col("object").alias("r"))
        proc, trig = kind == "Procedimentos", kind == "Gatilhos"
        none = F.lit(None)
        return o.select("db_id", F.lit(label).alias("kind"), F.col("r.Nome").alias("name"),
                        (F.coalesce("r.IgnorarValidacaoCorpoPsql", F.lit(False)) if proc else F.lit(False)).alias("ignore_body"),
                        F.col("r.SourceSql").alias("source"),
                        (F.col("r.RelacaoNome") if trig else none.cast("string")).alias("relation_name"),
                        (F.col("r.TipoTrigger") if trig else none.cast("int")).alias("trigger_type"),
                        (F.coalesce("r.Ativo", F.lit(True)) if trig else none.cast("boolean")).alias("active"),
                        (F.coalesce("r.Sequencia", F.lit(0)) if trig else none.cast("int")).alias("position"))
    rts = (routines("Procedimentos", "PROCEDURE").unionByName(routines("Funcoes", "FUNCTION"))
           .unionByName(routines("Gatilhos", "TRIGGER")).unionByName(routines("FuncoesExternas", "EXTERNAL")))

    def params(field, direction):
        p = objects["Procedimentos"].select("db_id", F.col("object.Nome").alias("procedure_name"), F.posexplode(f"object.{field}").alias("pos", "p"))
        return p.select("db_id", "procedure_name", F.lit(direction).alias("direction"), (F.col("pos") + 1).cast("bigint").alias("ordinal"),
                        F.col("p.Nome").alias("name"), F.col("p.TipoSql").alias("sql_type"),
                        F.coalesce("p.AceitaNulo", F.lit(True)).alias("nullable"), F.col("p.DefaultSql").alias("default_sql"))

    def plain(kind, **cols):
        return objects[kind].select("db_id", *[F.col(f"object.{v}").alias(c) for c, v in cols.items()])
    domains = plain("Dominios", name="Nome", sql_type="TipoSql", bytes_per_char="BytesPorCaracter", nullable="AceitaNulo",
                    default_sql="DefaultSql", check_sql="CheckSql", charset="CharsetNome").withColumn("nullable", F.coalesce("nullable", F.lit(True)))
    d = objects["database"]
    databases = d.select("db_id", F.col("object.VersaoMajor").alias("major"), F.col("object.VersaoServidor").alias("server_version"),
                         F.col("object.CharsetBanco").alias("charset"), *(["source"] if "source" in d.columns else []))
    extras = {
        "uniques": u.select("db_id", "table_name", F.col("u.Nome").alias("name"), F.col("u.Colunas").alias("cols")),
        "checks": k.select("db_id", "table_name", F.col("k.Nome").alias("name"), F.col("k.CheckSql").alias("check_sql")),
        "views": plain("Views", name="Nome", select_sql="SelectSql"),
        "sequences": plain("Sequencias", name="Nome"),
        "exceptions": plain("Excecoes", name="Nome", message="Mensagem"),
        "externals": plain("FuncoesExternas", name="Nome", declaration="SourceSql"),
        "params": params("ParametrosEntrada", "IN").unionByName(params("ParametrosSaida", "OUT")),
    }
    return Catalog(tables=tables, columns=columns, pks=pks, pk_cols=pk_cols, fks=fks, fk_cols=fk_cols,
                   indexes=indexes, index_cols=index_cols, routines=rts, databases=databases, domains=domains,
                   extras=extras)


def _ordered(df, keys, name_col, out):
    # one sort serves the groups and the join with the key's own row (``SORTED_GROUPS``)
    return (df.where(F.col(name_col).isNotNull()).sortWithinPartitions(*keys).groupBy(*keys)
              .agg(F.sort_array(F.collect_list(F.struct("ordinal", F.col(name_col).alias("v")))).alias("_l"))
              .select(*keys, F.col("_l.v").alias(out)))


def _struct(schema: T.StructType, **values) -> Column:
    """A struct of ``schema``'s fields, NULL where no value is given."""
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]).alias("object")


def _listed(df: DataFrame, keys: list[str], item: Column, order: list, out: str) -> DataFrame:
    """Per key the array of ``item`` in order (a table's or procedure's parts, bounded by its limits)."""
    return (df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], item.alias("item")))).alias("_l"))
              .select(*keys, F.transform("_l", lambda x: x["item"]).alias(out)))


def objects_from_catalog(cat: Catalog) -> dict[str, DataFrame]:
    """(db_id, object) of every kind: the inverse of ``catalog_from_objects``."""
    tk, x = ["db_id", "table_name"], cat.extras
    none = cat.tables.select(*tk).limit(0)

    def has(df, c, t="string"):
        return df if c in df.columns else df.withColumn(c, F.lit(None).cast(t))
    c = has(has(cat.columns, "charset"), "bytes_per_char", "int")
    col = _struct(COLUMN, Nome=F.col("column_name"), TipoSql=F.col("sql_type"), CharsetNome=F.col("charset"), BytesPorCaracter=F.col("bytes_per_char"),
                  AceitaNulo=F.col("nullable"), DefaultSql=F.col("default_sql"), ComputedBySql=F.col("computed_sql"))
    no_names = F.array().cast("array<string>")
    pk = cat.pks.join(_ordered(cat.pk_cols, tk + ["pk_name"], "column_name", "cols"), tk + ["pk_name"], "left").select(
        *tk, _struct(KEY, Nome=F.col("pk_name"), Colunas=F.coalesce("cols", no_names)).alias("ChavePrimaria"))
    fkk, ixk = tk + ["fk_name"], tk + ["index_name"]
    fk = cat.fks.join(_ordered(cat.fk_cols, fkk, "column_name", "lc"), fkk, "left").join(_ordered(cat.fk_cols, fkk, "ref_column", "rc"), fkk, "left")
    ix = cat.indexes.join(_ordered(cat.index_cols, ixk, "column_name", "ic"), ixk, "left")
    parts = [
        _listed(c, tk, col, ["ordinal"], "Colunas"),
        pk,
        _listed(x["uniques"], tk, _struct(KEY, Nome=F.col("name"), Colunas=F.col("cols")), ["name"], "ChavesUnicas") if "uniques" in x else none.withColumn("ChavesUnicas", F.lit(None).cast(T.ArrayType(KEY))),
        _listed(x["checks"], tk, _struct(CHECK, Nome=F.col("name"), CheckSql=F.col("check_sql")), ["name"], "RestricoesCheck") if "checks" in x else none.withColumn("RestricoesCheck", F.lit(None).cast(T.ArrayType(CHECK))),
        _listed(fk, tk, _struct(FK, Nome=F.col("fk_name"), IndiceSuporteNome=F.col("support_index"), Colunas=F.coalesce("lc", no_names), TabelaReferencia=F.col("ref_table"),
                                ColunasReferencia=F.coalesce("rc", no_names), RegraUpdate=F.col("update_rule"), RegraDelete=F.col("delete_rule")), ["fk_name"], "ChavesEstrangeiras"),
        _listed(ix, tk, _struct(INDEX, Nome=F.col("index_name"), Unico=F.col("is_unique"), Descendente=F.col("is_desc"), Colunas=F.coalesce("ic", no_names)), ["index_name"], "Indices")]
    whole = cat.tables.select(*tk)
    for p in parts:
        whole = whole.join(p, tk, "left")
    lists = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in TABLE.fields if isinstance(f.dataType, T.ArrayType)}
    out = {"Tabelas": whole.select("db_id", _struct(TABLE, Nome=F.col("table_name"), ChavePrimaria=F.col("ChavePrimaria"), **lists))}

    r = cat.routines
    for n, t in (("relation_name", "string"), ("trigger_type", "int"), ("active", "boolean"), ("position", "int"), ("ignore_body", "boolean")):
        r = has(r, n, t)
    procs = r.where(F.col("kind") == "PROCEDURE").withColumn("_p", F.upper("name"))
    item = _struct(PARAM, Nome=F.col("name"), TipoSql=F.col("sql_type"), AceitaNulo=F.col("nullable"), DefaultSql=F.col("default_sql"))
    for direction, field in (("IN", "ParametrosEntrada"), ("OUT", "ParametrosSaida")):
        if "params" in x:
            p = x["params"].where(F.col("direction") == direction).withColumn("_p", F.upper("procedure_name"))
            procs = procs.join(_listed(p, ["db_id", "_p"], item, ["ordinal"], field), ["db_id", "_p"], "left")
        else:
            procs = procs.withColumn(field, F.lit(None).cast(T.ArrayType(PARAM)))
        procs = procs.withColumn(field, F.coalesce(field, F.array().cast(T.ArrayType(PARAM))))
    body = {"Nome": F.col("name"), "SourceSql": F.col("source")}
    out["Procedimentos"] = procs.select("db_id", _struct(PROC, **body, IgnorarValidacaoCorpoPsql=F.col("ignore_body"),
                                                         ParametrosEntrada=F.col("ParametrosEntrada"), ParametrosSaida=F.col("ParametrosSaida")))
    out["Funcoes"] = r.where(F.col("kind") == "FUNCTION").select("db_id", _struct(FUNC, **body))
    out["Gatilhos"] = r.where(F.col("kind") == "TRIGGER").select("db_id", _struct(
        TRIGGER, **body, RelacaoNome=F.col("relation_name"), TipoTrigger=F.col("trigger_type"), Ativo=F.col("active"), Sequencia=F.col("position")))
    ext = x["externals"].select("db_id", "name", F.col("declaration").alias("source")) if "externals" in x else r.where(F.col("kind") == "EXTERNAL").select("db_id", "name", "source")
    out["FuncoesExternas"] = ext.select("db_id", _struct(FUNC, **body))

    def plain(kind, df, **cols):
        empty = cat.databases.limit(0)
        out[kind] = (empty.select("db_id", _struct(KINDS[kind])) if df is None else
                     df.select("db_id", _struct(KINDS[kind], **{v: F.col(n) for n, v in cols.items() if n in df.columns})))
    plain("Views", x.get("views"), name="Nome", select_sql="SelectSql")
    plain("Excecoes", x.get("exceptions"), name="Nome", message="Mensagem")
    plain("Sequencias", x.get("sequences"), name="Nome")
    plain("Dominios", cat.domains, name="Nome", sql_type="TipoSql", charset="CharsetNome", bytes_per_char="BytesPorCaracter", nullable="AceitaNulo",
          default_sql="DefaultSql", check_sql="CheckSql")
    d = has(has(cat.databases, "charset"), "server_version")
    out["database"] = d.select("db_id", _struct(DATABASE, VersaoServidor=F.col("server_version"), VersaoMajor=F.col("major"), CharsetBanco=F.col("charset")))
    return out


def write_objects(cat: Catalog, path: str) -> None:
    """One JSON row for each object under ``path/<kind>``."""
    spark = cat.tables.sparkSession
    objects = objects_from_catalog(cat)
    was = spark.conf.get(SORTED_GROUPS)
    # lists of a table's parts are made from rows that lie in its order, without a sort of their own
    spark.conf.set(SORTED_GROUPS, "true")
    try:
        for kind, df in objects.items():
            df.write.mode("overwrite").json(f"{path}/{kind}")
    finally:
        spark.conf.set(SORTED_GROUPS, was)


def read_objects(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What ``write_objects`` has written, by kind, with explicit schemas.
    Kinds that several catalog tables come from are parsed once and kept by
    column, so each of these tables reads only what it has."""
    def of(kind, schema):
        df = spark.read.schema(T.StructType([T.StructField("db_id", T.LongType()), T.StructField("object", schema)])).json(f"{path}/{kind}")
        return keep_rows([df]) if kind in SHARED_KINDS else df
    return {kind: of(kind, schema) for kind, schema in {**KINDS, "database": DATABASE}.items()}


def document_lines(cat: Catalog) -> DataFrame:
    """(db_id, part, name, sub, line): the JSON document of each database, an
    object a line. Sorted by all columns but the last, lines make the document."""
    objects = objects_from_catalog(cat)
    db = objects["database"]
    order = list(KINDS)
    frames = [db.select("db_id", F.lit(-1).alias("part"), F.lit("").alias("name"), F.lit("").alias("sub"),
                        F.regexp_replace(F.to_json("object"), r"\}$", "").alias("head")).select(
        "db_id", "part", "name", "sub", F.when(F.col("head") == "{", F.col("head")).otherwise(F.concat("head", F.lit(","))).alias("line"))]
    for i, kind in enumerate(order):
        o = objects[kind].select("db_id", F.coalesce("object.Nome", F.lit("")).alias("name"), F.to_json("object").alias("json"))
        # every object but the first of its list has a comma in front
        first = o.groupBy("db_id").agg(F.min(F.struct("name", "json")).alias("first"), F.count(F.lit(1)).alias("n"))
        lead = o.join(first, "db_id").withColumn("same", F.struct("name", "json") == F.col("first"))
        frames.append(lead.where("not same").select("db_id", F.lit(3 * i + 1).alias("part"), "name", F.col("json").alias("sub"), F.concat(F.lit(","), F.col("json")).alias("line")))
        # rows equal to the first are copies of one object
        frames.append(first.select("db_id", F.lit(3 * i + 1).alias("part"), F.col("first.name").alias("name"), F.col("first.json").alias("sub"), F.col("first.json").alias("line")))
        frames.append(db.select("db_id", F.lit(3 * i).alias("part"), F.lit("").alias("name"), F.lit("").alias("sub"), F.lit(f'"{kind}": [').alias("line")))
        frames.append(db.select("db_id", F.lit(3 * i + 2).alias("part"), F.lit("").alias("name"), F.lit("").alias("sub"),
                                F.lit("]" if i == len(order) - 1 else "],").alias("line")))
    frames.append(db.select("db_id", F.lit(3 * len(order)).alias("part"), F.lit("").alias("name"), F.lit("").alias("sub"), F.lit("}").alias("line")))
    return reduce(DataFrame.unionByName, frames)


def write_documents(cat: Catalog, path: str) -> None:
    """The document of each database under ``path/db_id=N``: its lines in order
    over files whose names sort like the text, written from ranges, so that a
    database of any size is written by as many tasks as it needs."""
    keys = ["db_id", "part", "name", "sub"]
    (document_lines(cat).repartitionByRange(*keys).sortWithinPartitions(*keys).select("db_id", "line")
     .write.mode("overwrite").partitionBy("db_id").text(path))


def snapshot_dir(spark: SparkSession, name: str) -> str:
    from ..session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), name)
