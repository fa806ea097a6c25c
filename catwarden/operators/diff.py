"""Structural diff between a desired (source) and a current (target) catalog.

Both sides hold many databases; every comparison is a full-outer or anti
join on ``(db_id, upper(name))`` or on a signature, so one job diffs a
whole fleet. Output:

* items    ``db_id, bucket, object_type, table_name, name, attr``
  with bucket in created / changed / target_only / warning;
* commands ``db_id, class, depth, table_name, seq, sql`` — ``class`` is
  emitted by the operator that builds the command (unnamed constraints keep
  their class), ``depth`` is the FK depth of the table in the source.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import render as R
from .catalog import Catalog, ordered_names
from .graph import fk_depth

ITEM_COLS = ["db_id", "bucket", "object_type", "table_name", "name", "attr"]
CMD_COLS = ["db_id", "class", "table_name", "seq", "sql"]
CHILDREN = ("columns", "pks", "pk_cols", "fks", "fk_cols", "indexes", "index_cols")


class DiffResult:
    """``items`` and the ordered ``commands``; command ordering needs the FK
    depth loop, so it runs only when ``commands`` is first used. ``parts`` are
    the (items, commands) of each object kind, ``keep`` puts frames together."""

    def __init__(self, items: DataFrame, commands=None, parts=None, src=None, keep=None):
        self.items = items
        self._commands = commands
        self.parts, self.src, self.keep = parts, src, keep or _union

    @property
    def commands(self) -> DataFrame:
        if callable(self._commands):
            self._commands = self._commands()
        return self._commands


def _item(df, bucket, object_type, table=None, name=None, attr=None):
    return df.select(
        "db_id", F.lit(bucket).alias("bucket"), F.lit(object_type).alias("object_type"),
        (table if table is not None else F.lit(None).cast("string")).alias("table_name"),
        (name if name is not None else F.lit(None).cast("string")).alias("name"),
        (attr if attr is not None else F.lit(None).cast("string")).alias("attr"))


def _cmd(df, cls, table, seq, sql):
    cls_col = cls if not isinstance(cls, int) else F.lit(cls)
    return df.select("db_id", cls_col.cast("int").alias("class"), table.alias("table_name"),
                     seq.alias("seq"), sql.alias("sql"))


def _one_pass(j, *items):
    """Items of a joined frame that is read once: of each row those structs that are not null."""
    return j.select("db_id", F.explode(F.array_compact(F.array(*items))).alias("i")).select("db_id", "i.*")


def _item_when(cond, bucket, object_type, table=None, name=None, attr=None):
    made = {"table_name": table, "name": name, "attr": attr}
    return F.when(cond, _struct(ITEM_COLS[1:], bucket=F.lit(bucket), object_type=F.lit(object_type), **{k: v for k, v in made.items() if v is not None}))


def _union(frames):
    return reduce(DataFrame.unionByName, frames)


def _keyed_tables(cat: Catalog) -> DataFrame:
    return cat.tables.select("db_id", "table_name", F.upper("table_name").alias("tkey"))


def _common_tables(src: Catalog, tgt: Catalog) -> DataFrame:
    """(db_id, tkey, table_name of the source, table_name of the target)."""
    s = _keyed_tables(src)
    t = _keyed_tables(tgt).withColumnRenamed("table_name", "t_table")
    # hints here and below: a side that is small on disk, not in rows, stays out of the driver
    return s.join(t.hint("merge"), ["db_id", "tkey"])


def _with_tkey(df: DataFrame) -> DataFrame:
    return df.withColumn("tkey", F.upper("table_name"))


# ---- tables (D01) -------------------------------------------------------------

def _column_defs(cat: Catalog, db_charsets: DataFrame | None = None) -> DataFrame:
    """Per table, the ordered column clauses; one table's columns are
    bounded by the engine's column limit, never by the fleet size.
    ``db_charsets`` (db_id, db_charset): a column's charset equal to its
    database's is left out (F23)."""
    c = cat.columns
    charset = F.col("charset") if "charset" in c.columns else None
    if charset is not None and db_charsets is not None:
        c = c.join(db_charsets, "db_id", "left")
    d = c.withColumn("def", R.column_definition(F.col("column_name"), F.col("sql_type"), F.col("nullable"),
                                                F.col("default_sql"), F.col("computed_sql"), charset,
                                                F.col("db_charset") if "db_charset" in c.columns else None))
    return ordered_names(d, ["db_id", "table_name"], "def", "defs", upper=False)


def _pk_lists(cat: Catalog) -> DataFrame:
    keys = ["db_id", "table_name", "pk_name"]
    cols = ordered_names(cat.pk_cols, keys, "column_name", "cols", upper=False)
    return (cat.pks.join(cols, keys, "left")
               .withColumn("cols", F.coalesce("cols", F.array().cast("array<string>")))
               .withColumn("signature", F.upper(F.array_join("cols", "|"))))


def _fk_lists(cat: Catalog) -> DataFrame:
    keys = ["db_id", "table_name", "fk_name"]
    lc = ordered_names(cat.fk_cols, keys, "column_name", "cols", upper=False)
    rc = ordered_names(cat.fk_cols, keys, "ref_column", "ref_cols", upper=False)
    empty = F.array().cast("array<string>")
    f = (cat.fks.join(lc, keys, "left").join(rc, keys, "left")
                .withColumn("cols", F.coalesce("cols", empty))
                .withColumn("ref_cols", F.coalesce("ref_cols", empty)))
    sig = F.upper(F.concat(F.array_join("cols", "|"), F.lit("->"), F.col("ref_table"), F.lit("("),
                           F.array_join("ref_cols", "|"), F.lit(")["), F.coalesce("update_rule", F.lit("")),
                           F.lit("|"), F.coalesce("delete_rule", F.lit("")), F.lit("]")))
    return f.withColumn("signature", sig)


def _ix_lists(cat: Catalog) -> DataFrame:
    keys = ["db_id", "table_name", "index_name"]
    cols = ordered_names(cat.index_cols, keys, "column_name", "cols", upper=False)
    i = cat.indexes.join(cols, keys, "left").withColumn("cols", F.coalesce("cols", F.array().cast("array<string>")))
    sig = F.concat(F.when(F.col("is_unique"), "U").otherwise("N"), F.lit("|"),
                   F.when(F.col("is_desc"), "D").otherwise("A"), F.lit("|"), F.upper(F.array_join("cols", "|")))
    return i.withColumn("signature", sig)


def _fk_sql(df):
    return R.add_fk(F.col("table_name"), F.col("fk_name"), F.col("cols"), F.col("ref_table"), F.col("ref_cols"),
                    F.col("update_rule"), F.col("delete_rule"))


def _ix_sql(df):
    return R.create_index(F.col("table_name"), F.col("index_name"), F.col("is_unique"), F.col("is_desc"), F.col("cols"))


# Ordering classes of ADD UNIQUE and ADD CHECK.
UNIQUE_CLASS, CHECK_CLASS = 42, 43


def _add_constraint(tail):
    return F.concat(F.lit("ALTER TABLE "), R.quote_ident(F.col("table_name")), F.lit(" ADD "),
                    F.when(R.is_integ_name(F.col("name")), F.lit(""))
                     .otherwise(F.concat(F.lit("CONSTRAINT "), R.quote_ident(F.col("name")), F.lit(" "))), tail, F.lit(";"))


def _unique_sql():
    return _add_constraint(F.concat(F.lit("UNIQUE ("), R.ident_list(F.col("cols")), F.lit(")")))


def _check_sql():
    body = R.strip_ws(F.col("check_sql"))
    return _add_constraint(F.when(F.upper(body).startswith("CHECK"), body)
                            .otherwise(F.concat(F.lit("CHECK ("), body, F.lit(")"))))


def diff_tables(src: Catalog, tgt: Catalog):
    s = _keyed_tables(src)
    t = _keyed_tables(tgt)
    missing = s.join(t.select("db_id", "tkey"), ["db_id", "tkey"], "left_anti")
    target_only = t.join(s.select("db_id", "tkey"), ["db_id", "tkey"], "left_anti")
    items = [_item(missing, "created", "TABLE", F.col("table_name"), F.col("table_name")),
             _item(target_only, "target_only", "TABLE", F.col("table_name"), F.col("table_name"))]
    m = missing.select("db_id", "table_name")

    def own(df):
        return df.join(m, ["db_id", "table_name"], "left_semi")
    # lists and definitions are made of the missing tables' rows alone
    new = Catalog(**{f: own(getattr(src, f)) if f in CHILDREN else getattr(src, f) for f in Catalog.__dataclass_fields__})
    defs = m.join(_column_defs(new), ["db_id", "table_name"], "left") \
            .withColumn("defs", F.coalesce("defs", F.array().cast("array<string>")))
    pk, fk, ix = _pk_lists(new), _fk_lists(new), _ix_lists(new)
    cmds = [
        _cmd(defs, 20, F.col("table_name"), F.lit(""), R.create_table(F.col("table_name"), F.col("defs"))),
        _cmd(pk, 40, F.col("table_name"), F.col("pk_name"), R.add_pk(F.col("table_name"), F.col("pk_name"), F.col("cols"))),
        _cmd(fk, 60, F.col("table_name"), F.col("fk_name"), _fk_sql(fk)),
        _cmd(ix, 50, F.col("table_name"), F.col("index_name"), _ix_sql(ix)),
    ]
    for kind, cls, sql in (("uniques", UNIQUE_CLASS, _unique_sql), ("checks", CHECK_CLASS, _check_sql)):
        if kind in src.extras:
            cmds.append(_cmd(own(src.extras[kind]), cls, F.col("table_name"), F.col("name"), sql()))
    return _union(items), _union(cmds)


# ---- columns (D02, D03) -----------------------------------------------------------

def _struct(cols, **values):
    return F.struct(*[values.get(c, F.lit(None).cast("string")).alias(c) for c in cols])


def diff_columns(src: Catalog, tgt: Catalog):
    """Columns of common tables, each side read once: one full outer join by
    (db_id, table, column), whose rows give up to three items and commands."""
    names = _common_tables(src, tgt).groupBy("db_id", "tkey").agg(F.collect_list("table_name").alias("s_tables"))
    sc = _with_tkey(src.columns).withColumn("ckey", F.upper("column_name")).join(
        names.select("db_id", "tkey").hint("merge"), ["db_id", "tkey"], "left_semi")
    compared = ("column_name", "sql_type", "nullable", "default_sql", "computed_sql")
    tc = (_with_tkey(tgt.columns).withColumn("ckey", F.upper("column_name")).join(names.hint("merge"), ["db_id", "tkey"])
          .select("db_id", "tkey", "ckey", "s_tables", *[F.col(c).alias("t_" + c) for c in compared], F.lit(True).alias("_t")))
    j = sc.withColumn("_s", F.lit(True)).join(tc.hint("merge"), ["db_id", "tkey", "ckey"], "full_outer")
    missing, extra, both = F.col("_t").isNull(), F.col("_s").isNull(), F.col("_s") & F.col("_t")
    same = lambda a: F.upper(F.col(a)).eqNullSafe(F.upper(F.col("t_" + a)))
    computed_differs = both & ~same("computed_sql")
    cmp = both & same("computed_sql")
    type_d, def_d = cmp & ~same("sql_type"), cmp & ~same("default_sql")
    null_d = cmp & ~F.col("nullable").eqNullSafe(F.col("t_nullable"))

    def item(cond, bucket, attr=None):
        return F.when(cond, _struct(ITEM_COLS[1:], bucket=F.lit(bucket), object_type=F.lit("COLUMN"), table_name=F.col("table_name"),
                                    name=F.col("column_name"), attr=F.lit(attr).cast("string")))

    only_target = F.when(extra, F.transform("s_tables", lambda t: _struct(
        ITEM_COLS[1:], bucket=F.lit("target_only"), object_type=F.lit("COLUMN"), table_name=t, name=F.col("t_column_name"))))
    found = F.array(item(missing, "created"), item(computed_differs, "warning", "COMPUTED"), item(type_d, "changed", "TYPE"),
                    item(null_d, "changed", "NULLABILITY"), item(def_d, "changed", "DEFAULT"))
    items = j.select("db_id", F.explode(F.concat(F.array_compact(found), F.coalesce(only_target, F.array()))).alias("i")).select("db_id", "i.*")

    charset = F.col("charset") if "charset" in src.columns.columns else None
    add_sql = F.concat(F.lit("ALTER TABLE "), R.quote_ident(F.col("table_name")), F.lit(" ADD "),
                       R.column_definition(F.col("column_name"), F.col("sql_type"), F.col("nullable"),
                                           F.col("default_sql"), F.col("computed_sql"), charset), F.lit(";"))
    alter = F.concat(F.lit("ALTER TABLE "), R.quote_ident(F.col("table_name")), F.lit(" ALTER COLUMN "),
                     R.quote_ident(F.col("column_name")))

    def cmd(cond, cls, mark, sql):
        return F.when(cond, F.struct(F.lit(cls).alias("class"), F.col("table_name").alias("table_name"),
                                     F.concat(F.col("column_name"), F.lit(mark)).alias("seq"), sql.alias("sql")))

    made = F.array(
        cmd(missing, 30, "", add_sql),
        cmd(type_d, 35, "#1", F.concat(alter, F.lit(" TYPE "), F.col("sql_type"), F.lit(";"))),
        cmd(null_d, 35, "#2", F.concat(alter, F.when(F.coalesce("nullable", F.lit(True)), F.lit(" DROP NOT NULL;"))
                                                .otherwise(F.lit(" SET NOT NULL;")))),
        cmd(def_d, 35, "#3", F.concat(alter, F.when(R.blank(F.col("default_sql")), F.lit(" DROP DEFAULT;"))
                                                .otherwise(F.concat(F.lit(" SET "), F.col("default_sql"), F.lit(";"))))))
    cmds = j.select("db_id", F.explode(F.array_compact(made)).alias("c")).select("db_id", "c.*")
    return items, cmds


# ---- primary keys (D04) -----------------------------------------------------------

def diff_pk(src: Catalog, tgt: Catalog):
    common = _common_tables(src, tgt)
    sp = _with_tkey(_pk_lists(src)).select("db_id", "tkey", "pk_name", "cols", "signature")
    tp = _with_tkey(_pk_lists(tgt)).select("db_id", "tkey", F.col("pk_name").alias("t_pk_name"),
                                           F.col("signature").alias("t_signature"))
    j = (common.join(sp, ["db_id", "tkey"], "left").join(tp, ["db_id", "tkey"], "left")
               .withColumn("s_sig", F.coalesce("signature", F.lit("")))
               .withColumn("t_sig", F.coalesce("t_signature", F.lit(""))))
    d = j.where(F.col("s_sig") != F.col("t_sig"))
    items = _item(d, "changed", "PK", F.col("table_name"), F.coalesce("pk_name", "t_pk_name"))
    drop = d.where(F.col("t_pk_name").isNotNull())
    add = d.where(F.col("pk_name").isNotNull())
    cmds = _union([
        _cmd(drop, 10, F.col("table_name"), F.col("t_pk_name"),
             F.concat(F.lit("ALTER TABLE "), R.quote_ident(F.col("table_name")), F.lit(" DROP CONSTRAINT "),
                      R.quote_ident(F.col("t_pk_name")), F.lit(";"))),
        _cmd(add, 40, F.col("table_name"), F.col("pk_name"),
             R.add_pk(F.col("table_name"), F.col("pk_name"), F.col("cols"))),
    ])
    return items, cmds


# ---- signature-keyed objects: FKs (D07), indexes (D08), duplicates (D09) -----------

def _with_first(df: DataFrame, name_col: str) -> DataFrame:
    """With the first member (by name) of each signature per table; rows
    without a signature or a name are no members. The group of a window is one
    signature of one table."""
    w = Window.partitionBy("db_id", "tkey", "signature")
    r = df.where(F.col("db_id").isNotNull() & F.col("tkey").isNotNull() & F.col("signature").isNotNull())
    r = r.withColumn("_first", F.min(F.struct(F.upper(name_col).alias("u"), F.col(name_col).alias("n"))).over(w)["n"])
    return r.where(F.col(name_col).isNotNull() & F.col("_first").isNotNull())


def _diff_by_signature(src_df, tgt_df, common, name_col, object_type, cls, sql_fn):
    """Each side is read once. First members meet by signature in one full
    outer join; each later member yields a ``first <-> later | signature``
    warning and is kept from meeting any row by its ``_place``."""
    def side(df, later):
        kept = _with_first(_with_tkey(df).join(common.select("db_id", "tkey").hint("merge"), ["db_id", "tkey"], "left_semi"), name_col)
        return kept.withColumn("_place", F.when(F.col(name_col) == F.col("_first"), 0).otherwise(later))
    keys = ["db_id", "tkey", "signature", "_place"]
    s = side(src_df, 1).withColumn("_s", F.lit(True))
    t = side(tgt_df, 2).select(*keys, F.col("table_name").alias("t_table"), F.col(name_col).alias("t_name"), F.col("_first").alias("t_first"), F.lit(True).alias("_t"))
    j = s.join(t.hint("merge"), keys, "full_outer").where(F.col("_s").isNull() | F.col("_t").isNull())

    def twin(label, first, name):
        return F.concat(F.lit(f"DUPLICATE_{label}: "), F.col(first), F.lit(" <-> "), F.col(name), F.lit(" | "), F.col("signature"))
    place = F.col("_place")
    missing = (place == 0) & F.col("_t").isNull()
    items = _one_pass(
        j, _item_when(missing, "created", object_type, F.col("table_name"), F.col(name_col)),
        _item_when((place == 0) & F.col("_s").isNull(), "target_only", object_type, F.col("t_table"), F.col("t_name")),
        _item_when(place == 1, "warning", object_type, F.col("table_name"), F.col(name_col), twin("SOURCE", "_first", name_col)),
        _item_when(place == 2, "warning", object_type, F.col("t_table"), F.col("t_name"), twin("TARGET", "t_first", "t_name")))
    new = j.where(missing)
    return items, _cmd(new, cls, F.col("table_name"), F.col(name_col), sql_fn(new))


def diff_fks(src: Catalog, tgt: Catalog):
    return _diff_by_signature(_fk_lists(src), _fk_lists(tgt), _common_tables(src, tgt), "fk_name", "FK", 60, _fk_sql)


def diff_indexes(src: Catalog, tgt: Catalog):
    return _diff_by_signature(_ix_lists(src), _ix_lists(tgt), _common_tables(src, tgt), "index_name", "INDEX",
                              50, _ix_sql)


# ---- routines (D12), views (D13), sequences (D11), domains (D10) ------------------

def _source_norm(c):
    """CRLF/CR -> LF, trimmed, compared case-insensitively."""
    unix = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.upper(R.strip_ws(unix))


def _source_digest(c):
    """Of a text as long as a script only a digest passes the join."""
    return F.sha2(_source_norm(c), 256)


def diff_routines(src: Catalog, tgt: Catalog):
    """Procedures, functions and triggers by upper name within a kind."""
    s = src.routines.withColumn("nkey", F.upper("name"))
    t = tgt.routines.withColumn("nkey", F.upper("name")).select(
        "db_id", "kind", "nkey", F.col("name").alias("t_name"), F.col("source").alias("t_source"))
    keys = ["db_id", "kind", "nkey"]
    j = s.join(t, keys, "full_outer")
    missing, only, both = F.col("t_name").isNull(), F.col("name").isNull(), F.col("name").isNotNull() & F.col("t_name").isNotNull()
    differs = both & (_source_norm(F.col("source")) != _source_norm(F.col("t_source")))
    cmd_rows = j.where(missing | differs)
    # a procedure's command declares its parameters where the catalog knows them
    cmd_rows = R.with_parameters(cmd_rows, src.extras.get("params"))
    sql = F.when(F.col("kind") == "PROCEDURE", R.create_procedure(F.col("name"), F.col("source"), F.col("params_in"), F.col("params_out"))) \
           .otherwise(R.psql_block(F.col("source")))
    items = _one_pass(j, _item_when(missing, "created", "ROUTINE", None, F.col("name"), F.col("kind")),
                      _item_when(only, "target_only", "ROUTINE", None, F.col("t_name"), F.col("kind")),
                      _item_when(differs, "warning", "ROUTINE", None, F.col("name"), F.col("kind")))
    cmds = _cmd(cmd_rows.withColumn("_sql", sql), R.routine_class(F.col("kind"), F.col("source")), F.lit(""),
                F.concat(F.col("kind"), F.lit(":"), F.col("name")), F.col("_sql"))
    return items, cmds


def diff_named(src_df: DataFrame | None, tgt_df: DataFrame | None, object_type: str, compare_cols: list[str],
               create_sql=None, cls: int = 70, warn_on_differs: bool = True, normalize=None):
    """Generic by-name diff for views, sequences and domains."""
    if src_df is None or tgt_df is None:
        return None, None
    # what is compared is made before the join: the target's texts stay where they are
    norm = normalize or (lambda c: F.upper(c.cast("string")))
    s = src_df.withColumn("nkey", F.upper("name")).withColumns({"s_" + c: norm(F.col(c)) for c in compare_cols})
    t = tgt_df.withColumn("nkey", F.upper("name")).select(
        "db_id", "nkey", F.col("name").alias("t_name"), *[norm(F.col(c)).alias("t_" + c) for c in compare_cols])
    j = s.join(t, ["db_id", "nkey"], "full_outer")
    missing, only = F.col("t_name").isNull(), F.col("name").isNull()
    found = [_item_when(missing, "created", object_type, None, F.col("name")),
             _item_when(only, "target_only", object_type, None, F.col("t_name"))]
    if compare_cols and warn_on_differs:
        cond = reduce(lambda a, b: a | b, [~F.col("s_" + c).eqNullSafe(F.col("t_" + c)) for c in compare_cols])
        found.append(_item_when(~only & ~missing & cond, "warning", object_type, None, F.col("name")))
    cmds = None
    if create_sql is not None:
        cmds = _cmd(j.where(missing), cls, F.lit(""), F.col("name"), create_sql)
    return _one_pass(j, *found), cmds


def _norm_check(c):
    """CR/LF/TAB separated words joined by one space, trimmed, upper."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n\t]+", " ")))


def _by_name_in_tables(src_df, tgt_df, common, name_col="name"):
    s = _with_tkey(src_df).withColumn("nkey", F.upper(name_col)).join(common.select("db_id", "tkey").hint("merge"), ["db_id", "tkey"], "left_semi")
    t = _with_tkey(tgt_df).withColumn("nkey", F.upper(name_col)).join(common.select("db_id", "tkey").hint("merge"), ["db_id", "tkey"], "left_semi")
    return s, t


def _named_in_tables(j, object_type, differs, cls, sql_fn):
    missing, only = F.col("t_name").isNull(), F.col("name").isNull()
    items = _one_pass(j, _item_when(missing, "created", object_type, F.col("table_name"), F.col("name")),
                      _item_when(only, "target_only", object_type, F.col("t_table"), F.col("t_name")),
                      _item_when(~missing & ~only & differs, "warning", object_type, F.col("table_name"), F.col("name")))
    return items, _cmd(j.where(missing), cls, F.col("table_name"), F.col("name"), sql_fn())


def diff_uniques(src: Catalog, tgt: Catalog):
    """Unique constraints by name on common tables; missing -> ADD UNIQUE;
    a different column list is a warning only. Extras ``uniques``:
    ``db_id, table_name, name, cols``."""
    if "uniques" not in src.extras or "uniques" not in tgt.extras:
        return None, None
    s, t = _by_name_in_tables(src.extras["uniques"], tgt.extras["uniques"], _common_tables(src, tgt))
    keys = ["db_id", "tkey", "nkey"]
    tt = t.select(*keys, F.col("name").alias("t_name"), F.col("cols").alias("t_cols"), F.col("table_name").alias("t_table"))
    j = s.join(tt, keys, "full_outer")
    return _named_in_tables(j, "UNIQUE", F.upper(F.array_join("cols", "|")) != F.upper(F.array_join("t_cols", "|")), UNIQUE_CLASS, _unique_sql)


def diff_checks(src: Catalog, tgt: Catalog):
    """Check constraints by name; normalised text differs -> warning.
    Extras ``checks``: ``db_id, table_name, name, check_sql``."""
    if "checks" not in src.extras or "checks" not in tgt.extras:
        return None, None
    s, t = _by_name_in_tables(src.extras["checks"], tgt.extras["checks"], _common_tables(src, tgt))
    keys = ["db_id", "tkey", "nkey"]
    tt = t.select(*keys, F.col("name").alias("t_name"), F.col("check_sql").alias("t_check"),
                  F.col("table_name").alias("t_table"))
    j = s.join(tt, keys, "full_outer")
    return _named_in_tables(j, "CHECK", _norm_check(F.col("check_sql")) != _norm_check(F.col("t_check")), CHECK_CLASS, _check_sql)


def diff_domains(src: Catalog, tgt: Catalog, db_charset=None):
    """D10 (opt-in): missing -> CREATE DOMAIN; type, nullability, default,
    check or charset differing -> warning. Implicit ``RDB$`` domains skipped."""
    if src.domains is None or tgt.domains is None:
        return None, None
    def user(d):
        d = d.where(~F.upper("name").startswith("RDB$"))
        return d if "charset" in d.columns else d.withColumn("charset", F.lit(None).cast("string"))
    sd, td = user(src.domains), user(tgt.domains)
    create = F.concat(
        F.lit("CREATE DOMAIN "), R.quote_ident(F.col("name")), F.lit(" AS "), F.col("sql_type"),
        F.when(R.blank(F.col("charset")), F.lit("")).otherwise(F.concat(F.lit(" CHARACTER SET "), F.col("charset"))),
        F.when(R.blank(F.col("default_sql")), F.lit("")).otherwise(F.concat(F.lit(" "), F.col("default_sql"))),
        F.when(F.coalesce("nullable", F.lit(True)), F.lit("")).otherwise(F.lit(" NOT NULL")),
        F.when(R.blank(F.col("check_sql")), F.lit("")).otherwise(F.concat(F.lit(" "), F.col("check_sql"))), F.lit(";"))
    return diff_named(sd, td, "DOMAIN", ["sql_type", "nullable", "default_sql", "check_sql", "charset"], create, 15)


def diff_sequences(src: Catalog, tgt: Catalog):
    """Existence only."""
    create = F.concat(F.lit("CREATE SEQUENCE "), R.quote_ident(F.col("name")), F.lit(";"))
    return diff_named(src.extras.get("sequences"), tgt.extras.get("sequences"), "SEQUENCE", [], create, 16)


def diff_views(src: Catalog, tgt: Catalog):
    """Missing -> CREATE VIEW; another text (line ends and case aside) -> warning only."""
    create = F.concat(F.lit("CREATE VIEW "), R.quote_ident(F.col("name")), F.lit(" AS "),
                      R.strip_ws(F.col("select_sql")), F.lit(";"))
    return diff_named(src.extras.get("views"), tgt.extras.get("views"), "VIEW", ["select_sql"], create, 25,
                      normalize=_source_digest)


# ---- whole diff, ordering (W06), summary (D14) -------------------------------------

def diff(src: Catalog, tgt: Catalog, include_domains: bool = False, keep=None) -> DiffResult:
    """``keep`` (frames -> one frame) may write the commands of each object
    kind before they are ordered; else they are one plan."""
    parts = [diff_tables(src, tgt), diff_columns(src, tgt), diff_pk(src, tgt), diff_fks(src, tgt),
             diff_indexes(src, tgt), diff_routines(src, tgt)]
    parts += [diff_sequences(src, tgt), diff_views(src, tgt), diff_uniques(src, tgt), diff_checks(src, tgt)]
    if include_domains:
        parts.append(diff_domains(src, tgt))
    items = _union([p[0] for p in parts if p[0] is not None])
    cmds = [p[1] for p in parts if p[1] is not None]
    return DiffResult(items, lambda: order_commands((keep or _union)(cmds), src), parts, src, keep)


def with_depth(cmds: DataFrame, src: Catalog) -> DataFrame:
    depth = fk_depth(src).select("db_id", F.upper("table_name").alias("_tk"), "depth")
    return (cmds.withColumn("_tk", F.upper("table_name"))
                .join(depth, ["db_id", "_tk"], "left")
                .withColumn("depth", F.coalesce("depth", F.lit(0)).cast("int")).drop("_tk"))


def order_commands(cmds: DataFrame, src: Catalog) -> DataFrame:
    """Class, FK depth, table (case-insensitive), original position."""
    return with_depth(cmds, src).orderBy("db_id", "class", "depth", F.upper("table_name"), "seq") \
                                .select("db_id", "class", "depth", "table_name", "seq", "sql")


def diff_summary(result: DiffResult) -> DataFrame:
    """Per database, commands and the four buckets, counted for each object
    kind apart; commands are counted by table before they meet its depth."""
    buckets = ("created", "changed", "target_only", "warning")
    items = result.keep([i.groupBy("db_id").agg(*[F.count_if(F.col("bucket") == k).alias(k) for k in buckets])
                         for i, _ in result.parts if i is not None])
    per_table = ["db_id", "table_name"]
    cmds = result.keep([c.groupBy(*per_table).agg(F.count(F.lit(1)).alias("n")) for _, c in result.parts if c is not None])
    b = items.groupBy("db_id").agg(*[F.sum(k).alias(k) for k in buckets])
    c = (with_depth(cmds.groupBy(*per_table).agg(F.sum("n").alias("n")), result.src)
         .groupBy("db_id").agg(F.sum("n").alias("commands")))
    return b.join(c, "db_id", "full_outer").fillna(0)


# ---- U04: apply and converge -----------------------------------------------------------

def apply_diff(src: Catalog, tgt: Catalog) -> Catalog:
    """The target after the change commands: missing tables (with keys,
    FKs, indexes), missing columns and changed attributes come from the
    source; signature-keyed objects are added; target-only objects stay
    (they are reported, never dropped); computed columns that differ stay
    as they are (warning only)."""
    from dataclasses import replace as dc_replace
    s_t, t_t = _keyed_tables(src), _keyed_tables(tgt)
    missing = s_t.join(t_t.select("db_id", "tkey"), ["db_id", "tkey"], "left_anti")
    tables = tgt.tables.unionByName(missing.select("db_id", "table_name"))

    cols_s = _with_tkey(src.columns).withColumn("ckey", F.upper("column_name"))
    cols_t = _with_tkey(tgt.columns).withColumn("ckey", F.upper("column_name"))
    common = s_t.join(t_t.select("db_id", "tkey", F.col("table_name").alias("t_name")), ["db_id", "tkey"])
    keys = ["db_id", "tkey", "ckey"]
    # columns present on both sides with equal computed text, or missing in the target
    present = cols_t.select(*keys, F.lit(1).alias("_p"), F.col("computed_sql").alias("_tc"))
    s_common = cols_s.join(common.select("db_id", "tkey"), ["db_id", "tkey"], "left_semi").join(present, keys, "left")
    adopt = s_common.where(F.col("_p").isNull() | F.upper("computed_sql").eqNullSafe(F.upper("_tc"))).drop("_p", "_tc")
    keep_t = cols_t.join(adopt.select(*keys), keys, "left_anti")
    new_tables_cols = cols_s.join(missing.select("db_id", "tkey"), ["db_id", "tkey"], "left_semi")
    col_names = tgt.columns.columns
    columns = (keep_t.select(*col_names)
               .unionByName(adopt.drop("table_name").join(common.select("db_id", "tkey", F.col("t_name").alias("table_name")),
                                                          ["db_id", "tkey"]).select(*col_names))
               .unionByName(new_tables_cols.select(*col_names)))

    # PKs: the source key for created tables and for tables whose key differs
    sp, tp = _with_tkey(_pk_lists(src)), _with_tkey(_pk_lists(tgt))
    diff_pk_tables = (common.select("db_id", "tkey")
                      .join(sp.select("db_id", "tkey", F.col("signature").alias("s")), ["db_id", "tkey"], "left")
                      .join(tp.select("db_id", "tkey", F.col("signature").alias("t")), ["db_id", "tkey"], "left")
                      .where(F.coalesce("s", F.lit("")) != F.coalesce("t", F.lit("")))
                      .select("db_id", "tkey"))
    replace_pk = diff_pk_tables.unionByName(missing.select("db_id", "tkey"))
    pks = (_with_tkey(tgt.pks).join(replace_pk, ["db_id", "tkey"], "left_anti").drop("tkey")
           .unionByName(_with_tkey(src.pks).join(replace_pk, ["db_id", "tkey"], "left_semi").drop("tkey")))
    pk_cols = (_with_tkey(tgt.pk_cols).join(replace_pk, ["db_id", "tkey"], "left_anti").drop("tkey")
               .unionByName(_with_tkey(src.pk_cols).join(replace_pk, ["db_id", "tkey"], "left_semi").drop("tkey")))

    # FKs and indexes: add source objects whose signature the target lacks
    def add_by_sig(src_l, tgt_l, name_col, base_t, base_s, cols_t_df, cols_s_df):
        miss = (_with_tkey(src_l).join(_with_tkey(tgt_l).select("db_id", "tkey", "signature"),
                                       ["db_id", "tkey", "signature"], "left_anti")
                .select("db_id", "table_name", name_col))
        k = ["db_id", "table_name", name_col]
        rows = base_t.unionByName(base_s.join(miss, k, "left_semi"))
        # member rows of the target's own objects, plus those of the added
        # ones; an added object may share its name with a target object
        crows = (cols_t_df.join(base_t.select(*k), k, "left_semi")
                 .unionByName(cols_s_df.join(miss, k, "left_semi")).dropDuplicates())
        return rows, crows

    fks, fk_cols = add_by_sig(_fk_lists(src), _fk_lists(tgt), "fk_name", tgt.fks, src.fks, tgt.fk_cols, src.fk_cols)
    indexes, index_cols = add_by_sig(_ix_lists(src), _ix_lists(tgt), "index_name", tgt.indexes, src.indexes,
                                     tgt.index_cols, src.index_cols)
    # routines: created or replaced by the source definition
    rk = ["db_id", "kind", "nkey"]
    rs = src.routines.withColumn("nkey", F.upper("name"))
    rt = tgt.routines.withColumn("nkey", F.upper("name"))
    routines = rt.join(rs.select(*rk), rk, "left_anti").unionByName(rs.select(*rt.columns)).drop("nkey")

    # by name: objects the target lacks are added, those it has stay
    def add_by_name(s, t, keys):
        def keyed(df):
            return df.select("*", *[F.upper(k).alias("_" + k) for k in keys])
        on = ["db_id", *["_" + k for k in keys]]
        return t.unionByName(keyed(s).join(keyed(t).select(*on), on, "left_anti").select(*t.columns))

    extras = dict(tgt.extras)
    for kind, keys in (("uniques", ["table_name", "name"]), ("checks", ["table_name", "name"]),
                       ("sequences", ["name"]), ("views", ["name"])):
        if kind in src.extras and kind in tgt.extras:
            extras[kind] = add_by_name(src.extras[kind], tgt.extras[kind], keys)
    domains = tgt.domains
    if src.domains is not None and tgt.domains is not None:
        domains = add_by_name(src.domains, tgt.domains, ["name"])
    return dc_replace(tgt, tables=tables, columns=columns, pks=pks, pk_cols=pk_cols, fks=fks, fk_cols=fk_cols,
                      indexes=indexes, index_cols=index_cols, routines=routines, domains=domains, extras=extras)


def convergence(src: Catalog, tgt: Catalog, keep=None) -> DataFrame:
    """created/changed items left after applying the diff (expected empty).
    ``keep`` may write each table of the catalog that comes out: it is read
    several times, and both plans stay small."""
    out = apply_diff(src, tgt)
    if keep is not None:
        for name in ("tables", *CHILDREN):
            setattr(out, name, keep(getattr(out, name)))
        for kind in ("uniques", "checks"):
            if kind in out.extras:
                out.extras[kind] = keep(out.extras[kind])
    after = diff(src, out, include_domains=True).items
    return after.where(F.col("bucket").isin("created", "changed"))
