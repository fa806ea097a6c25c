"""Structural, compatibility and PSQL risk rules over a fleet catalog.

Every rule is a join, anti-join or aggregate over all databases at once and
returns ``db_id, code, severity, scope`` (default severity; overrides and
scores are applied by ``findings.score_findings``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ddl
from .catalog import TABLE_KEYS, Catalog, ordered_names
from .monitor import operational_findings

FINDING_COLS = ["db_id", "code", "severity", "scope"]


def _shared(cat: Catalog, key, build):
    """Intermediates used by several rules (index column lists, FK state,
    column keys) are one plan for each catalog, so the rules of an audit reuse
    its exchanges. They are not persisted: they are as large as the catalog."""
    memo = cat.extras.setdefault("_shared", {})
    if key not in memo:
        memo[key] = build()
    return memo[key]


def _finding(df: DataFrame, code: str, severity: str, scope) -> DataFrame:
    return df.select("db_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                     scope.alias("scope"))


def _dot(*cols) -> F.Column:
    return F.concat_ws(".", *[F.col(c) for c in cols])


def normalize_prefixes(prefixes) -> list[str]:
    seen, out = set(), []
    for p in prefixes or ():
        if p is None or not p.strip():
            continue
        key = p.strip().upper()
        if key not in seen:
            seen.add(key)
            out.append(key)
    return out


def _prefix_match(name_col: F.Column, prefixes: list[str]) -> F.Column:
    return reduce(lambda a, b: a | b, [F.upper(name_col).startswith(p) for p in prefixes])


def visible_tables(cat: Catalog, prefixes=()) -> DataFrame:
    """Tables whose name does not start with an ignored prefix."""
    p = normalize_prefixes(prefixes)
    t = cat.tables.withColumn("tkey", F.upper("table_name"))
    return t.where(~_prefix_match(F.col("table_name"), p)) if p else t


def ignored_tables(cat: Catalog, prefixes=()) -> DataFrame:
    p = normalize_prefixes(prefixes)
    t = cat.tables.withColumn("tkey", F.upper("table_name"))
    return t.where(_prefix_match(F.col("table_name"), p)) if p else t.limit(0)


def _vis_keys(cat, prefixes):
    return visible_tables(cat, prefixes).select(*TABLE_KEYS)


def _visible(df: DataFrame, cat: Catalog, prefixes) -> DataFrame:
    """Rows of ``df`` that belong to a visible table. Catalog child rows
    (columns, keys, indexes) always belong to a catalog table, so without
    prefixes this is the identity and costs no join."""
    if not normalize_prefixes(prefixes):
        return df
    return df.join(_vis_keys(cat, prefixes), TABLE_KEYS, "left_semi")


def _col_groups(cat: Catalog) -> DataFrame:
    """Columns of one name in a table: their number and the first by ordinal."""
    return _shared(cat, "col_groups", lambda: _groups(cat.columns))


def _groups(columns: DataFrame) -> DataFrame:
    return (columns.groupBy(*TABLE_KEYS, F.upper("column_name").alias("ckey"))
                   .agg(F.count(F.lit(1)).alias("n"), F.min_by("column_name", "ordinal").alias("column_name")))


def _col_keys(cat: Catalog) -> DataFrame:
    return _col_groups(cat).select(*TABLE_KEYS, "ckey")


def keep_shared(cat: Catalog, keep) -> None:
    """Write what several rules read: ``keep(frame, *order)`` gives the frame
    from its table. Rules that run after it read that instead of the plan."""
    memo = cat.extras.setdefault("_shared", {})
    if "kept" not in memo:
        for key, frame, order in (("col_groups", _col_groups(cat), ("table_name", "ckey")), ("index_lists", _index_lists(cat), ("table_name",))):
            memo[key] = keep(frame, *order)
        memo["kept"] = True


# ---- table structure -------------------------------------------------------

def rule_table_without_columns(cat: Catalog, prefixes=()) -> DataFrame:
    vis = _vis_keys(cat, prefixes)
    hit = vis.join(cat.columns.select(*TABLE_KEYS), TABLE_KEYS, "left_anti")
    return _finding(hit, "TABELA_SEM_COLUNAS", "critical", F.col("table_name"))


def rule_duplicated_column(cat: Catalog, prefixes=()) -> DataFrame:
    groups = _visible(_col_groups(cat), cat, prefixes).where("n > 1")
    return _finding(groups, "COLUNA_DUPLICADA", "critical", _dot("table_name", "column_name"))


def rule_unknown_type(cat: Catalog, prefixes=()) -> DataFrame:
    cols = _visible(cat.columns, cat, prefixes)
    hit = cols.where(F.upper("sql_type").startswith("TYPE_"))
    return _finding(hit, "TIPO_DESCONHECIDO", "high", _dot("table_name", "column_name"))


def rule_table_without_pk(cat: Catalog, prefixes=()) -> DataFrame:
    hit = _vis_keys(cat, prefixes).join(cat.pks.select(*TABLE_KEYS), TABLE_KEYS, "left_anti")
    return _finding(hit, "TABELA_SEM_PK", "high", F.col("table_name"))


def rule_pk_without_columns(cat: Catalog, prefixes=()) -> DataFrame:
    pks = _visible(cat.pks, cat, prefixes)
    hit = pks.join(cat.pk_cols.select(*TABLE_KEYS, "pk_name"), TABLE_KEYS + ["pk_name"], "left_anti")
    return _finding(hit, "PK_SEM_COLUNAS", "critical", F.col("table_name"))


def rule_pk_missing_column(cat: Catalog, prefixes=()) -> DataFrame:
    # key columns always belong to a declared key of their table
    pkc = _visible(cat.pk_cols, cat, prefixes).withColumn("ckey", F.upper("column_name"))
    hit = pkc.join(_col_keys(cat), TABLE_KEYS + ["ckey"], "left_anti")
    return _finding(hit, "PK_REFERENCIA_COLUNA_INEXISTENTE", "critical", F.col("table_name"))


# ---- foreign keys ----------------------------------------------------------

FK_KEYS = TABLE_KEYS + ["fk_name"]


def fk_frame(cat: Catalog, prefixes=()) -> DataFrame:
    """FKs of visible tables with local/ref column counts and state flags."""
    if not normalize_prefixes(prefixes):
        return _shared(cat, "fk_frame", lambda: _fk_frame(cat, ()))
    return _fk_frame(cat, prefixes)


def _fk_frame(cat: Catalog, prefixes=()) -> DataFrame:
    counts = cat.fk_cols.groupBy(*FK_KEYS).agg(
        F.count("column_name").alias("n_local"), F.count("ref_column").alias("n_ref"))
    fks = (_visible(cat.fks, cat, prefixes)
                  .join(counts, FK_KEYS, "left")
                  .fillna(0, ["n_local", "n_ref"])
                  .withColumn("rkey", F.upper("ref_table")))
    if normalize_prefixes(prefixes):
        ign = ignored_tables(cat, prefixes).select("db_id", F.col("tkey").alias("rkey")).distinct()
        fks = (fks.join(ign.withColumn("ref_ignored", F.lit(True)), ["db_id", "rkey"], "left")
                  .withColumn("ref_ignored", F.coalesce("ref_ignored", F.lit(False))))
    else:
        fks = fks.withColumn("ref_ignored", F.lit(False))
    return fks.withColumn("valid", (F.col("n_local") > 0) & (F.col("n_ref") > 0))


def rule_fk_without_columns(cat: Catalog, prefixes=()) -> DataFrame:
    hit = fk_frame(cat, prefixes).where(~F.col("valid"))
    return _finding(hit, "FK_SEM_COLUNAS", "critical", _dot("table_name", "fk_name"))


def rule_fk_invalid_cardinality(cat: Catalog, prefixes=()) -> DataFrame:
    hit = fk_frame(cat, prefixes).where(F.col("valid") & (F.col("n_local") != F.col("n_ref")))
    return _finding(hit, "FK_CARDINALIDADE_INVALIDA", "critical", _dot("table_name", "fk_name"))


def rule_fk_missing_local_column(cat: Catalog, prefixes=()) -> DataFrame:
    valid = fk_frame(cat, prefixes).where("valid").select(*FK_KEYS)
    local = (cat.fk_cols.where(F.col("column_name").isNotNull())
                        .join(valid, FK_KEYS, "left_semi")
                        .withColumn("ckey", F.upper("column_name")))
    hit = local.join(_col_keys(cat), TABLE_KEYS + ["ckey"], "left_anti")
    return _finding(hit, "FK_COLUNA_LOCAL_INEXISTENTE", "critical", _dot("table_name", "fk_name"))


def _active_fks(cat, prefixes):
    """Structurally valid FKs whose referenced table is not ignored."""
    return fk_frame(cat, prefixes).where(F.col("valid") & ~F.col("ref_ignored"))


def rule_fk_missing_referenced_table(cat: Catalog, prefixes=()) -> DataFrame:
    vis = visible_tables(cat, prefixes).select("db_id", F.col("tkey").alias("rkey"))
    hit = _active_fks(cat, prefixes).join(vis, ["db_id", "rkey"], "left_anti")
    return _finding(hit, "FK_TABELA_REFERENCIA_INEXISTENTE", "critical", _dot("table_name", "fk_name"))


def rule_fk_missing_referenced_column(cat: Catalog, prefixes=()) -> DataFrame:
    vis = visible_tables(cat, prefixes).select("db_id", F.col("tkey").alias("rkey"))
    fks = _active_fks(cat, prefixes).join(vis, ["db_id", "rkey"], "left_semi").select(*FK_KEYS, "rkey")
    refs = (cat.fk_cols.where(F.col("ref_column").isNotNull())
                       .join(fks, FK_KEYS)
                       .withColumn("ckey", F.upper("ref_column")))
    ref_cols = _col_keys(cat).select("db_id", F.upper("table_name").alias("rkey"), "ckey")
    hit = refs.join(ref_cols, ["db_id", "rkey", "ckey"], "left_anti")
    return _finding(hit, "FK_COLUNA_REFERENCIA_INEXISTENTE", "critical", _dot("table_name", "fk_name"))


def index_column_lists(cat: Catalog) -> DataFrame:
    """db_id, table_name, index_name, cols (upper, by ordinal; [] when none)."""
    return _index_lists(cat).drop("n_cols")


def _index_lists(cat: Catalog) -> DataFrame:
    """``n_cols`` is the number of the index's segments, NULL when there is none."""
    def build():
        name = F.when(F.col("column_name").isNotNull(), F.struct(F.col("ordinal").alias("o"), F.upper("column_name").alias("v")))
        lists = (cat.index_cols.groupBy(*IX_KEYS).agg(F.sort_array(F.collect_list(name)).alias("_pairs"), F.count(F.lit(1)).alias("n_cols"))
                 .select(*IX_KEYS, F.col("_pairs.v").alias("cols"), "n_cols"))
        return (cat.indexes.join(lists, IX_KEYS, "left")
                           .withColumn("cols", F.coalesce("cols", F.array().cast("array<string>"))))
    return _shared(cat, "index_lists", build)


def index_prefixes(idx: DataFrame) -> DataFrame:
    """One row per (index, k) with the first k columns; rows grow with the
    number of index segments, not with pairs of indexes."""
    return (idx.where(F.size("cols") > 0)
               .select("*", F.explode(F.sequence(F.lit(1), F.size("cols"))).alias("k"))
               .withColumn("prefix", F.slice("cols", F.lit(1), F.col("k"))))


def rule_fk_without_covering_index(cat: Catalog, prefixes=()) -> DataFrame:
    fks = _active_fks(cat, prefixes).where(F.trim(F.coalesce("support_index", F.lit(""))) == "")
    fk_lists = ordered_names(cat.fk_cols, FK_KEYS, "column_name", "prefix")
    cand = fks.join(fk_lists, FK_KEYS)
    # lists of the candidates' tables alone are cut into prefixes
    lists = index_column_lists(cat).join(cand.select(*TABLE_KEYS), TABLE_KEYS, "left_semi")
    covers = index_prefixes(lists).select(*TABLE_KEYS, "prefix")
    hit = cand.join(covers, TABLE_KEYS + ["prefix"], "left_anti")
    return _finding(hit, "FK_SEM_INDICE_COBERTURA", "medium", _dot("table_name", "fk_name"))


def fk_signatures(cat: Catalog, prefixes=()) -> DataFrame:
    """``A|B->T(X|Y)[UPD|DEL]`` per FK, all upper."""
    local = ordered_names(cat.fk_cols, FK_KEYS, "column_name", "local_cols")
    ref = ordered_names(cat.fk_cols, FK_KEYS, "ref_column", "ref_cols")
    fks = (_visible(cat.fks, cat, prefixes)
                  .join(local, FK_KEYS, "left").join(ref, FK_KEYS, "left"))
    empty = F.array().cast("array<string>")
    sig = F.concat(
        F.array_join(F.coalesce("local_cols", empty), "|"), F.lit("->"), F.upper("ref_table"),
        F.lit("("), F.array_join(F.coalesce("ref_cols", empty), "|"), F.lit(")["),
        F.upper(F.coalesce("update_rule", F.lit(""))), F.lit("|"),
        F.upper(F.coalesce("delete_rule", F.lit(""))), F.lit("]"))
    return fks.withColumn("signature", sig)


def rule_duplicated_fk(cat: Catalog, prefixes=()) -> DataFrame:
    groups = (fk_signatures(cat, prefixes).groupBy(*TABLE_KEYS, "signature")
              .agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return _finding(groups, "FK_DUPLICADA", "low", F.col("table_name"))


# ---- indexes ---------------------------------------------------------------

IX_KEYS = TABLE_KEYS + ["index_name"]


def rule_index_without_columns(cat: Catalog, prefixes=()) -> DataFrame:
    hit = _visible(_index_lists(cat), cat, prefixes).where(F.col("n_cols").isNull())
    return _finding(hit, "INDICE_SEM_COLUNAS", "high", _dot("table_name", "index_name"))


def rule_index_missing_column(cat: Catalog, prefixes=()) -> DataFrame:
    items = _visible(cat.index_cols, cat, prefixes).withColumn("ckey", F.upper("column_name"))
    hit = (items.join(_col_keys(cat), TABLE_KEYS + ["ckey"], "left_anti")
                .where(~ddl.is_index_expression(F.col("column_name"))))
    return _finding(hit, "INDICE_COLUNA_INEXISTENTE", "high", _dot("table_name", "index_name"))


def index_signatures(cat: Catalog, prefixes=()) -> DataFrame:
    """``U|D|A|B`` per index (empty column lists included)."""
    idx = _visible(index_column_lists(cat), cat, prefixes)
    sig = F.concat(F.when(F.col("is_unique"), "U").otherwise("N"), F.lit("|"),
                   F.when(F.col("is_desc"), "D").otherwise("A"), F.lit("|"),
                   F.array_join("cols", "|"))
    return idx.withColumn("signature", sig)


def rule_duplicated_index(cat: Catalog, prefixes=()) -> DataFrame:
    groups = (index_signatures(cat, prefixes).groupBy(*TABLE_KEYS, "signature")
              .agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return _finding(groups, "INDICE_DUPLICADO", "low", F.col("table_name"))


def redundant_prefix_pairs(cat: Catalog, prefixes=()) -> DataFrame:
    """J13 + W03: each non-unique index whose column list is a strict prefix
    of another non-unique index in the same direction, with the first such
    longer index by name. Equi-join on (table, direction, column list) against
    exploded strict prefixes: no pair enumeration inside a table."""
    idx = (_visible(index_column_lists(cat), cat, prefixes)
                                  .where(~F.col("is_unique") & (F.size("cols") > 0)))
    # first longer index per (table, direction, strict prefix): aggregated
    # before the join, so a prefix shared by many indexes stays one row
    longer = (index_prefixes(idx).where(F.col("k") < F.size("cols"))
              .groupBy(*TABLE_KEYS, "is_desc", "prefix")
              .agg(F.min_by("index_name", F.upper("index_name")).alias("long_name")))
    short = idx.select(*TABLE_KEYS, "is_desc", F.col("cols").alias("prefix"), F.col("index_name").alias("short_name"))
    return short.join(longer, TABLE_KEYS + ["is_desc", "prefix"]).select(*TABLE_KEYS, "short_name", "long_name")


def rule_redundant_prefix_index(cat: Catalog, prefixes=()) -> DataFrame:
    return _finding(redundant_prefix_pairs(cat, prefixes), "INDICE_REDUNDANTE_PREFIXO", "medium",
                    F.col("table_name"))


# ---- PSQL routines ---------------------------------------------------------

def _routines(cat: Catalog) -> DataFrame:
    r = cat.routines.where(F.col("kind").isin("PROCEDURE", "FUNCTION", "TRIGGER"))
    return r.where(~((F.col("kind") == "PROCEDURE") & F.coalesce("ignore_body", F.lit(False))))


def rule_routine_without_body(cat: Catalog, prefixes=()) -> DataFrame:
    hit = _routines(cat).where(~ddl.has_executable(F.col("source")))
    return hit.select("db_id", F.concat("kind", F.lit("_SEM_CORPO")).alias("code"),
                      F.lit("critical").alias("severity"), F.col("name").alias("scope"))


def rule_routine_only_suspend(cat: Catalog, prefixes=()) -> DataFrame:
    hit = _routines(cat).where(F.coalesce(ddl.normalized_body(F.col("source")) == "SUSPEND", F.lit(False)))
    return hit.select("db_id", F.concat("kind", F.lit("_SOMENTE_SUSPEND")).alias("code"),
                      F.lit("high").alias("severity"), F.col("name").alias("scope"))


# ---- field compatibility (C01-C05; ignore the prefix filter) ---------------

def field_audit(cat: Catalog, include_ok: bool = False) -> DataFrame:
    """Per column (and domain) the compatibility status: code or OK."""
    cols = cat.columns.join(cat.databases, "db_id", "left").select(
        "db_id", F.lit("column").alias("object_type"), _dot("table_name", "column_name").alias("scope"),
        "sql_type", "bytes_per_char", "major")
    if cat.domains is not None:
        doms = cat.domains.join(cat.databases, "db_id", "left").select(
            "db_id", F.lit("domain").alias("object_type"),
            F.concat(F.lit("DOMINIO."), F.col("name")).alias("scope"), "sql_type", "bytes_per_char", "major")
        cols = doms.unionByName(cols)
    code = ddl.field_compat(F.col("sql_type"), F.col("bytes_per_char"), F.col("major"))
    out = cols.withColumn("code", F.coalesce(code, F.lit("OK"))) \
              .withColumn("status", F.when(F.col("code") == "OK", "ok").otherwise("critical"))
    return out if include_ok else out.where(F.col("status") != "ok")


def rule_field_compat(cat: Catalog, prefixes=()) -> DataFrame:
    hit = field_audit(cat)
    return hit.select("db_id", "code", F.lit("critical").alias("severity"), "scope")


RULES = {
    "TABELA_SEM_COLUNAS": rule_table_without_columns,
    "COLUNA_DUPLICADA": rule_duplicated_column,
    "TIPO_DESCONHECIDO": rule_unknown_type,
    "TABELA_SEM_PK": rule_table_without_pk,
    "PK_SEM_COLUNAS": rule_pk_without_columns,
    "PK_REFERENCIA_COLUNA_INEXISTENTE": rule_pk_missing_column,
    "FK_SEM_COLUNAS": rule_fk_without_columns,
    "FK_CARDINALIDADE_INVALIDA": rule_fk_invalid_cardinality,
    "FK_COLUNA_LOCAL_INEXISTENTE": rule_fk_missing_local_column,
    "FK_TABELA_REFERENCIA_INEXISTENTE": rule_fk_missing_referenced_table,
    "FK_COLUNA_REFERENCIA_INEXISTENTE": rule_fk_missing_referenced_column,
    "FK_SEM_INDICE_COBERTURA": rule_fk_without_covering_index,
    "FK_DUPLICADA": rule_duplicated_fk,
    "INDICE_SEM_COLUNAS": rule_index_without_columns,
    "INDICE_COLUNA_INEXISTENTE": rule_index_missing_column,
    "INDICE_DUPLICADO": rule_duplicated_index,
    "INDICE_REDUNDANTE_PREFIXO": rule_redundant_prefix_index,
    "PSQL_SEM_CORPO": rule_routine_without_body,
    "PSQL_SOMENTE_SUSPEND": rule_routine_only_suspend,
    "CAMPO": rule_field_compat,
}


def all_rule_findings(cat: Catalog, prefixes=()) -> DataFrame:
    """Union of every rule's output, and of the operational findings
    of the catalog's databases where it carries monitor samples."""
    frames = [fn(cat, prefixes).select(*FINDING_COLS) for fn in RULES.values()]
    if "samples" in cat.extras:
        seen = operational_findings(cat.extras["samples"], cat.extras["own_attachments"])
        frames.append(seen.join(cat.databases, "db_id", "left_semi").select(*FINDING_COLS))
    return reduce(DataFrame.unionByName, frames)
