"""Relational catalog of a fleet of databases.

Each attribute is a DataFrame keyed by ``db_id``; names compare
case-insensitively, so operators join on ``upper(name)`` keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from weakref import WeakKeyDictionary

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import fixture, register_fixtures

TABLE_KEYS = ["db_id", "table_name"]


@dataclass
class Catalog:
    tables: DataFrame        # db_id, table_name
    columns: DataFrame       # db_id, table_name, ordinal, column_name, sql_type, bytes_per_char, nullable, default_sql, computed_sql
    pks: DataFrame           # db_id, table_name, pk_name
    pk_cols: DataFrame       # db_id, table_name, pk_name, ordinal, column_name
    fks: DataFrame           # db_id, table_name, fk_name, ref_table, support_index, update_rule, delete_rule
    fk_cols: DataFrame       # db_id, table_name, fk_name, ordinal, column_name, ref_column
    indexes: DataFrame       # db_id, table_name, index_name, is_unique, is_desc
    index_cols: DataFrame    # db_id, table_name, index_name, ordinal, column_name
    routines: DataFrame      # db_id, kind, name, ignore_body, source
    databases: DataFrame     # db_id, major
    domains: DataFrame | None = None  # db_id, name, sql_type, bytes_per_char, nullable, default_sql, check_sql
    extras: dict = field(default_factory=dict)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> "Catalog":
        """Keep the exploded tables for the ~36 rules that share them;
        lineage stays intact so a lost executor recomputes its blocks."""
        names = ["tables", "columns", "pks", "pk_cols", "fks", "fk_cols",
                 "indexes", "index_cols", "routines", "databases"]
        return replace(self, **{n: getattr(self, n).persist(level) for n in names})


class LazyExtras(dict):
    """Extras whose callables are called when their entry is first read."""

    def __getitem__(self, key):
        value = super().__getitem__(key)
        if callable(value):
            value = self[key] = value()
        return value

    def get(self, key, default=None):
        return self[key] if key in self else default

    def __iter__(self):  # dict(extras) reads the entries through __getitem__
        return super().__iter__()


class LazyCatalog(Catalog):
    """A catalog whose tables are callables, called when first read, so that
    a query makes only the tables it reads."""

    def __init__(self, **tables):
        self._make = {k: v for k, v in tables.items() if callable(v)}
        for k, v in tables.items():
            if k not in self._make:
                setattr(self, k, v)

    def __getattr__(self, name):
        if name.startswith("_") or name not in self._make:
            raise AttributeError(name)
        setattr(self, name, self._make[name]())
        return getattr(self, name)


_catalogs: WeakKeyDictionary[SparkSession, dict] = WeakKeyDictionary()


def fixture_catalog(spark: SparkSession, sf_dir: str, side: str = "fleet") -> Catalog:
    """Catalog over the fx views. ``side='target'`` gives the diff target
    (fx_t_*), ``side='source'`` the diff source (unique column names).
    DataFrames are immutable plans, so one Catalog per session is reused."""
    known = _catalogs.setdefault(spark, {})
    if (sf_dir, side) not in known:
        known[sf_dir, side] = _build_catalog(spark, sf_dir, side)
    register_fixtures(spark, sf_dir, lines=False)
    return known[sf_dir, side]


def _build_catalog(spark: SparkSession, sf_dir: str, side: str) -> Catalog:
    def t(name, *cols):
        return lambda: fixture(spark, sf_dir, name).select(*cols)

    p = "fx_t_" if side == "target" else "fx_"
    column = ["db_id", "table_name", "ordinal", "column_name", "sql_type", "nullable", "default_sql", "computed_sql"]
    if side == "fleet":
        columns = t("fx_column", *column[:5], "bytes_per_char", *column[5:])
        monitor = t("fx_monitor", "*")
        # the monitoring connection of database d is attachment d in the fixture
        extras = {"samples": monitor,
                  "own_attachments": lambda: monitor().select("db_id").distinct().withColumn("own_attachment_id", F.col("db_id"))}
        domains = t("fx_f_domain", "*")
    else:
        columns = t("fx_u_column" if side == "source" else "fx_t_column", *column)
        extras = {
            "uniques": lambda: ordered_names(t(p + "unique", "*")(), ["db_id", "table_name", "name"], "column_name", "cols", upper=False),
            "checks": t(p + "check", "db_id", "table_name", "name", "check_sql"),
            "sequences": t(p + "sequence", "db_id", "name"),
            "views": t(p + "view", "db_id", "name", "select_sql")}
        domains = t(p + "domain", "db_id", "name", "sql_type", "nullable", "default_sql", "check_sql", "charset")
    ignore_body = F.lit(False).alias("ignore_body") if side == "target" else "ignore_body"
    return LazyCatalog(
        tables=t(p + "table", "db_id", "table_name"),
        columns=columns,
        pks=t(p + "pk", "db_id", "table_name", "pk_name"),
        pk_cols=t(p + "pk_col", "db_id", "table_name", "pk_name", "ordinal", "column_name"),
        fks=t(p + "fk", "db_id", "table_name", "fk_name", "ref_table", "support_index", "update_rule", "delete_rule"),
        fk_cols=t("fx_fk_col", "db_id", "table_name", "fk_name", "ordinal", "column_name", "ref_column"),
        indexes=t(p + "index", "db_id", "table_name", "index_name", "is_unique", "is_desc"),
        index_cols=t("fx_index_col", "db_id", "table_name", "index_name", "ordinal", "column_name"),
        routines=t(p + "routine", "db_id", "kind", "name", ignore_body, "source"),
        databases=t("fx_database", "db_id", "major"),
        domains=domains(),
        extras=LazyExtras(extras),
    )


def ordered_names(df: DataFrame, keys: list[str], name_col: str, out: str,
                  upper: bool = True) -> DataFrame:
    """Per key, the list of ``name_col`` ordered by ``ordinal`` (nulls
    skipped). Groups are single constraints or indexes, bounded by the
    catalog's segment limit, never a whole table or database."""
    val = F.upper(F.col(name_col)) if upper else F.col(name_col)
    return (df.where(F.col(name_col).isNotNull())
              .groupBy(*keys)
              .agg(F.sort_array(F.collect_list(F.struct(F.col("ordinal").alias("o"), val.alias("v"))))
                   .alias("_pairs"))
              .select(*keys, F.col("_pairs.v").alias(out)))
