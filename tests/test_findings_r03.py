"""Findings of round 3: catalog tables are made when read, line items are shuffled once, columns compared in one pass."""

from __future__ import annotations

import datetime as dt

from catwarden.operators import diff as D
from catwarden.operators.catalog import Catalog, LazyCatalog, LazyExtras
from catwarden.sources import fixtures as X
from catwarden.sources.tables import BASE_TABLES, read_table

from .catalog_builder import DDL, build

SMALL_SF = "/root/testdata/sf0.001"


def _folder(spark, path):
    """Own orders (a key twice, a null key) and line items (repeated, without an order, nulls); the other tables are empty."""
    day = dt.datetime(2020, 1, 1)
    orders = [(k, k % 7, "OFP"[k % 3], 1.0, day, "5-LOW") for k in (1, 2, 3, 3, 29, 31, 60, 130)] + [(None, 1, "O", 1.0, day, "5-LOW")]
    lines = [(k, p, p % 23, n, float(p % 50), 2.0 * p, .0, .0, "RN"[p % 2], "O", day) for k in (1, 3, 29, 31, 60, 130, 999)
             for n, p in enumerate((5, 17, 17, 41, 38, 19, 12), 1)]
    lines += [lines[1], (3, 29, 3, 2, None, 1.0, .0, .0, None, "O", day), (1, None, None, None, 1.0, 1.0, .0, .0, "R", "O", None),
              (None, 1, 1, 1, 1.0, 1.0, .0, .0, "R", "O", day)]
    for name in BASE_TABLES:
        schema = read_table(spark, SMALL_SF, name).schema
        rows = {"orders": orders, "lineitem": lines}.get(name, [])
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_line_views_give_the_rows_of_their_sql(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    X.register_fixtures(spark, folder, lines=False)
    assert folder not in X._written.get(spark, {})  # nothing written for queries of other tables
    want = {}
    for name, sql in X.FX_VIEWS:
        if name in X.OVER_LINES:
            spark.sql(sql).createOrReplaceTempView(name)
            if name in X.LINE_VIEWS:
                want[name] = sorted(map(str, spark.table(name).collect()))
    for name, rows in want.items():
        assert rows and sorted(map(str, X.fixture(spark, folder, name).collect())) == rows, name


def test_lazy_catalog_makes_what_is_read():
    made = []
    cat = LazyCatalog(**{n: (lambda n=n: made.append(n) or n) for n in Catalog.__dataclass_fields__ if n not in ("domains", "extras")},
                      domains=None, extras=LazyExtras(views=lambda: made.append("views") or "v"))
    assert (cat.fks, cat.fks, made) == ("fks", "fks", ["fks"])
    assert dict(cat.extras) == {"views": "v"} and made == ["fks", "views"]


def test_column_diff_reads_each_side_once_and_broadcasts_nothing(spark):
    src = build(spark, DDL().table("A", ("ID", "INTEGER"), ("N", "BIGINT"), ("NEW", "BIGINT")))
    tgt = build(spark, DDL().table("a", ("id", "BIGINT"), ("n", "BIGINT"), ("OLD", "BIGINT")))
    items, cmds = D.diff_columns(src, tgt)
    assert sorted((r.bucket, r.table_name, r.name, r.attr) for r in items.collect()) == [
        ("changed", "A", "ID", "TYPE"), ("created", "A", "NEW", None), ("target_only", "A", "OLD", None)]
    assert sorted(r["class"] for r in cmds.collect()) == [30, 35]
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Union") == 0 and "BroadcastHashJoin" not in plan.split("Initial Plan")[0]
