"""Findings of round 3: catalog tables lie in buckets of the database, operators read each side once, large plans go in parts."""

from __future__ import annotations

from catwarden.operators import diff as D
from catwarden.operators import rules
from catwarden.operators.catalog import fixture_catalog
from catwarden.plans import audit
from catwarden.plans.diff import _sides
from catwarden.sources import fixtures as X

from .catalog_builder import DDL, build
from .test_findings_r03 import _folder


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_views_give_the_rows_of_their_sql(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    X.register_fixtures(spark, folder, lines=False)  # plain plans over the base tables
    want = {n: sorted(map(str, spark.sql(sql).collect())) for n, sql in X.FX_VIEWS if n in X.ORDER_VIEWS}
    for name, rows in want.items():
        assert rows and sorted(map(str, X.fixture(spark, folder, name).collect())) == rows, name


def test_catalog_joins_shuffle_nothing(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    source, target = _sides(spark, folder)
    cat = fixture_catalog(spark, folder)
    for df in (D.diff_indexes(source, target)[0], D.diff_fks(source, target)[0], rules.rule_redundant_prefix_index(cat),
               rules.rule_fk_missing_referenced_column(cat)):
        plan = _plan(df)
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan
    plan = _plan(D.diff_indexes(source, target)[0])
    assert "BroadcastExchange" not in plan and plan.count("FileScan") <= 12


def test_rules_read_what_was_kept(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    want = sorted(map(str, audit.fnd.analyze(fixture_catalog(spark, folder)).collect()))
    assert sorted(map(str, audit.all_findings(spark, folder).collect())) == want and want
    assert "kept" in fixture_catalog(spark, folder).extras["_shared"]
    kept = audit.kept_findings(spark, folder)
    assert kept is audit.kept_findings(spark, folder) and sorted(map(str, kept.collect())) == want
    assert "Join" not in _plan(kept)


def test_view_texts_do_not_pass_the_join_and_commands_are_made_in_parts(spark):
    src = build(spark, DDL().table("A", ("ID", "INTEGER")).table("B", ("ID", "INTEGER")))
    tgt = build(spark, DDL().table("a", ("id", "BIGINT")))
    views = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], "db_id long, name string, select_sql string")
    src.extras["views"], tgt.extras["views"] = views(("V", " select 1\r\n"), ("W", "select 2")), views(("v", "SELECT 1"), ("w", "select 3"), ("Z", "x"))
    items, _ = D.diff_views(src, tgt)
    assert sorted((r.bucket, r.name) for r in items.collect()) == [("target_only", "Z"), ("warning", "W")]
    join = items._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert "sha2" in join
    parts = []
    out = D.diff(src, tgt, keep=lambda frames: parts.append(len(frames)) or X.keep_rows(frames))
    one = D.diff(src, tgt)
    assert sorted(map(str, out.commands.collect())) == sorted(map(str, one.commands.collect())) and parts[0] > 5
    n = out.commands.count()
    assert [r.commands for r in D.diff_summary(out).collect()] == [n] == [r.commands for r in D.diff_summary(one).collect()]
