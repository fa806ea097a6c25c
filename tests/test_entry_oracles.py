"""Driver contract and Spark-vs-DuckDB parity of every registered query at sf0.001."""

import pytest

import __spark_entry__ as entry_mod
from tests.conftest import SMALL_SF
from tests.oracle_harness import compare, duck

# the corpus operators have tests of their own
QUERIES = {n: q for n, q in entry_mod.queries().items() if n not in entry_mod.LLM_QUERIES}
ORACLES = {n: q for n, q in entry_mod.oracle_sql().items() if n in QUERIES}


def test_contract_keys():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert len(QUERIES) >= 90
    missing = sorted(set(QUERIES) - set(ORACLES))
    assert missing == []  # script_parts has an oracle since its parts are exact


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["db_id", "total", "critical", "high", "medium", "low"]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL_SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle_parity(spark, con, name):
    from catwarden.plans.registry import load_all
    r = compare(spark, con, name, load_all()[name], SMALL_SF)
    assert r["status"] in ("ok", "no-oracle"), r


def test_two_folders_in_turn(spark):
    from catwarden.plans.registry import load_all
    from tests.conftest import CHECK_SF
    run = load_all()["writable_columns"].spark
    small = run(spark, SMALL_SF).count()
    assert run(spark, CHECK_SF).count() > small
    assert run(spark, SMALL_SF).count() == small
