
from catwarden.plans.registry import load_all
from tests.conftest import SMALL_SF


def test_every_order_is_replayed(spark):
    last = {}
    for r in spark.read.parquet(f"{SMALL_SF}/orders.parquet").collect():
        last[r.o_custkey] = max(last.get(r.o_custkey, (-1, 0, "")), (r.o_orderkey, r.o_totalprice, r.o_orderstatus))
    assert {s for _, _, s in last.values()} > {"F"}
    want = {r.c_custkey: (r.c_name, r.c_acctbal) for r in spark.read.parquet(f"{SMALL_SF}/customer.parquet").collect()}
    want |= {c: (f"Customer#{k}", price) for c, (k, price, _) in last.items()}
    got = load_all()["apply_upsert_all"].spark(spark, SMALL_SF).collect()
    assert len(got) == len(want) and {r.c_custkey: (r.c_name, r.c_acctbal) for r in got} == want
