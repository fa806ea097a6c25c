"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced end to end with the ``noop`` sink (full computation,
no driver collect). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "all_findings", "fleet_by_database", "risk_by_table", "diff_items", "diff_commands", "fk_depth",
    "render_insert", "commit_batches", "apply_upsert", "script_statements", "load_inserts",
    "roundtrip_verify", "rule_operational_gaps", "stream_throughput", "q_join",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    from catwarden.plans.registry import load_all
    from catwarden.session import local_session
    from catwarden.sources.fixtures import register_fixtures

    spark = local_session(cpus, app="catwarden-bench")
    for kv in [x for x in os.environ.get("BENCH_CONF", "").split(",") if x]:
        k, v = kv.split("=", 1)
        spark.conf.set(k, v)
    reg = load_all()
    times: dict[str, float] = {}
    t0 = time.time()
    register_fixtures(spark, sf_dir)  # writes the fleet catalog tables once
    times["setup_fleet_tables"] = round(time.time() - t0, 3)
    for name in names:
        t = time.time()
        reg[name].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
