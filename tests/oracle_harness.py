"""Spark-vs-DuckDB comparison used by the tests and by hand:

    python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catwarden.sources.tables import BASE_TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


SPARK_TO_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "StringType": "VARCHAR", "DoubleType": "DOUBLE",
                 "BooleanType": "BOOLEAN", "TimestampNTZType": "TIMESTAMP", "ShortType": "SMALLINT",
                 "DateType": "DATE", "BinaryType": "BLOB", "FloatType": "FLOAT"}


def type_diffs(schema, d_types):
    diffs = {}
    for f in schema.fields:
        s = SPARK_TO_DUCK.get(type(f.dataType).__name__, str(f.dataType))
        d = d_types.get(f.name, "?")
        if s != d and not (s.startswith("Decimal") and d.startswith("DECIMAL")):
            diffs[f.name] = (s, d)
    return diffs


def compare(spark, con, name, q, sf_dir):
    t0 = time.time()
    sdf = q.spark(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if q.sql is None:
        return {"name": name, "status": "no-oracle", "rows": len(s_rows), "spark_s": round(t1 - t0, 2)}
    res = con.execute(q.sql)
    d_cols = [c[0] for c in res.description]
    d_types = {c[0]: str(c[1]) for c in res.description}
    d_rows = res.fetchall()
    t2 = time.time()
    out = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows),
           "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    if sorted(s_cols) != sorted(d_cols):
        out.update(status="schema", spark_cols=s_cols, duck_cols=d_cols)
        return out
    out["type_diffs"] = type_diffs(sdf.schema, d_types)
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=_key)
    if a == b:
        out["status"] = "ok"
    else:
        sa, sb = set(a), set(b)
        out.update(status="values", only_spark=list(sa - sb)[:3], only_duck=list(sb - sa)[:3])
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from catwarden.plans.registry import load_all
    from catwarden.session import local_session
    spark = local_session(8)
    con = duck(sf_dir)
    reg = load_all()
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, q, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "status": "error", "error": str(e)[:600]}
        if r["status"] not in ("ok", "no-oracle"):
            bad += 1
        print(r, flush=True)
    print(f"{len(reg)} registered, {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
