"""Operational thresholds, failure classes, and stream/batch twin equality."""

import datetime as dt
import os
import random
import tempfile
import time

from pyspark.sql import functions as F

from catwarden.operators import monitor as M
from catwarden.streaming import monitor_stream as ST


def test_gap_thresholds_at_boundaries(spark):
    rows = [(1, 1, 0, 200_000, 200_000), (1, 2, 0, 199_999, 249_999), (1, 3, 0, 10_000, 10_000),
            (1, 4, 0, 9_999, 59_999), (1, 5, 0, 0, 0)]
    df = spark.createDataFrame(rows, "db_id long, sample_id long, oit long, oat long, ost long")
    got = sorted((r.sample_id, r.code) for r in M.gap_findings(df, ["db_id", "sample_id"]).collect())
    assert got == [(1, "OPERACIONAL_GAP_OIT_OAT_ELEVADO"), (2, "OPERACIONAL_GAP_OAT_OST_ACIMA_DO_ESPERADO"),
                   (2, "OPERACIONAL_GAP_OIT_OAT_ACIMA_DO_ESPERADO"), (3, "OPERACIONAL_GAP_OIT_OAT_MODERADO"),
                   (4, "OPERACIONAL_GAP_OAT_OST_ACIMA_DO_ESPERADO")]


def test_active_transaction_age(spark):
    t0 = dt.datetime(2024, 1, 1, 12, 0)
    samples = spark.createDataFrame([
        (1, t0 - dt.timedelta(minutes=720), 1, 7), (1, t0 - dt.timedelta(minutes=900), 1, 99),  # 99 = own
        (2, t0 - dt.timedelta(minutes=119), 1, 5), (3, t0 - dt.timedelta(minutes=29), 1, 5),
        (4, t0 - dt.timedelta(minutes=500), 0, 5), (5, t0 - dt.timedelta(days=3), 1, 5)],
        "db_id long, ts timestamp_ntz, tx_state int, attachment_id long")
    own = spark.createDataFrame([(1, 99)], "db_id long, own_attachment_id long")
    as_of = spark.createDataFrame([(d, t0) for d in (1, 2, 3, 4, 5)], "db_id long, as_of timestamp_ntz")
    got = {r.db_id: r.code for r in M.age_findings(M.oldest_active(samples, own, as_of)).collect()}
    assert got == {1: "OPERACIONAL_TRANSACAO_ATIVA_LONGA_CRITICA", 2: "OPERACIONAL_TRANSACAO_ATIVA_ACIMA_DO_ESPERADO",
                   5: "OPERACIONAL_TRANSACAO_ATIVA_LONGA_CRITICA"}


def test_failure_classes(spark):
    msgs = ["Timeout while reading MON$ tables", "no permission for read-write access to database x",
            "Column unknown MON$STATE", "unsupported on-disk structure for file a.fdb; found 13.0, support 12.0",
            "something else"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "event_id int, message string")
    r = {x.event_id: (x.extraction_cause, x.monitor_failure, x.transient_execution)
         for x in M.classify_errors(df).collect()}
    assert r[0] == ("unknown", "timeout", True)
    assert r[1] == ("permission_denied", "permission_denied", False)
    assert r[2] == ("metadata_query_failure", "metadata_incompatible", False)
    assert r[3][0] == "incompatible_ods"
    assert r[4] == ("unknown", "query_failure", False)
    f, found, sup = M.ods_details(F.lit(msgs[3]))
    o = df.limit(1).select(f.alias("f"), found.alias("a"), sup.alias("b")).collect()[0]
    assert (o.f, o.a, o.b) == ("a.fdb", "13.0", "12.0")


def test_command_preview(spark):
    df = spark.createDataFrame([("INSERT  INTO\n T\tVALUES (1)",), ("x " * 200,)], "sql string")
    got = [r.p for r in df.select(M.command_preview(F.col("sql")).alias("p")).collect()]
    assert got[0] == "INSERT INTO T VALUES (1)"
    assert len(got[1]) == 183 and got[1].endswith("...")


def _samples(spark):
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(240):
        ts = base + dt.timedelta(minutes=37 * i)
        rows.append((i % 3, i, ts, 1000 * i, 1000 * i + (i % 7) * 30_000, 1000 * i + (i % 7) * 30_000 + (i % 5) * 60_000))
    return spark.createDataFrame(rows, "db_id long, sample_id long, ts timestamp_ntz, oit long, oat long, ost long")


def test_operational_stream_equals_batch_twin(spark):
    samples = _samples(spark)
    root = tempfile.mkdtemp(prefix="catwarden-stream-", dir="/tmp")
    src = os.path.join(root, "in")
    # files in time order: one file per six-hour slice, read one per trigger
    (samples.withColumn("slice", F.date_format("ts", "yyyyMMddHH").substr(1, 8))
            .repartition("slice").sortWithinPartitions("ts").drop("slice")
            .write.mode("overwrite").parquet(src))
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (ST.operational_windows(stream).writeStream.format("memory").queryName("op_windows")
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination(300)
    streamed = ST.operational_window_findings(spark.table("op_windows"))
    batch = ST.operational_window_findings(ST.operational_windows(samples))
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert batch.count() > 0


def test_throughput_stream_equals_batch_twin(spark):
    base = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(i, base + dt.timedelta(seconds=7 * i)) for i in range(500)], "event_id long, ts timestamp_ntz")
    root = tempfile.mkdtemp(prefix="catwarden-tput-", dir="/tmp")
    ev.repartition(5).write.mode("overwrite").parquet(os.path.join(root, "in"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(root, "in"))
    q = (ST.throughput(stream).writeStream.format("memory").queryName("tput").outputMode("complete")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    a, b = spark.table("tput"), ST.throughput(ev)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    rows = b.collect()
    assert sum(r.units for r in rows) == 500
    assert all(abs(r.rate - r.units / 30.0) < 1e-12 for r in rows)


def _transactions(spark):
    """Begins and ends of transactions of five attachments in two databases over some days, with ties,
    repeated begins, ends without a begin, an attachment that never ends and one of the monitor itself."""
    base, rows, rng = dt.datetime(2024, 1, 1, 0, 5), [], random.Random(7)
    for i in range(260):
        at = base + dt.timedelta(minutes=23 * i)
        rows.append((i % 2, rng.randrange(4), at, rng.randrange(2)))
        if i % 11 == 0:
            rows.append((i % 2, rows[-1][1], at, 1 - rows[-1][3]))
        if i % 29 == 0:
            rows.append((1, 99, at, 1))
    rows += [(0, 7, base, 1), (0, None, base, 1), (1, 5, base + dt.timedelta(days=1), None)]
    return spark.createDataFrame(rows, "db_id long, attachment_id long, ts timestamp_ntz, tx_state int")


def _open_by_hand(rows, width):
    """Every window of every attachment, event by event."""
    by, last, out = {}, {}, set()
    for r in rows:
        us = int((r.ts - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        last[r.db_id] = max(last.get(r.db_id, 0), us // width)
        if r.attachment_id is not None and (r.db_id, r.attachment_id) != (1, 99):
            by.setdefault((r.db_id, r.attachment_id), []).append((us, 1 if r.tx_state == 1 else 0))
    for key, events in by.items():
        for w in range(min(events)[0] // width, last[key[0]] + 1):
            opened = None
            for us, begins in sorted(events):
                if us < (w + 1) * width:
                    opened = (us if opened is None else opened) if begins else None
            if opened is not None:
                out.add((*key, w, opened))
    return out


def test_open_transactions_twin_by_hand(spark):
    samples = _transactions(spark)
    own = spark.createDataFrame([(1, 99)], "db_id long, own_attachment_id long")
    for minutes in (60, 1440):
        got = [tuple(r) for r in ST.open_transactions(samples, own, minutes).collect()]
        assert len(got) == len(set(got)) and set(got) == _open_by_hand(samples.collect(), minutes * 60_000_000)
    assert ST.open_transactions(samples.limit(0), own).count() == 0
    found = ST.age_window_findings(ST.open_transactions(samples, own)).collect()
    assert {r.severity for r in found} <= {"critical", "high", "medium"} and any(r.db_id == 0 and r.severity == "critical" for r in found)


def test_open_transactions_stream_equals_twin(spark):
    """Files in time order with disorder inside the watermark; two last files move the watermark beyond all windows."""
    samples = _transactions(spark)
    own = spark.createDataFrame([(1, 99)], "db_id long, own_attachment_id long")
    src = os.path.join(tempfile.mkdtemp(prefix="catwarden-open-", dir="/tmp"), "in")
    rows = sorted(samples.collect(), key=lambda r: r.ts)
    far = dt.datetime(2024, 3, 1)
    for n, part in enumerate([rows[:90], rows[90:91], rows[91:200], rows[200:]] + [[(50 + i, 1, far + dt.timedelta(days=i), 0)] for i in range(2)]):
        random.Random(n).shuffle(part)
        spark.createDataFrame(part, samples.schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = ST.open_transactions_stream(stream, own, minutes=60)
    q = out.writeStream.format("memory").queryName("open_tx").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    batch = {tuple(r) for r in ST.open_transactions(samples, own, 60).collect()}
    last = {d: max(t[2] for t in batch if t[0] == d) for d in (0, 1)}
    got = [tuple(r) for r in spark.table("open_tx").collect()]
    assert len(got) == len(set(got))
    assert {t for t in got if t[2] <= last[t[0]]} == batch
    # the one that never ends is told of in every window up to the watermark
    assert max(t[2] for t in got if t[:2] == (0, 7)) > last[0]
