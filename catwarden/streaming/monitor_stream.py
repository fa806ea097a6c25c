"""Structured Streaming variants of the monitor operators.

Both functions take a DataFrame that may be streaming (``readStream``) or
static (the batch twin): the same logical plan serves both, which is how
the batch/stream equality test checks them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.monitor import age_findings, gap_findings


def _event_time(df: DataFrame, col: str = "ts"):
    """Watermarks need TIMESTAMP; a TIMESTAMP_NTZ column is read as UTC
    wall time (the session time zone is UTC) and window bounds are cast
    back so stream and batch twin keep the input's type."""
    ntz = isinstance(df.schema[col].dataType, T.TimestampNTZType)
    ev = df.withColumn("_event_ts", F.col(col).cast("timestamp") if ntz else F.col(col))
    back = (lambda c: c.cast("timestamp_ntz")) if ntz else (lambda c: c)
    return ev, back


CHECKPOINT_SECONDS = 30  # Fixed value: checkpoint interval of the throughput report


def operational_windows(samples: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Per database and tumbling window, the latest sample (``max_by``
    on ts, bounded state per (db, window)), then the O01-O05 thresholds."""
    ev, back = _event_time(samples)
    w = (ev.withWatermark("_event_ts", watermark)
           .groupBy("db_id", F.window("_event_ts", window).alias("w"))
           .agg(F.max_by(F.struct("sample_id", "ts", "oit", "oat", "ost"), "_event_ts").alias("s"),
                F.count(F.lit(1)).alias("samples")))
    latest = w.select("db_id", back(F.col("w.start")).alias("window_start"), back(F.col("w.end")).alias("window_end"),
                      "samples", "s.sample_id", "s.ts", "s.oit", "s.oat", "s.ost")
    return latest


def operational_window_findings(latest: DataFrame) -> DataFrame:
    return gap_findings(latest, ["db_id", "window_start", "sample_id"])


# ---- T01, the age half: transactions open at the end of a window ------------------

OPEN_SCHEMA = "db_id bigint, attachment_id bigint, w bigint, opened bigint"


def _transaction_events(samples: DataFrame, own: DataFrame | None) -> DataFrame:
    """(db_id, attachment_id, _event_ts, us, st): the begins (1) and ends (0) of
    transactions, without those of the monitoring attachment and rows without a
    time or attachment. ``own``: db_id, own_attachment_id, one row a database."""
    ev, _ = _event_time(samples)
    if own is not None:
        ev = ev.join(own, "db_id", "left").where(F.col("own_attachment_id").isNull() | (F.col("attachment_id") != F.col("own_attachment_id")))
    return (ev.where("_event_ts is not null and db_id is not null and attachment_id is not null")
              .select(F.col("db_id").cast("bigint"), F.col("attachment_id").cast("bigint"), "_event_ts",
                      F.unix_micros("_event_ts").alias("us"), F.when(F.col("tx_state") == 1, 1).otherwise(0).alias("st")))


def open_transactions_stream(samples: DataFrame, own: DataFrame | None = None, minutes: int = 1440,
                             watermark: str = "1 hour") -> DataFrame:
    """One row (db_id, attachment_id, w, opened) for each window that ends
    while a transaction of the attachment is open; ``w`` and ``opened`` are its number
    and the begin in microseconds since the epoch.

    The state of an attachment is the begin of its open transaction, the next
    window to judge and the events that the watermark has not passed yet, so
    it does not grow with the stream and a busy database spreads over its
    attachments. Events may arrive in any order within the watermark. A begin while
    one is open changes nothing, nor does an end while none is; of two events at
    the same instant the end comes first. An event of a window that was judged
    already is dropped, as the watermark does with late rows.
    """
    width = minutes * 60_000_000

    def run(key, batches, state):
        opened, upto, us, st = state.get if state.exists else (None, None, [], [])
        waiting = list(zip(us, st))
        if not state.hasTimedOut:
            for pdf in batches:
                waiting += zip(pdf["us"].tolist(), pdf["st"].tolist())
        waiting = sorted(e for e in waiting if upto is None or e[0] >= upto * width)
        if upto is None and waiting:
            upto = waiting[0][0] // width
        passed, found, at = state.getCurrentWatermarkMs() * 1000, [], 0
        while upto is not None and (upto + 1) * width <= passed and (opened is not None or at < len(waiting)):
            end = (upto + 1) * width
            while at < len(waiting) and waiting[at][0] < end:
                when, begins = waiting[at]
                opened = (when if opened is None else opened) if begins else None
                at += 1
            if opened is not None:
                found.append((upto, opened))
            # windows without an event while nothing is open have nothing to tell
            upto = upto + 1 if opened is not None or at == len(waiting) else max(upto + 1, waiting[at][0] // width)
        waiting = waiting[at:]
        if opened is None and not waiting:
            upto = max(upto or 0, passed // width)  # what comes later than the watermark stays dropped
        state.update((opened, upto, [e[0] for e in waiting], [e[1] for e in waiting]))
        if opened is not None or waiting:
            state.setTimeoutTimestamp(max((upto + 1) * width // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"db_id": [key[0]] * len(found), "attachment_id": [key[1]] * len(found),
                            "w": [f[0] for f in found], "opened": [f[1] for f in found]}, dtype="int64")

    ev = _transaction_events(samples, own).withWatermark("_event_ts", watermark)
    return ev.groupBy("db_id", "attachment_id").applyInPandasWithState(
        run, OPEN_SCHEMA, "opened long, upto long, us array<long>, st array<long>", "append", "EventTimeTimeout")


def open_transactions(samples: DataFrame, own: DataFrame | None = None, minutes: int = 1440) -> DataFrame:
    """The batch twin of ``open_transactions_stream``, over the windows up to the
    last one in which its database has a sample.

    Events are reduced to one row for each attachment and window by partial
    aggregates (the last end, then the first begin behind it), so the windows
    over an attachment see a row a window, however many events it has.
    """
    width = minutes * 60_000_000
    key = ["db_id", "attachment_id"]
    ev = _transaction_events(samples, own).select(*key, F.floor(F.col("us") / width).cast("bigint").alias("w"), "us", "st")
    begun, ended = F.col("st") == 1, F.col("st") == 0
    seen = ev.groupBy(*key, "w").agg(F.max(F.when(ended, F.col("us"))).alias("last_end"), F.max(F.when(begun, F.col("us"))).alias("last_begin"))
    # only windows with a begin behind an end need their events again
    mixed = seen.where("last_begin >= last_end").select(*key, "w", "last_end")
    behind = (ev.where(begun).join(mixed, [*key, "w"]).where("us >= last_end").groupBy(*key, "w").agg(F.min("us").alias("behind")))
    first = ev.where(begun).groupBy(*key, "w").agg(F.min("us").alias("first_begin"))
    rows = (seen.join(first, [*key, "w"], "left").join(behind, [*key, "w"], "left")
            .select(*key, "w", F.col("last_end").isNotNull().alias("closes"),
                    F.when(F.col("last_end").isNull(), F.col("first_begin")).otherwise(F.col("behind")).alias("begin")))
    by_window = Window.partitionBy(*key).orderBy("w")
    rows = rows.withColumn("run", F.sum(F.col("closes").cast("int")).over(by_window))
    rows = rows.withColumn("opened", F.min("begin").over(Window.partitionBy(*key, "run").orderBy("w")))
    rows = rows.withColumn("next", F.lead("w").over(by_window))
    ev_all, _ = _event_time(samples)
    horizon = (ev_all.where("_event_ts is not null").groupBy(F.col("db_id").cast("bigint").alias("db_id"))
               .agg(F.floor(F.max(F.unix_micros("_event_ts")) / width).cast("bigint").alias("last_w")))
    live = rows.where("opened is not null").join(horizon, "db_id")
    until = F.coalesce(F.col("next") - 1, F.col("last_w"))
    return live.select(*key, F.explode(F.sequence("w", until)).alias("w"), "opened")


def age_window_findings(open_rows: DataFrame, minutes: int = 1440) -> DataFrame:
    """O06-O08 at the end of each window, from the rows of ``open_transactions``
    or of the sink of ``open_transactions_stream``: the oldest open transaction of each database."""
    start = F.timestamp_micros(F.col("w") * (minutes * 60_000_000))
    oldest = open_rows.groupBy("db_id", "w").agg(F.min("opened").alias("opened"), F.count(F.lit(1)).alias("open_transactions"))
    oldest = oldest.select("db_id", start.cast("timestamp_ntz").alias("window_start"), "open_transactions",
                           F.timestamp_micros("opened").alias("oldest_active"),
                           F.timestamp_micros((F.col("w") + 1) * (minutes * 60_000_000)).alias("as_of"))
    return age_findings(oldest, ("db_id", "window_start", "open_transactions"))


def throughput(events: DataFrame, seconds: int = CHECKPOINT_SECONDS, watermark: str = "1 minute") -> DataFrame:
    """Units per fixed window and the rate (units / window seconds)."""
    ev, back = _event_time(events)
    w = (ev.withWatermark("_event_ts", watermark)
           .groupBy(F.window("_event_ts", f"{seconds} seconds").alias("w"))
           .agg(F.count(F.lit(1)).alias("units")))
    return w.select(back(F.col("w.start")).alias("window_start"), "units",
                    (F.col("units") / F.lit(float(seconds))).alias("rate"))


def progress_stream(units: DataFrame, key: str, order: list[str], time_col: str, every: int, seconds: int) -> DataFrame:
    """W08 as a stream: (key, time, n) of the units at which a run takes a
    checkpoint, ``every`` units or ``seconds`` after its last one. The state of a
    run is three numbers: units since the checkpoint, its time, units in all. Units
    of one run arrive in order (a run writes its own progress)."""
    span = seconds * 1_000_000

    def run(k, batches, state):
        since, last, total = state.get if state.exists else (0, None, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for us in rows["_us"].tolist():
            last = us if last is None else last
            since, total = since + 1, total + 1
            if since >= every or us >= last + span:
                out.append(total)
                since, last = 0, us
        state.update((since, last, total))
        yield pd.DataFrame({key: [k[0]] * len(out), "row_no": out})

    ev, _ = _event_time(units, time_col)
    ev = ev.withColumn("_us", F.unix_micros("_event_ts")).drop("_event_ts")
    kind = ev.schema[key].dataType.simpleString()
    return ev.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, row_no long", "since long, last long, total long", "append", "NoTimeout")


def start_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger_available_now: bool = True):
    """Write a streaming result to parquet with a checkpoint folder (both on
    shared storage on a cluster). Returns the StreamingQuery."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
          .outputMode(mode)
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()
