"""Streaming jobs: stateful admission and cooldown, live latest-metrics table, windowed traffic
(the micro-batch table writer is in ``tables``).

Event time is ``ts``/``timestamp``; state per key lives in the checkpointed
state store, so a restarted query resumes exactly where it stopped. Input
rows of one key inside one micro-batch are processed in (time, id) order;
the per-batch group size is bounded by the trigger (maxFilesPerTrigger /
maxOffsetsPerTrigger), never by the stream's total size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..constants import DEFAULT_ADMISSION_LIMIT, LIVE_METRIC_ROWS
from ..operators.admission import _period_us
from ..operators.alerting import NEVER_US
from .tables import start_table_writer  # noqa: F401

IDLE_TTL_MS = 3600 * 1000


def bucket_ttl_ms(capacity: int, refill: int, period_us: int) -> int | None:
    """Milliseconds after which an idle bucket's state may go: None if it never fills up."""
    return None if refill <= 0 else max(IDLE_TTL_MS, 2 * -(-capacity * period_us // (refill * 1000)))


def admit_stream(requests: DataFrame, key: str = "tenant_id", ts: str = "ts", id_col: str = "event_id",
                 capacity: int = DEFAULT_ADMISSION_LIMIT, refill: int | None = None, period="1 second") -> DataFrame:
    """A10 (stream): token bucket per key with the bucket kept in the state store.

    Idle state expires after the time in which an empty bucket fills up, twice over, and an hour
    at least: a bucket that idle is full, as a new one is, so expiry changes no decision of a
    stream that keeps up with its event time. A bucket that never refills never expires.
    """
    refill = capacity if refill is None else refill
    p_us = _period_us(period)
    ttl = bucket_ttl_ms(capacity, refill, p_us)
    cap, rate, cost = capacity * p_us, refill, p_us
    x = requests.select(F.col(key).alias("_k"), F.unix_micros(F.col(ts)).alias("_t"),
                        F.col(id_col).alias("_id"), *[F.col(c) for c in requests.columns])

    def step(k, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["_t", "_id"], kind="stable")
        s, last = (state.get if state.exists else (None, None))
        t = pdf["_t"].to_numpy(dtype=np.int64)
        adm = np.zeros(len(t), dtype=bool)
        tok = np.zeros(len(t), dtype=np.int64)
        for i in range(len(t)):
            y = cap if s is None else min(cap, s + max(0, int(t[i]) - last) * rate)
            if y >= cost:
                s, adm[i] = y - cost, True
            else:
                s = y
            last = int(t[i]) if last is None else max(last, int(t[i]))
            tok[i] = s
        state.update((int(s), int(last)))
        if ttl is not None:
            state.setTimeoutDuration(ttl)
        out = pdf.drop(columns=["_k", "_t", "_id"]).copy()
        out["admitted"], out["tokens_units"] = adm, tok
        yield out

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields]
                       + ["admitted boolean", "tokens_units bigint"])
    return x.groupBy("_k").applyInPandasWithState(step, schema, "s long, last long", "append",
                                                  GroupStateTimeout.ProcessingTimeTimeout)


def cooldown_stream(matches: DataFrame, key: str = "rule_id", ts: str = "ts", id_col: str = "anomaly_id",
                    cooldown_col: str = "cooldown_secs") -> DataFrame:
    """E3 (stream): per-rule cooldown with (last fire, stored cooldown) as state."""
    x = matches.select(F.col(key).alias("_k"), F.unix_micros(F.col(ts)).alias("_t"),
                       F.col(id_col).alias("_id"), *[F.col(c) for c in matches.columns])

    def step(k, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["_t", "_id"], kind="stable")
        last, c = (state.get if state.exists else (None, None))
        fired = np.zeros(len(pdf), dtype=bool)
        for i, (t, cd) in enumerate(zip(pdf["_t"].to_numpy(dtype=np.int64), pdf[cooldown_col].to_numpy())):
            if last is None or int(t) - last >= c:
                fired[i] = True
                last, c = int(t), (NEVER_US if int(cd) < 0 else int(cd) * 1_000_000)
        if last is not None:
            state.update((int(last), int(c)))
            state.setTimeoutDuration(max(IDLE_TTL_MS, int(min(c, 10**15) // 1000)))
        out = pdf.drop(columns=["_k", "_t", "_id"]).copy()
        out["fired"] = fired
        yield out

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in matches.schema.fields] + ["fired boolean"])
    return x.groupBy("_k").applyInPandasWithState(step, schema, "last long, cd long", "append",
                                                  GroupStateTimeout.ProcessingTimeTimeout)


LATEST_DDL = "tenant_id string, name string, value double, service string, timestamp bigint, rank int, epoch bigint, slot int"


def read_latest_metrics(spark: SparkSession, table_path: str) -> DataFrame:
    """C4 (stream): the rows of the newest complete epoch of the live table."""
    table = spark.read.schema(LATEST_DDL).parquet(table_path)
    newest = table.agg(F.max("epoch").alias("epoch"))
    return table.join(F.broadcast(newest), "epoch", "left_semi").drop("epoch", "slot")


def merge_latest_metrics(batch: DataFrame, epoch_id: int, table_path: str, n: int = LIVE_METRIC_ROWS) -> None:
    """Write epoch ``epoch_id`` of the live table: the newest ``n`` rows per tenant of the
    batch and the epoch before.

    Even and odd epochs have a partition each, replaced as a whole, so the epoch before
    stays readable until the next one is written, a replayed epoch starts from the same
    rows again, and nothing piles up. A read that fails fails the batch."""
    spark = batch.sparkSession
    cols = ["tenant_id", "name", "value", "service", "timestamp"]
    spark.createDataFrame([], LATEST_DDL).write.mode("ignore").partitionBy("slot").parquet(table_path)
    before = spark.read.schema(LATEST_DDL).parquet(table_path).where((F.col("epoch") < epoch_id) & (F.col("slot") != epoch_id % 2))
    w = Window.partitionBy("tenant_id").orderBy(F.col("timestamp").desc(), "name", "service", F.col("value").desc())
    top = (batch.select(*cols).unionByName(before.select(*cols))
           .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n))
    (top.withColumn("epoch", F.lit(epoch_id).cast("bigint")).withColumn("slot", F.lit(epoch_id % 2))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(table_path))


def start_latest_metrics(metric_rows_stream: DataFrame, table_path: str, checkpoint: str, n: int = LIVE_METRIC_ROWS,
                         trigger_seconds: int = 1, available_now: bool = False):
    """C4 (stream): keep the newest ``n`` metric rows per tenant in a small table,
    merging each micro-batch's top-n with the epoch before (1 s trigger)."""
    w = (metric_rows_stream.writeStream
         .foreachBatch(lambda batch, epoch_id: merge_latest_metrics(batch, epoch_id, table_path, n))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()


def traffic_stream(events: DataFrame, every: str = "1 hour", watermark: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """F8 (stream): requests per (tenant, service, window) with a watermark;
    append mode emits each window once it is final, late rows are dropped by
    the watermark (and counted by Spark's ``numRowsDroppedByWatermark``)."""
    return (events.withWatermark(ts, watermark)
                  .groupBy("tenant_id", "service", F.window(ts, every).alias("w"))
                  .agg(F.count(F.lit(1)).alias("requests"))
                  .select("tenant_id", "service", F.unix_seconds(F.col("w.start")).cast("bigint").alias("bucket_start"),
                          "requests"))
