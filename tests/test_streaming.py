"""Streaming forms give the batch results when files arrive in time order."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from signalspark.operators.admission import admit
from signalspark.operators.alerting import apply_cooldown, match_rules
from signalspark.operators.insight import traffic
from signalspark.sources import fixtures as fx
from signalspark.sources import metadata as MD
from signalspark.streaming import jobs


def _time_ordered_files(df, ts_col, n_files=3):
    """Write ``df`` as ``n_files`` parquet files, each a later time slice."""
    d = tempfile.mkdtemp(prefix="signalspark-stream-in-")
    b = df.withColumn("_slice", F.ntile(n_files).over(
        __import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy(ts_col)))
    for i in range(1, n_files + 1):
        b.filter(F.col("_slice") == i).drop("_slice").coalesce(1).write.parquet(os.path.join(d, f"part{i:03d}"))
    return d


def _run_stream(spark, sdf, name):
    q = (sdf.writeStream.format("memory").queryName(name).outputMode("append")
            .option("checkpointLocation", tempfile.mkdtemp(prefix="signalspark-ckpt-"))
            .trigger(availableNow=True).start())
    end = time.time() + 300
    # state with a processing-time expiry keeps a query going without data: a batch of no rows is the end
    while q.isActive and time.time() < end and (q.lastProgress or {"numInputRows": 1})["numInputRows"] > 0:
        time.sleep(0.2)
    q.stop()
    return spark.sql(f"SELECT * FROM {name}")


def _stream_of(spark, d, schema):
    subdirs = sorted(os.path.join(d, x) for x in os.listdir(d) if x.startswith("part"))
    # one source per slice would reorder; read the parent with one file per trigger
    files = []
    for s in subdirs:
        files += [os.path.join(s, f) for f in sorted(os.listdir(s)) if f.endswith(".parquet")]
    flat = tempfile.mkdtemp(prefix="signalspark-stream-flat-")
    for i, f in enumerate(files):
        os.link(f, os.path.join(flat, f"{i:05d}.parquet"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(flat)


def test_admission_stream_equals_batch(spark):
    req = fx.admission_requests(spark, SF001)
    batch = {r.event_id: r.admitted for r in admit(req, capacity=4, refill=4, period="2 hours").collect()}
    d = _time_ordered_files(req, "ts")
    s = jobs.admit_stream(_stream_of(spark, d, req.schema), capacity=4, refill=4, period="2 hours")
    got = {r.event_id: r.admitted for r in _run_stream(spark, s, "adm_stream").collect()}
    assert got == batch


def test_cooldown_stream_equals_batch(spark):
    m = match_rules(fx.anomalies(spark, SF001), MD.rules(spark))["matches"].select(
        "anomaly_id", "tenant_id", "rule_id", "ts", "cooldown_secs")
    batch = {(r.anomaly_id, r.rule_id): r.fired for r in apply_cooldown(m).collect()}
    d = _time_ordered_files(m, "ts")
    s = jobs.cooldown_stream(_stream_of(spark, d, m.schema))
    got = {(r.anomaly_id, r.rule_id): r.fired for r in _run_stream(spark, s, "cd_stream").collect()}
    assert got == batch and any(batch.values())


def test_traffic_stream_equals_batch(spark):
    ev = fx.event_base(fx.read_table(spark, SF001, "events")).select("event_id", "tenant_id", "service", "ts")
    batch = sorted(tuple(r) for r in traffic(ev, "1 hour").collect())
    d = _time_ordered_files(ev, "ts")
    s = jobs.traffic_stream(_stream_of(spark, d, ev.schema), "1 hour", watermark="2 hours")
    got = sorted(tuple(r) for r in _run_stream(spark, s, "traffic_stream").collect())
    # append mode holds back the windows the final watermark has not closed
    assert set(got) <= set(batch) and len(got) >= len(batch) - 5 * 4 * 3


def test_table_writer_batches(spark):
    from signalspark.plans import flows
    ev = flows.event_log_events(spark, SF001).select("id", "tenant_id", "source", "payload", "timestamp",
                                                    "ingested_at", "labels")
    d = _time_ordered_files(ev, "timestamp")
    out = tempfile.mkdtemp(prefix="signalspark-tables-")
    q = jobs.start_table_writer(_stream_of(spark, d, ev.schema), os.path.join(out, "logs"),
                                os.path.join(out, "metrics"), tempfile.mkdtemp(prefix="signalspark-ckpt-"),
                                available_now=True)
    q.awaitTermination(300)
    logs = spark.read.parquet(os.path.join(out, "logs"))
    assert logs.count() == ev.count()
    assert "yyyymm" in logs.columns


def test_latest_metrics_replay_and_failure(spark, tmp_path):
    table = str(tmp_path / "latest")
    ddl = "tenant_id string, name string, value double, service string, timestamp bigint"
    batch = lambda *rows: spark.createDataFrame(list(rows), ddl)
    read = lambda: sorted((r.tenant_id, r.timestamp, r["rank"]) for r in jobs.read_latest_metrics(spark, table).collect())
    jobs.merge_latest_metrics(batch(("a", "m", 1.0, "s", 1), ("a", "m", 1.0, "s", 2), ("b", "m", 1.0, "s", 1)), 0, table, 2)
    assert read() == [("a", 1, 2), ("a", 2, 1), ("b", 1, 1)]
    for _ in range(2):  # the epoch is replayed: its rows count once
        jobs.merge_latest_metrics(batch(("a", "m", 1.0, "s", 3)), 1, table, 2)
        assert read() == [("a", 2, 2), ("a", 3, 1), ("b", 1, 1)]
    jobs.merge_latest_metrics(batch(), 2, table, 2)
    assert read() == [("a", 2, 2), ("a", 3, 1), ("b", 1, 1)]
    broken = tmp_path / "latest" / "slot=0" / "part-broken.snappy.parquet"
    broken.write_bytes(b"no parquet")
    with pytest.raises(Exception):  # noqa: B017, PT011
        jobs.merge_latest_metrics(batch(("a", "m", 1.0, "s", 9)), 3, table, 2)
