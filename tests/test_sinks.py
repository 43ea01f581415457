"""B8 vector table, B7 on stored tables, A13 in one pass, rows of every payload kind."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from signalspark.operators import events as EV
from signalspark.operators import storage as ST
from signalspark.operators.rows import metric_rows, trace_rows
from signalspark.operators.vectors import upsert_vectors, vector_points
from signalspark.plans import flows
from signalspark.sources import events_io
from signalspark.sources import fixtures as fx
from signalspark.sources import metadata as MD
from signalspark.streaming.vectors import VectorTable, start_vector_writer
from conftest import SF001

COLUMNS = ["id", "tenant_id", "message", "timestamp", "vector"]


@pytest.fixture(scope="module")
def events(spark):
    return fx.signal_events(spark, SF001).cache()


def _rows(df):
    return sorted(str(tuple(r)) for r in df.select(*COLUMNS).collect())


def _changed(events):
    """Later versions of some events: same ids, other messages, older times."""
    return (events.where(F.pmod(F.xxhash64("id"), F.lit(3)) == 0).withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 1 DAY"))
            .withColumn("payload", F.col("payload").withField("log.message", F.lit("changed"))).where("payload.type = 'log'"))


def test_incoming_point_wins(spark):
    ddl = "id string, timestamp long, message string"
    old = spark.createDataFrame([("a", 100, "old"), ("b", 100, "old")], ddl)
    new = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("a", 7, "z"), ("c", 1, "n")], ddl)
    assert sorted(map(tuple, upsert_vectors(old, new).collect())) == [("a", 7, "z"), ("b", 100, "old"), ("c", 1, "n")]


def test_vector_table_replays_and_touched_buckets(spark, events, tmp_path, monkeypatch):
    t = VectorTable(spark, str(tmp_path), buckets=8)
    logs = events.where("payload.type = 'log'")
    t.write_epoch(events, 0)
    t.write_epoch(events, 0)
    assert _rows(t.read()) == _rows(vector_points(logs)) and t.read().count() == logs.count()
    few = logs.orderBy("id").limit(2)
    t.write_epoch(few, 1)
    _, live = t._live()
    assert {e for e in live.values()} == {0, 1} and sum(e == 1 for e in live.values()) <= 2
    want = _rows(upsert_vectors(vector_points(logs), vector_points(_changed(events))))
    monkeypatch.setattr(type(t.records), "create", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        t.write_epoch(_changed(events), 2)
    monkeypatch.undo()
    assert _rows(t.read()) == _rows(vector_points(logs))
    for _ in range(2):
        t.write_epoch(_changed(events), 2)
    t.write_epoch(events.limit(0), 3)
    assert _rows(t.read()) == want and len(t.records.numbers()) <= 2
    some = [r.id for r in few.collect()]
    assert sorted(r.id for r in t.find(some).collect()) == sorted(some)
    with pytest.raises(ValueError):
        VectorTable(spark, str(tmp_path), buckets=4).read()


def test_vector_stream_equals_batch(spark, events, tmp_path):
    parts = [events.where("payload.type <> 'trace'"), _changed(events)]
    (tmp_path / "in").mkdir()
    for n, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        (tmp_path / "in" / f"{n}.parquet").write_bytes(next((tmp_path / f"p{n}").glob("*.parquet")).read_bytes())
        os.utime(tmp_path / "in" / f"{n}.parquet", (10**9 + n, 10**9 + n))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_vector_writer(stream, str(tmp_path / "out"), str(tmp_path / "mark"), available_now=True, buckets=4).awaitTermination(300)
    assert _rows(VectorTable(spark, str(tmp_path / "out"), buckets=4).read()) == _rows(upsert_vectors(vector_points(parts[0]), vector_points(parts[1])))


def test_one_pass_routing(spark, events, tmp_path):
    anomalies = fx.anomalies(spark, SF001)
    EV.write_signals(events, str(tmp_path), anomalies)
    assert sorted(p.name for p in tmp_path.iterdir() if p.name[0] != "_" and p.name[0] != ".") == [f"topic={t}" for t in ("anomalies", "logs", "metrics", "traces")]
    for topic, df in EV.route_signals(events, anomalies).items():
        back = EV.read_signals(spark, str(tmp_path), topic)
        assert back.count() == df.count() > 0
        if topic != "anomalies":
            assert sorted(r.id for r in events_io.decode_events(back).collect()) == sorted(r.id for r in df.collect())
    assert "Exchange" not in EV.signal_rows(events.where("true"))._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]


def test_rows_of_every_kind(spark, events):
    values = {(r.name, r.value) for r in metric_rows(events).collect()}
    again = metric_rows(events_io.decode_events(events_io.encode_events(events)))
    assert {(r.name, r.value) for r in again.collect()} == values and metric_rows(events).count() == events.where("payload.type = 'metric'").count()
    spans = trace_rows(events).collect()
    assert spans and all(r.duration_us == 1_000_000 and r.trace_id for r in spans) and {r.status for r in spans} == {"ok", "error"}


def _files(path):
    return {m: sorted((f, os.path.getmtime(os.path.join(path, m, f))) for f in os.listdir(os.path.join(path, m))) for m in os.listdir(path) if m.startswith("yyyymm=")}


def test_expiry_touches_boundary_months_only(spark, tmp_path):
    path, day = str(tmp_path / "logs"), 86400
    base = int(dt.datetime(2025, 6, 20, tzinfo=dt.timezone.utc).timestamp())
    rows = [(t, base - d * day, "INFO", f"{t}{d}") for t in ("t0", "t1", "t2", "tx") for d in (1, 6, 8, 29, 31, 44, 46, 100, 364, 366, 500)]
    df = spark.createDataFrame(rows, "tenant_id string, timestamp long, level string, message string")
    ST.write_table(df, path, "logs", num_partitions=2)
    tenants = MD.tenants(spark).withColumn("retention_days", F.when(F.col("id") == "t2", 45)).withColumn("plan", F.when(F.col("id") == "t0", "Enterprise").otherwise(F.col("plan")))
    days = {r.tenant_id: r.days for r in ST.retention_days(tenants).collect()}
    assert (days["t0"], days["t1"], days["t2"], days["t4"]) == (365, 7, 45, 30)
    before = _files(path)
    done = ST.expire_table(spark, path, tenants, base)
    keep = {"t0": 365, "t1": 7, "t2": 45, "tx": 30}
    want = sorted(r[3] for r in rows if r[1] >= base - keep[r[0]] * day)
    assert sorted(r.message for r in ST.read_table(spark, path).collect()) == want
    assert sorted(r.message for r in ST.apply_plan_retention(df, tenants, base).collect()) == want
    assert done["dropped"] == [202402] and set(done["kept"]) == set() and 202506 in done["rewritten"]
    again = _files(path)
    assert sorted(r.message for r in ST.read_table(spark, path).collect()) == want
    # with one retention for all, the months after the boundary keep their files
    flat = tenants.withColumn("retention_days", F.lit(60))
    before = _files(path)
    told = ST.expire_table(spark, path, flat, base, default_days=60)
    assert 202506 in told["kept"] and 202505 in told["kept"] and again
    after = _files(path)
    assert all(after[f"yyyymm={m}"] == before[f"yyyymm={m}"] for m in told["kept"])
