"""Slices with state give what one call gives, streamed too; rejects of E1 and E9."""

import os

import pytest
from pyspark.sql import functions as F

from signalspark.operators import alerting as AL
from signalspark.sources import fixtures as fx
from signalspark.sources import metadata as MD
from signalspark.streaming.alerting import AlertTables, start_alerting
from conftest import SF001

OUTPUTS = ("incidents", "notifications", "notification_rejects")


@pytest.fixture(scope="module")
def anomalies(spark):
    return fx.anomalies(spark, SF001).cache()


@pytest.fixture(scope="module")
def slices(anomalies):
    cuts = anomalies.select(F.unix_micros("ts").alias("s")).approxQuantile("s", [0.3, 0.6], 0.0)
    s = F.unix_micros("ts")
    return [anomalies.where(s < cuts[0]), anomalies.where((s >= cuts[0]) & (s < cuts[1])), anomalies.where(s >= cuts[1])]


def _rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def whole(spark, anomalies):
    out = AL.run_alerting(anomalies, MD.rules(spark))
    return {n: _rows(out[n]) for n in (*OUTPUTS, "state")}


def test_slices_with_state_equal_one_call(spark, slices, whole):
    state, got = None, {n: [] for n in OUTPUTS}
    for part in slices:
        out = AL.run_alerting(part, MD.rules(spark), state)
        for n in OUTPUTS:
            got[n] += _rows(out[n])
        state = spark.createDataFrame(out["state"].collect(), AL.STATE_DDL)
    assert {n: sorted(r) for n, r in got.items()} == {n: whole[n] for n in OUTPUTS} and _rows(state) == whole["state"]
    assert len(whole["incidents"]) > 20 and len(whole["notifications"]) > 20 and whole["notification_rejects"]


def test_epochs_are_replay_safe(spark, slices, whole, tmp_path, monkeypatch):
    t = AlertTables(spark, str(tmp_path), lambda: MD.rules(spark))
    assert t.read("incidents") is None
    t.write_epoch(slices[0], 0)
    t.write_epoch(slices[0], 0)
    monkeypatch.setattr(type(t.records), "create", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # all written, not recorded
        t.write_epoch(slices[1], 1)
    monkeypatch.undo()
    assert _rows(t.read("incidents").drop("epoch")) == _rows(AL.run_alerting(slices[0], MD.rules(spark))["incidents"])
    for _ in range(2):
        t.write_epoch(slices[1], 1)
    t.write_epoch(slices[2], 2)
    assert {n: _rows(t.read(n).drop("epoch")) for n in OUTPUTS} == {n: whole[n] for n in OUTPUTS}


def test_stream_equals_batch(spark, slices, whole, tmp_path):
    for n, part in enumerate(slices):
        part.coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    files = [f for n in range(3) for f in sorted((tmp_path / f"in{n}").glob("*.parquet"))]
    (tmp_path / "in").mkdir()
    for n, f in enumerate(files):
        (tmp_path / "in" / f"{n:03d}.parquet").write_bytes(f.read_bytes())
        os.utime(tmp_path / "in" / f"{n:03d}.parquet", (10**9 + n, 10**9 + n))  # the source goes by time
    stream = spark.readStream.schema(slices[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_alerting(stream, MD.rules(spark), str(tmp_path / "out"), str(tmp_path / "mark"), available_now=True).awaitTermination(300)
    t = AlertTables(spark, str(tmp_path / "out"), None)
    assert t.records.numbers() == [0, 1, 2] and {n: _rows(t.read(n).drop("epoch")) for n in OUTPUTS} == {n: whole[n] for n in OUTPUTS}


def test_late_match_of_held_rule(spark):
    ddl = "anomaly_id long, rule_id string, ts timestamp, cooldown_secs int"
    import datetime as dt
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    first = AL.apply_cooldown(spark.createDataFrame([(1, "r", at(100), 60), (2, "n", at(5), -1)], ddl))
    state = AL.cooldown_state(first)
    later = spark.createDataFrame([(3, "r", at(50), 60), (4, "r", at(159), 60), (5, "r", at(160), 60), (6, "r", at(170), 60), (7, "n", at(10**6), 0), (8, "x", at(0), 0)], ddl)
    got = {r.anomaly_id: r.fired for r in AL.apply_cooldown(later, state=state).collect()}
    assert got == {3: False, 4: False, 5: True, 6: False, 7: False, 8: True}


def test_uuid_forms_and_rejects(spark):
    u = "00000000-0000-4000-8000-0000000000ab"
    rules = MD.rules(spark).where("is_enabled and rule_type = 'ai_anomaly'").limit(1).withColumn("tenant_id", F.lit(u))
    texts = [u, u.upper(), "{" + u + "}", "urn:uuid:" + u, u.replace("-", ""), u[:-1], u.replace("-", "", 1), "URN:UUID:" + u, "", None, "t1"]
    an = spark.createDataFrame([(i, t, "m", 1.0, "c") for i, t in enumerate(texts)], "anomaly_id long, tenant_id string, metric_name string, anomaly_score double, context string")
    out = AL.match_rules(an, rules, validate_uuid=True)
    assert {(r.anomaly_id, r.tenant_id) for r in out["matches"].collect()} == {(i, u) for i in range(5)}
    assert {r.anomaly_id: r.reason for r in out["rejects"].collect()} == {5: "invalid tenant_id", 6: "invalid tenant_id", 7: "invalid tenant_id", 8: "missing tenant_id", 9: "missing tenant_id", 10: "invalid tenant_id"}


def test_channels_that_cannot_be_sent(spark):
    channels = ['[{"type":"slack","url":"u"},{"type":"slack"},{"type":"pagerduty","url":"u"},{"type":"webhook","url":""},{"type":"fax","url":"u"},{"url":"u"}]', "oops", '{"type":"slack","url":"u"}', "[]", None]
    alerts = spark.createDataFrame([(i, "t", "r", "title", "d", c) for i, c in enumerate(channels)], "anomaly_id long, tenant_id string, rule_id string, title string, description string, channels string") \
        .withColumn("ts", F.timestamp_seconds(F.lit(0)))
    out = AL.notifications(alerts)
    assert [(r.anomaly_id, r.channel_no, r.target) for r in out["notifications"].collect()] == [(0, 0, "u")]
    assert sorted((r.anomaly_id, r.channel_no, r.reason) for r in out["rejects"].collect()) == [
        (0, 1, "missing address"), (0, 2, "missing address"), (0, 3, "missing address"), (0, 4, "unknown channel type"), (0, 5, "unknown channel type"),
        (1, -1, "channels are no list"), (2, -1, "channels are no list")]


def test_null_keys_are_one_key(spark):
    from signalspark.operators.admission import admit
    rows = [(i, None if i % 2 else "t", i * 1_000_000) for i in range(40)]
    req = spark.createDataFrame(rows, "event_id long, tenant_id string, us long").withColumn("ts", F.timestamp_micros("us")).drop("us")
    got = {r.event_id: r.admitted for r in admit(req, capacity=2, refill=1, period="4 seconds", num_partitions=5).collect()}
    want = {r.event_id: r.admitted for r in admit(req.fillna("x", ["tenant_id"]), capacity=2, refill=1, period="4 seconds", num_partitions=5).collect()}
    assert got == want and 0 < sum(got.values()) < 40


def test_bucket_state_outlives_its_refill():
    from signalspark.streaming.jobs import IDLE_TTL_MS, bucket_ttl_ms
    assert bucket_ttl_ms(1000, 1000, 1_000_000) == IDLE_TTL_MS
    assert bucket_ttl_ms(4, 4, 7_200_000_000) == 14_400_000 and bucket_ttl_ms(10, 0, 1) is None
