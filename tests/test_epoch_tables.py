"""Rows count once whatever is repeated or breaks; flushes by rows and by time."""

import pytest
from pyspark.sql import functions as F

from signalspark.operators.rows import log_rows, metric_rows
from signalspark.schemas import LOG_ROW_DDL, METRIC_ROW_DDL
from signalspark.sources import fixtures as fx
from signalspark.streaming import tables as TB
from conftest import SF001


@pytest.fixture(scope="module")
def events(spark):
    return fx.signal_events(spark, SF001).cache()


def _part(events, n, of=3):
    return events.where(F.pmod(F.xxhash64("id"), F.lit(of)) == n)


def _rows(df):
    return sorted(map(str, df.drop("yyyymm").collect()))


def _paths(folder):
    return {name: f"{folder}/{name}" for name in ("logs", "metrics")}


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def test_replay_and_half_epochs(spark, events, tmp_path, monkeypatch):
    clock = Clock()
    t = TB.EpochTables(spark, _paths(tmp_path), flush_rows=10**9, flush_seconds=100, clock=clock)
    read = lambda name, ddl, **k: _rows(t.read(name, ddl, **k))
    t.write_epoch(_part(events, 0), 0)
    assert read("logs", LOG_ROW_DDL) == [] and read("logs", LOG_ROW_DDL, staged=True) == _rows(log_rows(_part(events, 0)))
    t.write_epoch(_part(events, 0), 0)  # replayed before the flush
    broken = dict(TB.TABLES, metrics=(lambda e: 1 / 0, "metrics"))
    with pytest.raises(ZeroDivisionError):  # half of epoch 1: logs are written, metrics are not
        TB.EpochTables(spark, _paths(tmp_path), broken, clock=clock).write_epoch(_part(events, 1), 1)
    assert read("logs", LOG_ROW_DDL, staged=True) == _rows(log_rows(_part(events, 0)))
    t.write_epoch(_part(events, 1), 1)
    clock.now = 200.0  # the first epoch has waited long enough
    real = TB.Records.create
    monkeypatch.setattr(TB.Records, "create", lambda self, n, told: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # written, but not recorded
        t.flush()
    monkeypatch.setattr(TB.Records, "create", real)
    assert read("logs", LOG_ROW_DDL) == []
    t.flush()
    for n in (0, 1):  # replayed after the flush
        t.write_epoch(_part(events, n), n)
    t.write_epoch(_part(events, 2), 2)
    both = _part(events, 0).union(_part(events, 1))
    for name, ddl, rows in (("logs", LOG_ROW_DDL, log_rows), ("metrics", METRIC_ROW_DDL, metric_rows)):
        assert read(name, ddl) == _rows(rows(both)) and read(name, ddl, staged=True) == _rows(rows(events))
    t.flush(force=True)
    assert read("logs", LOG_ROW_DDL) == _rows(log_rows(events)) and t._staged.numbers() == []


def test_flush_by_rows_per_table(spark, events, tmp_path):
    logs = log_rows(_part(events, 0)).count()
    assert logs < metric_rows(_part(events, 0)).count()
    t = TB.EpochTables(spark, _paths(tmp_path), flush_rows=logs + 1, flush_seconds=10**6)
    t.write_epoch(_part(events, 0), 0)  # metrics are full, logs are not
    assert t.read("logs", LOG_ROW_DDL).count() == 0 and _rows(t.read("metrics", METRIC_ROW_DDL)) == _rows(metric_rows(_part(events, 0)))
    t.write_epoch(_part(events, 1), 1)
    assert t.read("logs", LOG_ROW_DDL).count() == log_rows(_part(events, 0)).count() + log_rows(_part(events, 1)).count()
    t.write_epoch(events.limit(0), 2)
    plan = t.read("logs", LOG_ROW_DDL).where("yyyymm = 202401")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(yyyymm" in plan


def test_stream_through_source_and_tables(spark, events, tmp_path):
    """Encoded events of all kinds through the source into the tables, in one query that is restarted."""
    from signalspark.sources import events_io
    topic, mark, paths = str(tmp_path / "topic"), str(tmp_path / "mark"), _paths(tmp_path)
    for n in range(2):
        events_io.encode_events(_part(events, n, 2)).select("value").coalesce(2).write.mode("append").text(topic)
        stream = events_io.read_events(spark, topic, fmt="signal_events", stream=True)
        q = TB.start_table_writer(stream, paths["logs"], paths["metrics"], mark, available_now=True)
        q.awaitTermination(180)
    t = TB.EpochTables(spark, paths)
    assert _rows(t.read("logs", LOG_ROW_DDL)) == _rows(log_rows(events)) and _rows(t.read("metrics", METRIC_ROW_DDL)) == _rows(metric_rows(events))
