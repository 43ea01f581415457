"""The event source: byte ranges, growing segments, every payload kind, malformed lines, stream against batch."""

import json

import pytest
from pyspark.sql import functions as F

from signalspark.schemas import EVENT_DDL
from signalspark.sources import event_source, events_io

SRC = {"service": "s", "instance": "i", "environment": "e", "k8s_context": None}


def _event(n, payload, **other):
    return {"id": f"id{n}", "tenant_id": "t1", "source": SRC, "payload": payload, "timestamp": "2024-01-02T03:04:05.000006Z",
            "ingested_at": "2024-01-02T03:04:06Z", "labels": {"k": "v"}, **other}


LOG = {"type": "log", "level": "WARN", "message": "mé \n x", "trace_id": None, "span_id": "sp", "fields": {"a": 1}}
METRICS = [{"kind": "gauge", "value": 1.5}, {"kind": "counter", "value": 3.0}, {"kind": "histogram", "buckets": [[0.1, 2], [1.0, 5]], "sum": 2.5, "count": 5},
           {"kind": "summary", "quantiles": [[0.5, 1.0], [0.99, 4.0]], "sum": 9.0, "count": 7}]
TRACE = {"type": "trace", "trace_id": "t", "span_id": "s", "parent_span_id": None, "operation_name": "op", "start_time": "2024-01-02T03:04:05Z",
         "end_time": "2024-01-02T03:04:07Z", "status": "ok", "attributes": {"x": "y"}}
GOOD = [_event(0, LOG), *(_event(i + 1, {"type": "metric", "name": "m", "value": v, "unit": None}) for i, v in enumerate(METRICS)), _event(5, TRACE)]
BAD = {"not a JSON object": [b"{oops", b"[1]", b"7", b'"x"'], "not UTF-8": [b'{"id": "\xff"}'], "missing id": [_event(0, LOG, id=None)], "missing tenant_id": [_event(0, LOG, tenant_id="")],
       "incomplete source": [_event(0, LOG, source={"service": "s"})], "bad timestamp": [_event(0, LOG, timestamp="yesterday")],
       "unknown payload type": [_event(0, {"type": "profile"}), _event(0, None), _event(0, 5)],
       "bad log payload": [_event(0, {**LOG, "level": "LOUD"}), _event(0, {**LOG, "message": None})],
       "bad metric payload": [_event(0, {"type": "metric", "name": "m", "value": {"kind": "other"}, "unit": None}), _event(0, {"type": "metric", "value": METRICS[0]})],
       "bad metric value": [_event(0, {"type": "metric", "name": "m", "value": {"kind": "gauge", "value": "high"}}), _event(0, {"type": "metric", "name": "m", "value": {"kind": "summary", "sum": 1.0, "count": 1}})],
       "bad trace payload": [_event(0, {**TRACE, "start_time": "never"}), _event(0, {"type": "trace"})]}


def _line(x):
    return x if isinstance(x, bytes) else json.dumps(x).encode()


def _key(r):
    return json.dumps(r.asDict(recursive=True), default=str, sort_keys=True)


def test_all_kinds_and_rejects(spark, tmp_path):
    lines = [_line(x) for x in GOOD] + [_line(x) for xs in BAD.values() for x in xs] + [b"", b"  "]
    (tmp_path / "a").write_bytes(b"\n".join(lines[::2]) + b"\n")
    (tmp_path / "b").write_bytes(b"\n".join(lines[1::2]))  # the last line has no end
    (tmp_path / "_x").write_bytes(b"no segment")
    got = events_io.read_events(spark, str(tmp_path), fmt="signal_events", rejects=True, splitBytes="50")
    events = got["events"].collect()
    assert sorted(r.id for r in events) == sorted(e["id"] for e in GOOD)
    again = events_io.decode_events(events_io.encode_events(spark.createDataFrame(events, EVENT_DDL)))
    assert sorted(map(_key, again.collect())) == sorted(map(_key, events))
    metrics = {r.payload.metric.value.kind: r.payload.metric.value for r in events if r.payload.type == "metric"}
    assert metrics["histogram"].buckets[1]["count"] == 5 and metrics["summary"].quantiles[1].v == 4.0 and metrics["counter"].value == 3.0
    rejects = got["rejects"].collect()
    assert sorted((r.reason, bytes(r.value)) for r in rejects) == sorted((k, _line(x)) for k, xs in BAD.items() for x in xs)
    for r in rejects:  # a reject can be found again by segment and position
        data = (tmp_path / r.segment).read_bytes()
        assert data[r.position:].split(b"\n")[0] == bytes(r.value)


@pytest.mark.parametrize("split", [1, 7, 64, 10**6])
def test_ranges_read_every_line_once(spark, tmp_path, split, monkeypatch):
    monkeypatch.setattr(event_source, "BLOCK_BYTES", 16)
    lines = [("x" * (n * 7 % 61) + str(n)).encode() for n in range(200)]
    (tmp_path / "seg").write_bytes(b"\n".join(lines) + b"\n")
    folder = event_source._Folder({"path": str(tmp_path), "splitBytes": str(split)})
    read = [(v.as_py(), p.as_py()) for part in event_source._BatchReader(folder).partitions() for b in folder.read(part, True) for v, p in zip(b["value"], b["position"])]
    assert [v for v, _ in read] == lines and [p for _, p in read] == [sum(len(x) + 1 for x in lines[:i]) for i in range(200)]
    assert folder.last_line_end("seg", sum(len(x) + 1 for x in lines) - 1) == sum(len(x) + 1 for x in lines[:-1])


def test_empty_folder(spark, tmp_path):
    got = events_io.read_events(spark, str(tmp_path / "none"), fmt="signal_events", rejects=True)
    assert got["events"].count() == 0 and got["rejects"].count() == 0


def test_stream_equals_batch_while_segments_grow(spark, tmp_path):
    topic, out, mark = tmp_path / "topic", str(tmp_path / "out"), str(tmp_path / "mark")
    topic.mkdir()

    def run():
        s = events_io.read_events(spark, str(topic), fmt="signal_events", stream=True, splitBytes="300")
        q = s.select("id", F.to_json("payload").alias("p")).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        return sorted(r.id for r in spark.read.parquet(out).collect())
    data = [b"".join(_line(_event(f"{s}{n}", LOG)) + b"\n" for n in range(9)) for s in "ab"]
    (topic / "0").write_bytes(data[0][:1000])  # ends inside a line
    first = run()
    assert 0 < len(first) < 9
    (topic / "0").write_bytes(data[0])
    (topic / "1").write_bytes(data[1] + _line(_event("late", LOG)))  # not ended yet
    assert run() == sorted(f"id{s}{n}" for s in "ab" for n in range(9))
    with (topic / "1").open("ab") as f:
        f.write(b"\n")
    assert run() == run() == sorted(r.id for r in events_io.read_events(spark, str(topic), fmt="signal_events").collect())
