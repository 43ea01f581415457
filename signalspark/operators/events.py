"""Assemble typed telemetry events and route them by signal type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LOG_PAYLOAD_DDL, METRIC_PAYLOAD_DDL, TRACE_PAYLOAD_DDL


def stable_uuid(*cols) -> Column:
    """UUID-formatted id from SHA-256 of the key columns.

    Unlike ``uuid()`` it is the same on a task retry, so replays and
    speculative tasks produce the same event ids (exactly-once by id).
    """
    h = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(""))
                                       for c in cols]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def _source() -> Column:
    return F.struct(F.col("service").alias("service"), F.col("instance").alias("instance"),
                    F.col("environment").alias("environment"),
                    F.lit(None).cast("string").alias("k8s_context"))


def log_events(parsed: DataFrame, id_cols=("request_id", "line_no"), ts_col: str | None = "received_at",
               ingested_at: Column | None = None) -> DataFrame:
    """Parsed log lines → events (payload type ``log``, empty labels).

    ``timestamp`` is the request's receive time (the reference stamps it at
    ingest); pass ``ts_col=None`` to use the current time.
    """
    ts = F.col(ts_col) if ts_col else F.current_timestamp()
    payload = F.struct(
        F.lit("log").alias("type"),
        F.struct("level", "message", "trace_id", "span_id", "fields").alias("log"),
        F.lit(None).cast(METRIC_PAYLOAD_DDL).alias("metric"),
        F.lit(None).cast(TRACE_PAYLOAD_DDL).alias("trace"))
    return parsed.select(
        stable_uuid(F.lit("log"), "tenant_id", *id_cols).alias("id"),
        "tenant_id", _source().alias("source"), payload.alias("payload"),
        ts.alias("timestamp"),
        (ingested_at if ingested_at is not None else F.current_timestamp()).alias("ingested_at"),
        F.create_map().cast("map<string,string>").alias("labels"))


def metric_events(samples: DataFrame, id_cols=("request_id", "sample_no"), ts_col: str | None = "received_at",
                  ingested_at: Column | None = None) -> DataFrame:
    """Prometheus samples → gauge metric events carrying the sample labels."""
    ts = F.col(ts_col) if ts_col else F.current_timestamp()
    value = F.struct(F.lit("gauge").alias("kind"), F.col("value").alias("value"),
                     F.lit(None).cast("array<struct<le:double,count:bigint>>").alias("buckets"),
                     F.lit(None).cast("array<struct<q:double,v:double>>").alias("quantiles"),
                     F.lit(None).cast("double").alias("sum"), F.lit(None).cast("bigint").alias("count"))
    payload = F.struct(
        F.lit("metric").alias("type"),
        F.lit(None).cast(LOG_PAYLOAD_DDL).alias("log"),
        F.struct(F.col("name").alias("name"), value.alias("value"), F.lit(None).cast("string").alias("unit")).alias("metric"),
        F.lit(None).cast(TRACE_PAYLOAD_DDL).alias("trace"))
    return samples.select(
        stable_uuid(F.lit("metric"), "tenant_id", *id_cols).alias("id"),
        "tenant_id", _source().alias("source"), payload.alias("payload"),
        ts.alias("timestamp"),
        (ingested_at if ingested_at is not None else F.current_timestamp()).alias("ingested_at"),
        F.col("labels"))


#: Topics by the type of payload that they take; anomalies come from the detectors.
TOPICS = {"log": "logs", "metric": "metrics", "trace": "traces", "anomaly": "anomalies"}


def route_signals(events: DataFrame, anomalies: DataFrame | None = None) -> dict[str, DataFrame]:
    """One filtered DataFrame per signal topic (logs, metrics, traces, and anomalies if given).

    Each is a filter on ``payload.type`` over the same plan, so writing them
    from one ``foreachBatch`` reads the input once when it is cached there.
    ``write_signals`` writes all of them in one pass instead.
    """
    t = F.col("payload.type")
    out = {topic: events.filter(t == kind) for kind, topic in TOPICS.items() if kind != "anomaly"}
    return out if anomalies is None else {**out, "anomalies": anomalies}


def signal_rows(events: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """(topic, key, value) of every signal: its topic, its tenant as key, its wire JSON."""
    from ..sources.events_io import encode_events
    kind = F.col("payload.type")
    topic = F.create_map(*[F.lit(x) for kv in TOPICS.items() for x in kv])[kind]
    out = encode_events(events.where(kind.isin(*TOPICS)).withColumn("topic", topic), keep=("topic",))
    if anomalies is None:
        return out
    body = F.to_json(F.struct("anomaly_id", "tenant_id", "metric_name", "anomaly_score", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "context"))
    return out.unionByName(anomalies.select(F.lit(TOPICS["anomaly"]).alias("topic"), F.col("tenant_id").alias("key"), body.alias("value")))


def write_signals(events: DataFrame, path: str, anomalies: DataFrame | None = None, mode: str = "append") -> None:
    """One write of all topics, a folder each; the input is read once and nothing is shuffled."""
    signal_rows(events, anomalies).write.mode(mode).partitionBy("topic").parquet(path)


def read_signals(spark, path: str, topic: str) -> DataFrame:
    """One topic of ``write_signals`` as (key, value); only its folder is opened."""
    return spark.read.schema("key STRING, value STRING, topic STRING").parquet(path).where(F.col("topic") == topic).select("key", "value")
