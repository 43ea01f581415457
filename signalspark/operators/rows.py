"""Flatten events into the at-rest log and metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import epoch_seconds


def sorted_map_json(m) -> Column:
    """JSON object text of a string map with keys in byte order ('{}' when empty)."""
    m = F.col(m) if isinstance(m, str) else m
    return F.coalesce(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.map_keys(m)),
                                                               lambda k: F.struct(k, m[k])))), F.lit("{}"))


def log_rows(events: DataFrame) -> DataFrame:
    """Log events → log rows (traces and metrics never reach the table).

    Whole-second timestamp, canonical level, ``trace_id`` NULL → '', labels as
    key-sorted JSON text; id, span_id, fields and ingest time are dropped.
    """
    e = events.filter(F.col("payload.type") == "log")
    return e.select(
        "tenant_id", epoch_seconds("timestamp").alias("timestamp"),
        F.col("payload.log.level").alias("level"), F.col("payload.log.message").alias("message"),
        F.col("source.service").alias("service"), F.col("source.instance").alias("instance"),
        F.col("source.environment").alias("environment"),
        F.coalesce(F.col("payload.log.trace_id"), F.lit("")).alias("trace_id"),
        sorted_map_json("labels").alias("labels"))


def metric_value(v: Column) -> Column:
    """Gauge/counter → value; histogram/summary → sum."""
    return F.when(v["kind"].isin("gauge", "counter"), v["value"]).otherwise(v["sum"])


def metric_rows(events: DataFrame) -> DataFrame:
    """Metric events → metric rows (unit, instance, buckets, quantiles dropped)."""
    e = events.filter(F.col("payload.type") == "metric")
    return e.select(
        "tenant_id", epoch_seconds("timestamp").alias("timestamp"),
        F.col("payload.metric.name").alias("name"),
        metric_value(F.col("payload.metric.value")).alias("value"),
        F.col("source.service").alias("service"), F.col("source.environment").alias("environment"),
        sorted_map_json("labels").alias("labels"))


def trace_rows(events: DataFrame) -> DataFrame:
    """Trace events → span rows: the whole span with its length, attributes as they came."""
    e = events.filter(F.col("payload.type") == "trace")
    t = F.col("payload.trace")
    start, end = F.unix_micros(t["start_time"]), F.unix_micros(t["end_time"])
    return e.select("tenant_id", t["trace_id"].alias("trace_id"), t["span_id"].alias("span_id"),
                    F.coalesce(t["parent_span_id"], F.lit("")).alias("parent_span_id"), t["operation_name"].alias("operation_name"),
                    start.alias("start_us"), (end - start).alias("duration_us"), t["status"].alias("status"),
                    F.col("source.service").alias("service"), F.col("source.environment").alias("environment"),
                    sorted_map_json("labels").alias("labels"))
