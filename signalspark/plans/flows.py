"""Composed flows: driver tables → fixtures → operators → at-rest tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.envelope import explode_log_envelopes, explode_metric_envelopes
from ..operators.events import log_events, metric_events
from ..operators.parse_logs import parse_logs
from ..operators.rows import log_rows, metric_rows
from ..session import configure
from ..sources import fixtures as fx


def event_log_events(spark: SparkSession, base: str) -> DataFrame:
    """Events table → one parsed log event per event row (timestamp = event ts)."""
    configure(spark)
    lines = fx.log_lines(spark, base)
    return log_events(parse_logs(lines), id_cols=("event_id",), ts_col="ts",
                      ingested_at=F.col("ts"))


def event_log_rows(spark: SparkSession, base: str) -> DataFrame:
    """The ``logs`` table built from the events fixture (B1 over A2–A9)."""
    return log_rows(event_log_events(spark, base))


def document_log_lines(spark: SparkSession, base: str) -> DataFrame:
    """Documents as ingest envelopes, exploded and parsed line by line."""
    configure(spark)
    return parse_logs(explode_log_envelopes(fx.document_envelopes(spark, base)))


def exposition_metric_events(spark: SparkSession, base: str) -> DataFrame:
    """Prometheus envelopes → gauge metric events."""
    configure(spark)
    samples = explode_metric_envelopes(fx.exposition_envelopes(spark, base))
    return metric_events(samples, id_cols=("request_id", "sample_no"), ts_col="received_at",
                         ingested_at=F.col("received_at"))


def event_metric_rows(spark: SparkSession, base: str) -> DataFrame:
    """The ``metrics`` table: one gauge row per event (name = event_type, value),
    built through the Prometheus path with the sample's own timestamp kept in
    labels-free rows."""
    configure(spark)
    b = fx.event_base(fx.read_table(spark, base, "events"))
    samples = b.select(
        F.col("event_id").cast("string").alias("request_id"), F.lit(0).alias("sample_no"),
        "tenant_id", "service", F.lit("").alias("instance"), "environment", "ts",
        F.col("event_type").alias("name"), "value",
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"))
    return metric_rows(metric_events(samples, ts_col="ts", ingested_at=F.col("ts")))
