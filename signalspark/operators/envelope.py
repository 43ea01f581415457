"""Explode ingest envelopes into one row per line / per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_ENVIRONMENT, DEFAULT_INSTANCE
from .parse_prom import parse_exposition


def _defaults(df: DataFrame) -> list:
    return [
        F.coalesce(F.col("instance"), F.lit(DEFAULT_INSTANCE)).alias("instance"),
        F.coalesce(F.col("environment"), F.lit(DEFAULT_ENVIRONMENT)).alias("environment"),
    ]


def explode_log_envelopes(df: DataFrame, keep: tuple[str, ...] = ("request_id", "received_at")) -> DataFrame:
    """One row per line: ``tenant_id, service, instance, environment, line_no, raw``.

    Line order is kept in ``line_no`` (0-based); missing ``instance`` becomes
    '' and missing ``environment`` 'production'.
    """
    keep_cols = [c for c in keep if c in df.columns]
    return df.select(*keep_cols, "tenant_id", "service", *_defaults(df),
                     F.posexplode("lines").alias("line_no", "raw")).withColumn("line_no", F.col("line_no").cast("bigint"))


def explode_metric_envelopes(df: DataFrame, keep: tuple[str, ...] = ("request_id", "received_at")) -> DataFrame:
    """One row per valid Prometheus sample of each envelope's ``exposition``."""
    keep_cols = [c for c in keep if c in df.columns]
    base = df.select(*keep_cols, "tenant_id", "service", *_defaults(df), "exposition")
    return parse_exposition(base, "exposition").drop("exposition")


def ingest_summary(decisions: DataFrame, lines_col: str = "n_lines") -> DataFrame:
    """accepted/rejected request and line counts per tenant.

    ``decisions`` has one row per request with ``admitted`` and a line count.
    """
    return decisions.groupBy("tenant_id").agg(
        F.count_if(F.col("admitted")).cast("bigint").alias("accepted_requests"),
        F.count_if(~F.col("admitted")).cast("bigint").alias("rejected_requests"),
        F.sum(F.when(F.col("admitted"), F.col(lines_col)).otherwise(0)).cast("bigint").alias("accepted_lines"),
    )
