"""The tenant-scoped query surface over log/metric/incident tables.

Each query is a filter chain over raw columns (pushed into the parquet scan),
then ``orderBy(...).limit(n)``, which Spark plans as TakeOrderedAndProject:
a per-partition top-n followed by one merge of at most n rows per partition,
never a full sort or shuffle of the table.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import INCIDENT_LIMIT, LEVELS, LIVE_METRIC_ROWS, LOG_LIMIT, METRIC_LIMIT
from ..functions.text import contains_ci, level_rank

MAX_TS = 2**63 - 1


def clamp_limit(n: int | None, default: int, cap: int) -> int:
    """Missing → default, larger than cap → cap; negative is an error."""
    n = default if n is None else int(n)
    if n < 0:
        raise ValueError("limit must be non-negative")
    return min(n, cap)


def to_epoch_seconds(t) -> int | None:
    """Accept None, epoch seconds, or a datetime (naive = UTC)."""
    if t is None:
        return None
    if isinstance(t, _dt.datetime):
        if t.tzinfo is None:
            t = t.replace(tzinfo=_dt.timezone.utc)
        return int(t.timestamp() // 1)
    return int(t)


def for_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    """Every read is scoped to one tenant."""
    if not tenant_id:
        raise ValueError("tenant_id is required")
    return df.filter(F.col("tenant_id") == F.lit(tenant_id))


def _time_range(df: DataFrame, from_, to) -> DataFrame:
    lo, hi = to_epoch_seconds(from_), to_epoch_seconds(to)
    lo = 0 if lo is None else lo
    hi = MAX_TS if hi is None else hi
    out = df.filter((F.col("timestamp") >= lo) & (F.col("timestamp") <= hi))
    if "yyyymm" in df.columns:  # month partitions: prune whole directories
        out = out.filter(F.col("yyyymm").between(_month(lo), _month(hi)))
    return out


def _month(sec: int) -> int:
    sec = max(0, min(sec, 253402300799))
    d = _dt.datetime.fromtimestamp(sec, _dt.timezone.utc)
    return d.year * 100 + d.month


def search_logs(logs: DataFrame, tenant_id: str, q: str | None = None, from_=None, to=None,
                level: str | None = None, service: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest-first log search; empty strings mean "no filter"."""
    n = clamp_limit(limit, *LOG_LIMIT)
    df = _time_range(for_tenant(logs, tenant_id), from_, to)
    if level:
        df = df.filter(F.col("level") == level)
    if service:
        df = df.filter(F.col("service") == service)
    if q:
        df = df.filter(contains_ci("message", q))
    cols = ["tenant_id", "timestamp", "level", "message", "service", "trace_id"]
    return (df.select(*cols)
              .orderBy(F.col("timestamp").desc(), "level", "service", "message", "trace_id")
              .limit(n))


def query_metrics(metrics: DataFrame, tenant_id: str, name: str | None = None, from_=None, to=None,
                  limit: int | None = None) -> DataFrame:
    """Newest-first metric range query."""
    n = clamp_limit(limit, *METRIC_LIMIT)
    df = _time_range(for_tenant(metrics, tenant_id), from_, to)
    if name:
        df = df.filter(F.col("name") == name)
    cols = ["tenant_id", "timestamp", "name", "value", "service"]
    return df.select(*cols).orderBy(F.col("timestamp").desc(), "name", "service", "value").limit(n)


def latest_metrics(metrics: DataFrame, n: int = LIVE_METRIC_ROWS) -> DataFrame:
    """C4: the newest ``n`` metric rows of every tenant in one pass.

    ``row_number() <= n`` is planned as WindowGroupLimit: each partition keeps
    its local top-n per tenant before the shuffle, so a hot tenant ships at
    most n rows per partition.
    """
    w = Window.partitionBy("tenant_id").orderBy(F.col("timestamp").desc(), "name", "service", F.col("value").desc())
    return (metrics.select("tenant_id", "name", "value", "service", "timestamp")
                   .withColumn("rank", F.row_number().over(w))
                   .filter(F.col("rank") <= n))


def open_incidents(incidents: DataFrame, tenant_id: str, limit: int = INCIDENT_LIMIT) -> DataFrame:
    """Unresolved incidents of a tenant, newest first."""
    df = for_tenant(incidents, tenant_id).filter(F.col("status") != "resolved")
    return (df.select("id", "title", "description", "severity", "status", "context", "opened_at")
              .orderBy(F.col("opened_at").desc(), F.col("id")).limit(limit))


def format_logs(logs: DataFrame) -> DataFrame:
    """Display projection — UTC ``yyyy-MM-dd HH:mm:ss``, 4-letter level."""
    return logs.select(
        F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("time_text"),
        F.substring("level", 1, 4).alias("level_text"), "service", "message")


def min_level(df: DataFrame, level: str) -> DataFrame:
    """C11: rows at or above a severity (TRACE < … < FATAL)."""
    lv = level.upper()
    if lv not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    return df.filter(F.col("level").isin(*LEVELS[LEVELS.index(lv):]))
