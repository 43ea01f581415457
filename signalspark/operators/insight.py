"""F1–F8: rule-based root cause and dashboard aggregates.

All of these are keyed aggregations with partial (map-side) aggregation.
F4 is exact without ordering a group: a mergeable sketch encloses the value first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import (EXPLAIN_ERROR, EXPLAIN_NO_CONTEXT, EXPLAIN_PREFIX, EXPLAIN_TIMEOUT,
                         EXPLAIN_UNUSUAL)
from ..plans.joins import broadcast_if_small


def _seconds(every: str | int) -> int:
    if isinstance(every, int):
        return every
    num, unit = every.split()
    return int(float(num) * {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600,
                             "hours": 3600, "day": 86400, "days": 86400}[unit])


def _bucket(ts_seconds: str, every) -> F.Column:
    s = _seconds(every)
    return (F.floor(F.col(ts_seconds) / s) * s).cast("bigint")


def recent_logs(logs: DataFrame, k: int, keys=("tenant_id", "service")) -> DataFrame:
    """Newest ``k`` log rows per key (WindowGroupLimit: partial top-k before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(F.col("timestamp").desc(), "level", "message", "trace_id")
    return logs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)


def explain(services: DataFrame, logs: DataFrame, k: int = 100, keys=("tenant_id", "service")) -> DataFrame:
    """one root-cause sentence per service from its ``k`` newest logs.

    Any 'timeout' (case-insensitive) → dependency timeout; else any 'error' →
    application exceptions; else unusual patterns; no logs → insufficient context.
    """
    r = recent_logs(logs, k, keys)
    low = F.lower(F.col("message"))
    g = r.groupBy(*keys).agg(F.bool_or(low.contains("timeout")).alias("_to"),
                             F.bool_or(low.contains("error")).alias("_er"),
                             F.count(F.lit(1)).alias("n_logs"))
    j = services.select(*keys).distinct().join(g, list(keys), "left")
    body = (F.when(F.coalesce(F.col("n_logs"), F.lit(0)) == 0, F.lit(EXPLAIN_NO_CONTEXT))
             .when(F.col("_to"), F.lit(EXPLAIN_TIMEOUT)).when(F.col("_er"), F.lit(EXPLAIN_ERROR))
             .otherwise(F.lit(EXPLAIN_UNUSUAL)))
    return j.select(*keys, F.coalesce(F.col("n_logs"), F.lit(0)).cast("bigint").alias("n_logs"),
                    F.concat(F.format_string(EXPLAIN_PREFIX, F.col(keys[-1])), body).alias("explanation"))


def explain_context(logs: DataFrame, metrics: DataFrame, k: int = 10, keys=("tenant_id", "service")) -> DataFrame:
    """per service its ``k`` newest log messages and metric samples (bounded lists)."""
    rl = recent_logs(logs, k, keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("_rn")).alias("o"), F.col("message").alias("m")))).alias("_l"))
    wm = Window.partitionBy(*keys).orderBy(F.col("timestamp").desc(), "name", F.col("value").desc())
    rm = (metrics.withColumn("_rn", F.row_number().over(wm)).filter(F.col("_rn") <= k)
                 .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
                     (-F.col("_rn")).alias("o"), F.col("name").alias("n"), F.col("value").alias("v")))).alias("_m")))
    j = rl.join(rm, list(keys), "full")
    return j.select(*keys, F.transform(F.coalesce("_l", F.array()), lambda x: x["m"]).alias("recent_logs"),
                    F.transform(F.coalesce("_m", F.array()), lambda x: F.struct(x["n"].alias("name"),
                                                                                x["v"].alias("value")))
                    .alias("metric_data"))


def error_rate(logs: DataFrame, every="1 day") -> DataFrame:
    """share of ERROR/FATAL rows per tenant and period."""
    b = _bucket("timestamp", every)
    g = logs.groupBy("tenant_id", b.alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("level").isin("ERROR", "FATAL")).alias("errors"))
    return g.withColumn("error_rate", F.col("errors").cast("double") / F.col("total"))


#: Accuracy of F4's sketch: it places a rank within n / SKETCH, so about 4 n / SKETCH rows are ordered.
SKETCH = 10_000


def p99(metrics: DataFrame, name: str, every="1 day", q: float = 0.99, sketch_accuracy: int | None = None) -> DataFrame:
    """99th percentile of a metric per tenant and period: the least value that at least
    ``q`` of the samples don't exceed. Exact unless a sketch is asked for.

    In two levels, so that no task orders a group's values: a mergeable sketch gives, per group,
    two values that enclose the one in question for certain; then one pass counts the samples below
    them and, value by value, those between, and only these are ordered."""
    m = metrics.filter((F.col("name") == name) & F.col("value").isNotNull()).withColumn("bucket_start", _bucket("timestamp", every))
    keys = ["tenant_id", "bucket_start"]
    if sketch_accuracy is not None:
        return m.groupBy(*keys).agg(F.percentile_approx("value", q, sketch_accuracy).alias("p99"),
                                    F.count(F.lit(1)).alias("samples"))
    m = m.select(*keys, "value")
    off = 2.0 / SKETCH  # twice the sketch's error to either side
    ends = F.percentile_approx("value", [max(0.0, q - off), min(1.0, q + off)], SKETCH)
    sk = (m.groupBy(*keys).agg(ends.alias("_e"), F.min("value").alias("_least"), F.max("value").alias("_most"), F.count(F.lit(1)).alias("samples"))
          .select(*keys, "samples", (F.col("_least") if q <= off else F.col("_e")[0]).alias("_lo"), (F.col("_most") if q >= 1 - off else F.col("_e")[1]).alias("_hi")))
    near = m.join(broadcast_if_small(sk), keys).where(F.col("value") <= F.col("_hi"))
    counts = near.groupBy(*keys, "samples", F.when(F.col("value") >= F.col("_lo"), F.col("value")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))
    enough = F.col("_v").isNotNull() & (F.col("_upto") >= F.ceil(F.lit(q) * F.col("samples")))
    return counts.withColumn("_upto", upto).where(enough).groupBy(*keys).agg(F.min("_v").alias("p99"), F.max("samples").alias("samples"))


def throughput(events: DataFrame, every="1 hour", keys=("tenant_id",)) -> DataFrame:
    """events per second per key and period."""
    s = _seconds(every)
    g = events.groupBy(*keys, _bucket("timestamp", every).alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("events"))
    return g.withColumn("events_per_sec", F.col("events").cast("double") / F.lit(float(s)))


def gauge_card(metrics: DataFrame, name: str, keys=("tenant_id",)) -> DataFrame:
    """latest and mean value of a gauge per key (mean from exact cent sums)."""
    m = metrics.filter(F.col("name") == name)
    cents = F.round(F.col("value") * 100).cast("bigint")
    g = m.groupBy(*keys).agg(F.max_by("value", F.struct("timestamp", "value")).alias("latest_value"),
                             F.max("timestamp").alias("latest_ts"), F.sum(cents).alias("_c"),
                             F.count(F.lit(1)).alias("samples"))
    return g.withColumn("mean_value", F.col("_c").cast("double") / F.col("samples") / F.lit(100.0)).drop("_c")


def pct_change(kpi: DataFrame, value: str, keys=("tenant_id",), order: str = "bucket_start") -> DataFrame:
    """change versus the previous period in percent (NULL for the first)."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag(value).over(w)
    return kpi.withColumn("prev_value", prev).withColumn(
        "pct_change", F.when(F.col("prev_value") != 0,
                             (F.col(value) - F.col("prev_value")).cast("double") * 100.0 / F.col("prev_value")))


def traffic(events: DataFrame, every="1 hour", ts: str = "ts") -> DataFrame:
    """F8: requests per (tenant, service) and time window (tumbling)."""
    return (events.groupBy("tenant_id", "service", F.window(ts, every).alias("w"))
                  .agg(F.count(F.lit(1)).alias("requests"))
                  .select("tenant_id", "service", F.unix_seconds(F.col("w.start")).cast("bigint").alias("bucket_start"),
                          "requests"))
