"""Table layout, retention, purge, uniqueness, insert-if-absent."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import PLAN_LIMITS, RETENTION_DAYS
from ..plans.joins import broadcast_if_small

SORT_KEYS = {"logs": ["tenant_id", "timestamp"], "metrics": ["tenant_id", "name", "timestamp"]}


def with_month(df: DataFrame, ts_seconds: str = "timestamp") -> DataFrame:
    """Add the ``yyyymm`` partition column from whole-second timestamps."""
    t = F.timestamp_seconds(F.col(ts_seconds))
    return df.withColumn("yyyymm", (F.year(t) * 100 + F.month(t)).cast("int"))


def layout(df: DataFrame, kind: str = "logs", num_partitions: int | None = None) -> DataFrame:
    """Month column + range partitioning on (month, sort key) + sorted files.

    Range partitioning (sampled bounds) balances a hot tenant over many tasks,
    and every output file covers one contiguous (tenant, time) range, so
    parquet row-group min/max statistics skip most files for a tenant query.
    """
    keys = SORT_KEYS[kind]
    x = with_month(df)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.repartitionByRange(n, "yyyymm", *keys).sortWithinPartitions("yyyymm", *keys)


def write_table(df: DataFrame, path: str, kind: str = "logs", mode: str = "append",
                num_partitions: int | None = None, max_records_per_file: int = 5_000_000) -> None:
    """Write a log/metric table partitioned by month, files sorted by key."""
    (layout(df, kind, num_partitions).write.mode(mode).partitionBy("yyyymm")
        .option("maxRecordsPerFile", max_records_per_file).parquet(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by ``write_table`` (``yyyymm`` becomes a partition column)."""
    return spark.read.parquet(path)


def _cutoff(as_of, days: int) -> int:
    if isinstance(as_of, _dt.datetime):
        if as_of.tzinfo is None:
            as_of = as_of.replace(tzinfo=_dt.timezone.utc)
        as_of = int(as_of.timestamp())
    return int(as_of) - days * 86400


def apply_retention(df: DataFrame, as_of, days: int = RETENTION_DAYS) -> DataFrame:
    """Keep rows younger than ``days`` at ``as_of`` (TTL ``timestamp + days``).

    On a month-partitioned table whole older months are pruned by the
    ``yyyymm`` predicate before any file is opened.
    """
    cut = _cutoff(as_of, days)
    out = df.filter(F.col("timestamp") >= cut)
    if "yyyymm" in df.columns:
        d = _dt.datetime.fromtimestamp(max(cut, 0), _dt.timezone.utc)
        out = out.filter(F.col("yyyymm") >= d.year * 100 + d.month)
    return out


def retention_days(tenants: DataFrame, default_days: int = RETENTION_DAYS) -> DataFrame:
    """(tenant_id, days): a tenant's own number, else its plan's (7/30/365), else the default."""
    by_plan = F.create_map(*[F.lit(x) for plan, limits in PLAN_LIMITS.items() for x in (plan, limits[1])])
    return tenants.select(F.col("id").alias("tenant_id"),
                          F.coalesce(F.col("retention_days"), F.try_element_at(by_plan, F.lower("plan")), F.lit(default_days)).alias("days"))


def apply_plan_retention(df: DataFrame, tenants: DataFrame, as_of, default_days: int = RETENTION_DAYS) -> DataFrame:
    """Per-tenant retention days (7/30/365 by plan, overridable per tenant).

    The longest retention of any tenant goes in as a fixed bound, so that older months of a stored
    table are pruned and older rows never reach the join."""
    t = retention_days(tenants, default_days).withColumnRenamed("days", "_days")
    base = _cutoff(as_of, 0)
    longest = max(t.agg(F.max("_days")).first()[0] or 0, default_days)
    j = apply_retention(df, base, longest).join(broadcast_if_small(t), "tenant_id", "left")
    days = F.coalesce(F.col("_days"), F.lit(default_days))
    return j.filter(F.col("timestamp") >= F.lit(base) - days * 86400).drop("_days")


def _month_seconds(yyyymm: int) -> tuple[int, int]:
    """First second of a month, and of the next one."""
    year, month = divmod(yyyymm, 100)
    ends = [_dt.datetime(y, m, 1, tzinfo=_dt.timezone.utc) for y, m in ((year, month), (year + month // 12, month % 12 + 1))]
    return int(ends[0].timestamp()), int(ends[1].timestamp())


def expire_table(spark: SparkSession, path: str, tenants: DataFrame, as_of, kind: str = "logs", default_days: int = RETENTION_DAYS) -> dict[str, list[int]]:
    """B7 on a table that ``write_table`` wrote: delete expired rows, touching as little as possible.

    Months that are older than every tenant's retention go as folders, by listing alone. Months that
    every tenant still keeps stay as they are. Only the months between are read, filtered and
    written anew: first aside, then over the month's folder, so a failure before that loses nothing
    and the call can be repeated. Returns the months ``dropped``, ``rewritten`` and ``kept``."""
    t = retention_days(tenants, default_days)
    least, most = t.agg(F.min("days"), F.max("days")).first()
    least, most = min(default_days, least if least is not None else default_days), max(default_days, most or 0)
    base = _cutoff(as_of, 0)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    months = sorted(int(f.getPath().getName()[7:]) for f in store.listStatus(folder) if f.getPath().getName().startswith("yyyymm="))
    out: dict[str, list[int]] = {"dropped": [], "rewritten": [], "kept": []}
    for month in months:
        first, after = _month_seconds(month)
        what = "dropped" if after <= base - most * 86400 else "kept" if first >= base - least * 86400 else "rewritten"
        out[what].append(month)
        if what == "dropped":
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/yyyymm={month}"), True)
    if out["rewritten"]:
        aside = f"{path}/_expiring"
        old = spark.read.parquet(path).where(F.col("yyyymm").isin(out["rewritten"]))
        left = layout(apply_plan_retention(old, tenants, base, default_days).drop("yyyymm"), kind)
        left.write.mode("overwrite").partitionBy("yyyymm").parquet(aside)
        for month in out["rewritten"]:
            new, place = (spark._jvm.org.apache.hadoop.fs.Path(f"{at}/yyyymm={month}") for at in (aside, path))
            store.delete(place, True)
            if store.exists(new):
                store.rename(new, place)
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)
    return out


def purge_tenants(tables: dict[str, DataFrame], tenant_ids: DataFrame) -> dict[str, DataFrame]:
    """Tenant delete with the schema's cascades.

    ``tenants``, ``users``, ``alert_rules``, ``incidents`` lose the tenant's
    rows; references to deleted rules and users become NULL (ON DELETE SET NULL).
    ``tenant_ids`` is a one-column DataFrame ``tenant_id``.
    """
    gone = tenant_ids.select("tenant_id").distinct()
    out = dict(tables)
    if "tenants" in tables:
        out["tenants"] = tables["tenants"].join(gone.withColumnRenamed("tenant_id", "id"), "id", "left_anti")
    dropped_users = dropped_rules = None
    if "users" in tables:
        u = tables["users"]
        dropped_users = u.join(gone, "tenant_id", "left_semi").select(F.col("id").alias("_uid"))
        out["users"] = u.join(gone, "tenant_id", "left_anti")
    if "alert_rules" in tables:
        r = tables["alert_rules"]
        dropped_rules = r.join(gone, "tenant_id", "left_semi").select(F.col("id").alias("_rid"))
        out["alert_rules"] = r.join(gone, "tenant_id", "left_anti")
    if "incidents" in tables:
        inc = tables["incidents"].join(gone, "tenant_id", "left_anti")
        if dropped_rules is not None:
            inc = inc.join(broadcast_if_small(dropped_rules), inc["alert_rule_id"] == F.col("_rid"), "left") \
                     .withColumn("alert_rule_id", F.when(F.col("_rid").isNull(), F.col("alert_rule_id"))).drop("_rid")
        if dropped_users is not None:
            for c in ("acknowledged_by", "resolved_by"):
                du = dropped_users.withColumnRenamed("_uid", "_u_" + c)
                inc = inc.join(broadcast_if_small(du), inc[c] == F.col("_u_" + c), "left") \
                         .withColumn(c, F.when(F.col("_u_" + c).isNull(), F.col(c))).drop("_u_" + c)
        out["incidents"] = inc
    return out


def audit_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once (partial counts before the shuffle)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """INSERT … ON CONFLICT DO NOTHING — rows whose key exists are dropped;
    among new rows with the same key the first by ``order`` (then by its other columns) is inserted.

    Rows come down to one a key in each task before the shuffle, so a flood of events of few keys
    never travels; what is left meets the keys of the target."""
    rest = [c for c in target.columns if c not in keys]
    first = F.min(F.struct(*(order or []), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(rest)])).alias("_f")
    new = rows.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_f._v{i}").alias(c) for i, c in enumerate(rest)])
    return target.unionByName(new.join(target.select(*keys), keys, "left_anti").select(*target.columns))
