"""Operator inputs derived from the driver tables (events, documents, embeddings).

Every derivation is a row-wise projection or a keyed aggregation, so its work
grows with the input tables; the same mapping is written in DuckDB SQL in
``signalspark.plans.oracle`` for the correctness check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PAYLOAD_DDL
from .tables import read_table

REQUEST_BLOCK = 64  # event ids per synthetic ingest request
SERVICES = ["checkout", "auth", "api", "search"]
EVENT_LEVEL = {"error": "ERROR", "signup": "WARN", "purchase": "INFO",
               "click": "DEBUG", "view": "TRACE"}


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def event_base(events: DataFrame) -> DataFrame:
    """Tenant/service/level/message columns shared by all event fixtures."""
    lvl = None
    for et, lv in EVENT_LEVEL.items():
        cond = F.col("event_type") == et
        lvl = F.when(cond, lv) if lvl is None else lvl.when(cond, lv)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id", "event_type", "value",
        F.concat(F.lit("t"), _s(F.col("user_id") % 5)).alias("tenant_id"),
        F.element_at(F.array(*[F.lit(s) for s in SERVICES]),
                     (F.col("user_id") % 4 + 1).cast("int")).alias("service"),
        F.when(F.col("event_id") % 10 == 0, "staging").otherwise("production").alias("environment"),
        lvl.alias("src_level"),
        F.concat(F.col("event_type"), F.lit(" k"), _s(k)).alias("src_message"),
    )


def raw_log_line(b: DataFrame) -> DataFrame:
    """Add ``raw``: JSON, logfmt, bracket-prefixed or bare text by ``event_id % 4``."""
    eid, uid = _s("event_id"), _s("user_id")
    low = F.lower("src_level")
    json_line = F.concat(F.lit('{"level":"'), low, F.lit('","message":"'), F.col("src_message"),
                         F.lit('","trace_id":"tr'), eid, F.lit('","user":'), uid, F.lit("}"))
    logfmt_line = F.concat(F.lit("level="), low, F.lit(' msg="'), F.col("src_message"),
                           F.lit('" user='), uid, F.lit(" span_id=sp"), eid)
    prefix_line = F.concat(F.lit("["), F.col("src_level"), F.lit("] "), F.col("src_message"))
    m = F.col("event_id") % 4
    raw = (F.when(m == 0, json_line).when(m == 1, logfmt_line)
           .when(m == 2, prefix_line).otherwise(F.col("src_message")))
    return b.withColumn("raw", raw)


def log_lines(spark: SparkSession, base: str) -> DataFrame:
    """One raw log line per event: event_id, ts, tenant_id, service, environment, raw."""
    b = event_base(read_table(spark, base, "events"))
    return raw_log_line(b).select("event_id", "ts", "tenant_id", "service",
                                  F.concat(F.col("service"), F.lit("-"), _s(F.col("user_id") % 3)).alias("instance"),
                                  "environment", "raw")


def log_envelopes(spark: SparkSession, base: str) -> DataFrame:
    """Ingest requests: events grouped per (tenant, service, environment, block)
    where a block is 64 consecutive event ids, so a request holds at most 64
    lines however large a tenant grows.

    ``instance`` is left NULL and ``environment`` NULL for production, so the
    envelope defaults apply. Lines keep (ts, event_id) order.
    """
    ll = log_lines(spark, base)
    blk = F.floor(F.col("event_id") / REQUEST_BLOCK).cast("bigint")
    env = (ll.groupBy("tenant_id", "service", "environment", blk.alias("blk"))
             .agg(F.min("ts").alias("received_at"),
                  F.sort_array(F.collect_list(F.struct("ts", "event_id", "raw"))).alias("items")))
    return env.select(
        F.concat_ws("/", "tenant_id", "service", "environment", _s("blk")).alias("request_id"),
        "tenant_id", "service",
        F.lit(None).cast("string").alias("instance"),
        F.when(F.col("environment") != "production", F.col("environment")).alias("environment"),
        "received_at",
        F.transform("items", lambda x: x["raw"]).alias("lines"),
    )


def document_envelopes(spark: SparkSession, base: str) -> DataFrame:
    """Each document is one ingest request whose lines are its text lines."""
    d = read_table(spark, base, "documents")
    return d.select(
        F.concat(F.lit("doc-"), _s("doc_id")).alias("request_id"),
        F.concat(F.lit("t"), _s(F.col("doc_id") % 5)).alias("tenant_id"),
        F.col("source").alias("service"),
        F.col("lang").alias("instance"),
        F.lit(None).cast("string").alias("environment"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("received_at"),
        F.split("text", "\n").alias("lines"),
    )


def exposition_envelopes(spark: SparkSession, base: str) -> DataFrame:
    """Prometheus scrape bodies: per (tenant, service, 64-id block) one text body.

    Each event is one sample line ``<event_type>{user="<u>",env="<e>"} <v> <ms>``
    preceded by a ``# TYPE`` comment; every 7th event also yields a malformed
    line (``1d`` value) that the parser must drop.
    """
    b = event_base(read_table(spark, base, "events"))
    cents = F.round(F.col("value") * 100).cast("bigint")
    sample = F.concat(F.col("event_type"), F.lit('{user="'), _s("user_id"), F.lit('",env="'),
                      F.col("environment"), F.lit('"} '), _s(cents), F.lit("e-2 "),
                      _s(F.unix_millis("ts")))
    text = F.concat(F.lit("# TYPE "), F.col("event_type"), F.lit(" gauge\n"), sample,
                    F.when(F.col("event_id") % 7 == 0,
                           F.concat(F.lit("\n"), F.col("event_type"), F.lit("_bad 1d"))).otherwise(F.lit("")))
    blk = F.floor(F.col("event_id") / REQUEST_BLOCK).cast("bigint")
    g = (b.groupBy("tenant_id", "service", blk.alias("blk"))
          .agg(F.min("ts").alias("received_at"),
               F.sort_array(F.collect_list(F.struct("ts", "event_id", text.alias("t")))).alias("items")))
    return g.select(
        F.concat_ws("/", "tenant_id", "service", _s("blk")).alias("request_id"),
        "tenant_id", "service", F.lit("").alias("instance"), F.lit("production").alias("environment"),
        "received_at",
        F.array_join(F.transform("items", lambda x: x["t"]), "\n").alias("exposition"),
    )


def anomalies(spark: SparkSession, base: str) -> DataFrame:
    """One anomaly per event: score = least(1, value / 200); context = its JSON."""
    b = event_base(read_table(spark, base, "events"))
    score = F.least(F.lit(1.0), F.col("value") / F.lit(200.0))
    ctx = F.concat(F.lit('{"anomaly_id":'), _s("event_id"), F.lit(',"metric_name":"'), F.col("event_type"),
                   F.lit('","tenant_id":"'), F.col("tenant_id"), F.lit('"}'))
    return b.select(F.col("event_id").alias("anomaly_id"), "tenant_id",
                    F.col("event_type").alias("metric_name"), score.alias("anomaly_score"), "ts",
                    ctx.alias("context"))


def admission_requests(spark: SparkSession, base: str) -> DataFrame:
    """Every event is one ingest request of its tenant."""
    b = event_base(read_table(spark, base, "events"))
    return b.select("event_id", "tenant_id", "ts")


def signal_events(spark: SparkSession, base: str) -> DataFrame:
    """Typed events of every payload kind, one per event row, dealt by ``event_id % 6``: log, gauge,
    counter, histogram, summary, trace."""
    b = event_base(read_table(spark, base, "events"))
    n, eid = F.col("event_id") % 6, _s("event_id")
    double, none = (lambda c: F.col(c).cast("double")), (lambda t: F.lit(None).cast(t))
    log = F.struct(F.col("src_level").alias("level"), F.col("src_message").alias("message"),
                   F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("tr"), eid)).alias("trace_id"), none("string").alias("span_id"),
                   F.lit("{}").alias("fields"))
    value = F.struct(
        F.element_at(F.array(*[F.lit(k) for k in ("gauge", "counter", "histogram", "summary")]), F.greatest(F.least(n, F.lit(4)), F.lit(1)).cast("int")).alias("kind"),
        F.when(n == 1, double("value")).when(n == 2, double("user_id")).alias("value"),
        F.when(n == 3, F.array(F.struct(F.lit(50.0).alias("le"), F.lit(1).cast("bigint").alias("count")),
                               F.struct(F.lit(500.0).alias("le"), F.lit(2).cast("bigint").alias("count")))).alias("buckets"),
        F.when(n == 4, F.array(F.struct(F.lit(0.5).alias("q"), double("value").alias("v")))).alias("quantiles"),
        F.when(n.isin(3, 4), double("value") * 2).alias("sum"), F.when(n.isin(3, 4), F.lit(2).cast("bigint")).alias("count"))
    metric = F.struct(F.col("event_type").alias("name"), value.alias("value"), none("string").alias("unit"))
    trace = F.struct(F.concat(F.lit("tr"), eid).alias("trace_id"), F.concat(F.lit("sp"), eid).alias("span_id"), none("string").alias("parent_span_id"),
                     F.col("event_type").alias("operation_name"), F.col("ts").alias("start_time"),
                     (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("end_time"),
                     F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.lit("{}").alias("attributes"))
    payload = F.struct(F.when(n == 0, "log").when(n == 5, "trace").otherwise("metric").alias("type"), F.when(n == 0, log).alias("log"),
                       F.when(n.between(1, 4), metric).alias("metric"), F.when(n == 5, trace).alias("trace"))
    source = F.struct("service", F.lit("").alias("instance"), "environment", none("string").alias("k8s_context"))
    return b.select(F.concat(F.lit("ev"), eid).alias("id"), "tenant_id", source.alias("source"), payload.cast(PAYLOAD_DDL).alias("payload"),
                    F.col("ts").alias("timestamp"), F.col("ts").alias("ingested_at"),
                    F.create_map(F.lit("user"), _s("user_id")).alias("labels"))
