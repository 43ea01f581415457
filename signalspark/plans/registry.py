"""Registered queries: name → ``fn(spark, base_dir) -> DataFrame``.

Every query reads the driver tables (or data Spark derives from them) in
full, so its work grows with the tables; LIMIT appears only where top-k is
the feature itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import query as Q
from ..operators.envelope import explode_log_envelopes
from ..operators.parse_logs import parse_logs
from ..session import configure
from ..sources import fixtures as fx
from . import flows

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, base: str) -> DataFrame:
            configure(spark)
            return fn(spark, base)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return deco


PARSED = ["log_format", "level", "message", "trace_id", "span_id", "fields"]


@register("a1_explode_log_envelopes")
def _a1(spark, base):
    """A1: envelopes of up to 64 lines → one row per line with defaults."""
    return explode_log_envelopes(fx.log_envelopes(spark, base), keep=("request_id",))


@register("a2_parse_event_lines")
def _a2_events(spark, base):
    """Parse JSON / logfmt / prefixed / bare lines derived from events."""
    return parse_logs(fx.log_lines(spark, base)).select("event_id", "raw", *PARSED)


@register("a2_parse_document_lines")
def _a2_docs(spark, base):
    """A2–A6 over every line of every document (whole texts)."""
    return flows.document_log_lines(spark, base).select("request_id", "line_no", *PARSED)


@register("b1_log_rows")
def _b1(spark, base):
    """B1: the full logs table."""
    return flows.event_log_rows(spark, base)


@register("c2_search_logs")
def _c2(spark, base):
    """Newest 100 logs of tenant t1 whose message contains 'K1' (any case)."""
    return Q.search_logs(flows.event_log_rows(spark, base), "t1", q="K1")


@register("c2_search_logs_filtered")
def _c2b(spark, base):
    """C2 with time range, exact level and service filters, limit at the cap."""
    import datetime as dt
    return Q.search_logs(flows.event_log_rows(spark, base), "t3",
                         from_=dt.datetime(2024, 1, 6), to=dt.datetime(2024, 1, 16, 23, 59, 59),
                         level="ERROR", service="api", limit=5000)


@register("c10_format_logs")
def _c10(spark, base):
    """Display projection of the whole logs table."""
    return Q.format_logs(flows.event_log_rows(spark, base))


@register("c11_min_level")
def _c11(spark, base):
    """C11: logs at WARN or above."""
    return Q.min_level(flows.event_log_rows(spark, base), "WARN").select(
        "tenant_id", "timestamp", "level", "service", "message")


# ------------------------------------------------------------------ metrics side
from ..operators.envelope import explode_metric_envelopes  # noqa: E402
from ..operators.events import log_events  # noqa: E402
from ..operators.events import route_signals  # noqa: E402
from ..operators.rows import metric_rows, sorted_map_json  # noqa: E402


@register("a7_parse_exposition")
def _a7(spark, base):
    """Prometheus text bodies → samples; comments and bad lines dropped."""
    s = explode_metric_envelopes(fx.exposition_envelopes(spark, base))
    return s.select("request_id", "sample_no", "name", sorted_map_json("labels").alias("labels"), "value")


@register("a8_prometheus_metric_rows")
def _a8(spark, base):
    """A8 → B2: samples become gauge events stamped with the receive time."""
    return metric_rows(flows.exposition_metric_events(spark, base))


@register("b2_metric_rows")
def _b2(spark, base):
    """B2: the metrics table (one gauge per event)."""
    return flows.event_metric_rows(spark, base)


@register("c3_query_metrics")
def _c3(spark, base):
    """Newest 500 'purchase' rows of tenant t2 in the first two weeks."""
    import datetime as dt
    return Q.query_metrics(flows.event_metric_rows(spark, base), "t2", name="purchase",
                           from_=dt.datetime(2024, 1, 1), to=dt.datetime(2024, 1, 14, 23, 59, 59))


@register("c4_latest_metrics")
def _c4(spark, base):
    """C4: the 10 newest metric rows of every tenant."""
    return Q.latest_metrics(flows.event_metric_rows(spark, base), 10)


@register("a9_event_ids")
def _a9(spark, base):
    """Deterministic event ids (stable across task retries)."""
    from ..operators.events import stable_uuid
    b = fx.event_base(fx.read_table(spark, base, "events"))
    return b.select("event_id", "tenant_id", stable_uuid(F.lit("log"), "tenant_id", "event_id").alias("id"))


@register("a13_route_signals")
def _a13(spark, base):
    """Events per topic and tenant after routing logs and metrics."""
    ev = flows.event_log_events(spark, base).unionByName(flows.exposition_metric_events(spark, base))
    topics = route_signals(ev)
    parts = [df.select(F.lit(name).alias("topic"), "tenant_id") for name, df in topics.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("topic", "tenant_id").agg(F.count(F.lit(1)).alias("events"))


# ------------------------------------------------------------- admission, alerting
from ..operators import admission as AD  # noqa: E402
from ..operators import alerting as AL  # noqa: E402
from ..operators.envelope import ingest_summary  # noqa: E402
from ..sources import metadata as MD  # noqa: E402


@register("a10_admission")
def _a10(spark, base):
    """A10: token bucket per tenant, 4 tokens, refilled 4 per 2 hours."""
    out = AD.admit(fx.admission_requests(spark, base), capacity=4, refill=4, period="2 hours")
    return out.select("event_id", "tenant_id", "admitted", "tokens_units")


@register("a11_admission_overrides")
def _a11(spark, base):
    """Per-tenant limit overrides (per hour), default 4."""
    out = AD.admit(fx.admission_requests(spark, base), capacity=4, period="1 hour",
                   limits=MD.limit_overrides(spark))
    return out.select("event_id", "tenant_id", "admitted", "tokens_units")


@register("a12_ingest_summary")
def _a12(spark, base):
    """Admit whole envelopes (one token per request), count per tenant."""
    env = fx.log_envelopes(spark, base).select("request_id", "tenant_id", "received_at",
                                               F.size("lines").cast("bigint").alias("n_lines"))
    dec = AD.admit(env, ts="received_at", id_col="request_id", capacity=4, refill=4, period="2 hours")
    return ingest_summary(dec)


def alerts_df(spark, base):
    """Anomalies matched to rules with cooldown applied."""
    m = AL.match_rules(fx.anomalies(spark, base), MD.rules(spark))["matches"]
    return AL.apply_cooldown(m)


@register("e1_match_rules")
def _e1(spark, base):
    """Anomaly ⨝ enabled rules, threshold test, alert text."""
    m = AL.match_rules(fx.anomalies(spark, base), MD.rules(spark))["matches"]
    return m.select("anomaly_id", "tenant_id", "rule_id", "metric_name", "anomaly_score", "title", "description")


@register("e3_cooldown")
def _e3(spark, base):
    """Cooldown per rule over the matched anomalies."""
    return alerts_df(spark, base).select("anomaly_id", "rule_id", F.unix_micros("ts").alias("ts_us"), "fired")


def incidents_df(spark, base):
    return AL.open_incidents_from(alerts_df(spark, base))


@register("e5_open_incidents")
def _e5(spark, base):
    """E5: one open incident per fired alert."""
    return incidents_df(spark, base).select(
        "id", "tenant_id", "alert_rule_id", "title", "description", "severity", "status", "context",
        F.unix_micros("opened_at").alias("opened_at_us"))


@register("e6_open_unique")
def _e6(spark, base):
    """At most one open incident per (tenant, rule)."""
    return AL.open_unique(incidents_df(spark, base)).select(
        "id", "tenant_id", "alert_rule_id", F.unix_micros("opened_at").alias("opened_at_us"))


@register("e6_open_unique_existing")
def _e6x(spark, base):
    """Against a live table: keys with an unresolved incident open nothing, resolved ones don't count."""
    inc = incidents_df(spark, base)
    first = inc.where(F.col("alert_rule_id").substr(-1, 1).isin("1", "2", "6")).withColumn("status", F.when(F.col("alert_rule_id").endswith("1"), "resolved")
                                                                                           .when(F.col("alert_rule_id").endswith("2"), "acknowledged").otherwise("open"))
    return AL.open_unique(inc, first).select("id", "tenant_id", "alert_rule_id", F.unix_micros("opened_at").alias("opened_at_us"))


def _resolved(spark, base):
    inc = incidents_df(spark, base)
    r6 = inc.filter(F.col("alert_rule_id").endswith("6"))
    res = r6.select("tenant_id", "id", (F.col("opened_at") + F.expr("INTERVAL 1 HOUR")).alias("resolved_at"),
                    F.lit("u2").alias("resolved_by")).unionByName(
          r6.select("tenant_id", "id", (F.col("opened_at") + F.expr("INTERVAL 2 HOURS")).alias("resolved_at"),
                    F.lit("u3").alias("resolved_by")))
    return AL.resolve_incidents(inc, res)


@register("c5_open_incidents")
def _c5(spark, base):
    """The 50 newest unresolved incidents of t1."""
    return Q.open_incidents(_resolved(spark, base), "t1").select(
        "id", "title", "description", "severity", "status", "context", F.unix_micros("opened_at").alias("opened_at_us"))


@register("e7_resolve_incidents")
def _e7(spark, base):
    """Resolve rule-6 incidents twice; the later resolution wins."""
    return _resolved(spark, base).select("id", "tenant_id", "status",
                                         F.unix_micros("resolved_at").alias("resolved_at_us"), "resolved_by")


@register("e8_acknowledge_incidents")
def _e8(spark, base):
    """Acknowledge t0/t2 incidents; only open ones change."""
    inc = _resolved(spark, base)
    acks = inc.filter(F.col("tenant_id").isin("t0", "t2")).select(
        "tenant_id", "id", (F.col("opened_at") + F.expr("INTERVAL 10 MINUTES")).alias("acknowledged_at"),
        F.lit("u0").alias("acknowledged_by"))
    return AL.acknowledge_incidents(inc, acks).select(
        "id", "tenant_id", "status", F.unix_micros("acknowledged_at").alias("acknowledged_at_us"), "acknowledged_by")


@register("e9_notifications")
def _e9(spark, base):
    """One payload per fired alert and channel."""
    return _notified(AL.notifications(alerts_df(spark, base))["notifications"])


def _notified(n):
    return n.select("anomaly_id", "tenant_id", "rule_id", F.unix_micros("ts").alias("ts_us"),
                    F.col("channel_no").cast("int").alias("channel_no"), "channel_type", "target", "payload")


@register("e9_unsendable")
def _e9u(spark, base):
    """Rules whose channels are no list, lack an address or have no type; nothing else is lost."""
    odd = MD.rules(spark).where("is_enabled and rule_type = 'ai_anomaly'").withColumn(
        "channels", F.when(F.col("tenant_id") == "t0", "oops").when(F.col("tenant_id") == "t2", '[{"type":"slack"},{"url":"https://example.com"},{"type":"webhook","url":"https://example.com/ok"}]')
        .otherwise('{"type":"slack","url":"https://example.com"}'))
    out = AL.run_alerting(fx.anomalies(spark, base), odd)
    sent, bad = out["notifications"].withColumn("reason", F.lit("sent")), out["notification_rejects"]
    keys = ["tenant_id", "rule_id", F.col("channel_no").cast("int").alias("channel_no"), "channel_type", "reason"]
    return sent.select(*keys).unionByName(bad.select(*keys)).groupBy("tenant_id", "rule_id", "channel_no", "channel_type", "reason").agg(F.count(F.lit(1)).alias("n"))


@register("e1_tenant_ids")
def _e1u(spark, base):
    """Tenants as UUIDs in every accepted form and in broken ones: matches by tenant, rejects by reason."""
    uuid = lambda c: F.concat(F.lit("00000000-0000-4000-8000-0000000000A"), F.substring(c, 2, 1))
    an, u, n = fx.anomalies(spark, base), uuid("tenant_id"), F.col("anomaly_id") % 8
    text = (F.when(n == 0, u).when(n == 1, F.lower(u)).when(n == 2, F.concat(F.lit("{"), u, F.lit("}"))).when(n == 3, F.concat(F.lit("urn:uuid:"), u))
            .when(n == 4, F.replace(u, F.lit("-"))).when(n == 5, F.substring(u, 1, 35)).when(n == 6, ""))
    out = AL.match_rules(an.withColumn("tenant_id", text), MD.rules(spark).withColumn("tenant_id", F.lower(uuid("tenant_id"))), validate_uuid=True)
    told = lambda df, what: df.select("tenant_id", what.alias("what"))
    return told(out["matches"], F.col("rule_id")).unionByName(told(out["rejects"], F.col("reason"))).groupBy("tenant_id", "what").agg(F.count(F.lit(1)).alias("n"))


@register("e9_notification_rejects")
def _e9r(spark, base):
    """Channels of unknown type are routed to a reject table."""
    n = AL.notifications(alerts_df(spark, base))["rejects"]
    return n.select("anomaly_id", "tenant_id", "rule_id", F.unix_micros("ts").alias("ts_us"),
                    F.col("channel_no").cast("int").alias("channel_no"), "channel_type", "reason")


@register("e10_threshold_rules")
def _e10(spark, base):
    """Threshold rules over tumbling windows of the metrics table."""
    b = AL.evaluate_threshold_rules(flows.event_metric_rows(spark, base), MD.rules(spark))
    return b.select("tenant_id", "rule_id", "name", "window_start", "samples")


# ------------------------------------------------------------------ detection
from ..operators import detect as DT  # noqa: E402

SERIES_KEYS = ("tenant_id", "name", "day")


def daily_metrics(spark, base, seconds=86400):
    """The metrics table with ``day``, the number of the period of so many seconds."""
    return flows.event_metric_rows(spark, base).withColumn("day", F.floor(F.col("timestamp") / seconds).cast("bigint"))


def daily_series(spark, base, seconds=86400):
    """D1 over the metrics table: all values per (tenant, metric, day)."""
    return DT.recent_values(daily_metrics(spark, base, seconds), keys=SERIES_KEYS)


@register("d1_recent_values")
def _d1(spark, base):
    """Whole series, oldest → newest (values shown in cents)."""
    s = daily_series(spark, base)
    return s.select("tenant_id", "name", "day", F.size("values").cast("bigint").alias("n_values"), "last_ts",
                    F.array_join(F.transform("values", lambda v: F.round(v * 100).cast("bigint").cast("string")),
                                 ",").alias("values_cents"))


@register("d1_recent_rows")
def _d1r(spark, base):
    """D1 as rows: the 20 newest samples of every (tenant, metric)."""
    return DT.recent_rows(flows.event_metric_rows(spark, base), n=20)


@register("d2_short_history")
def _d2(spark, base):
    """Whole series of six hours; those of under 5 values score 0 with 'Insufficient history'."""
    return DT.detect_expected(daily_series(spark, base, seconds=21600)).select(
        "tenant_id", "name", F.col("day").alias("quarter_day"), F.size("values").cast("bigint").alias("n_values"),
        F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly", "reason")


@register("d3_detect")
def _d3(spark, base):
    """D3: isolation forest (100 trees, ψ ≤ 256, contamination 0.1) per series."""
    return DT.detect_series(daily_metrics(spark, base), keys=SERIES_KEYS).select(
        "tenant_id", "name", "day", "n_values", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly", "reason")


@register("d4_detect_expected")
def _d4(spark, base):
    """Deterministic expected-depth isolation score per series."""
    return DT.detect_expected(daily_series(spark, base)).select(
        "tenant_id", "name", "day", F.size("values").cast("bigint").alias("n_values"),
        F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly", "reason")


def anomaly_stream(spark, base, forest=False):
    if forest:
        d = DT.detect_series(daily_metrics(spark, base), keys=SERIES_KEYS).withColumn("anomaly_score", F.round("anomaly_score", 6))
    else:
        d = DT.detect_expected(daily_series(spark, base))
    return DT.to_anomaly_events(d, keys=SERIES_KEYS, ts="last_ts").withColumnRenamed("name", "metric_name")


@register("d6_anomaly_events")
def _d6(spark, base):
    """Anomalous detections published as anomaly events."""
    return anomaly_stream(spark, base).select("anomaly_id", "tenant_id", "metric_name",
                                              F.round("anomaly_score", 6).alias("anomaly_score"),
                                              F.unix_micros("ts").alias("ts_us"))


def _alert_flow(spark, base, forest=False):
    return AL.run_alerting(anomaly_stream(spark, base, forest), MD.rules(spark))


@register("e11_alert_flow")
def _e11(spark, base):
    """Series → D4 detection → anomalies → rules → cooldown → incidents."""
    return _alert_flow(spark, base)["incidents"].select("id", "tenant_id", "alert_rule_id", "title", "description", "severity",
                                                        "status", F.unix_micros("opened_at").alias("opened_at_us"))


@register("e11_notifications")
def _e11n(spark, base):
    """The notifications of the same flow."""
    return _notified(_alert_flow(spark, base)["notifications"])


@register("e11_alert_flow_iforest")
def _e11f(spark, base):
    """E11 with the isolation forest (D3) as detector, scores to six digits."""
    return _alert_flow(spark, base, forest=True)["incidents"].select(
        "id", "tenant_id", "alert_rule_id", "title", "context", F.unix_micros("opened_at").alias("opened_at_us"))


# ------------------------------------------------------------------ vectors
from ..operators import vectors as VC  # noqa: E402


def _checksum(col="vector"):
    return F.round(F.aggregate(F.zip_with(F.col(col), F.sequence(F.lit(1), F.size(col)),
                                          lambda x, i: x.cast("double") * i), F.lit(0.0), lambda a, b: a + b), 4)


@register("b9_embed_documents")
def _b9(spark, base):
    """Embed every whole document text (hashing encoder, dim 384)."""
    d = VC.embed(fx.read_table(spark, base, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.size(F.filter("vector", lambda x: x != 0)).cast("bigint").alias("nnz"),
                    _checksum().alias("checksum"))


def log_vectors(spark, base):
    return VC.vector_points(flows.event_log_events(spark, base))


@register("b8_vector_upsert")
def _b8(spark, base):
    """Stored points of every third event, incoming ones of every second: the incoming one wins."""
    lines = fx.log_lines(spark, base)
    events = lambda every, lines: VC.vector_points(log_events(parse_logs(lines.where(F.col("event_id") % every == 0)), id_cols=("event_id",), ts_col="ts"))
    old = events(3, lines.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE")).withColumn("raw", F.concat(F.lit("old "), F.col("event_id").cast("string"))))
    merged = VC.upsert_vectors(old, events(2, lines))
    return merged.select("id", "tenant_id", "message", "timestamp", F.size(F.filter("vector", lambda x: x != 0)).cast("bigint").alias("nnz"), _checksum().alias("checksum"))


@register("c6_semantic_search")
def _c6(spark, base):
    """Embed 'error k1' and return the 10 most similar t1 log messages."""
    q = VC.hash_embed("error k1")
    r = VC.semantic_search(log_vectors(spark, base), q, "t1", limit=10)
    return r.select("id", "tenant_id", "message", "timestamp", F.round("score", 6).alias("score"))


def embedding_vectors(spark, base):
    e = fx.read_table(spark, base, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"),
                    F.concat(F.lit("t"), (F.col("label") % 5).cast("string")).alias("tenant_id"),
                    F.col("label"), F.col("embedding").alias("vector"))


def label_centroids(spark, base):
    """Query vectors derived from the data: the mean vector of every label."""
    e = fx.read_table(spark, base, "embeddings")
    x = e.select("label", F.posexplode("embedding").alias("pos", "x"))
    c = x.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("c"))
    g = c.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "c"))).alias("s"))
    return g.select(F.concat(F.lit("label-"), F.col("label").cast("string")).alias("query_id"),
                    F.concat(F.lit("t"), (F.col("label") % 5).cast("string")).alias("tenant_id"),
                    F.transform("s", lambda z: z["c"]).alias("qvector"))


@register("c7_semantic_search_batch")
def _c7(spark, base):
    """Top-5 vectors of the query's tenant for every label centroid."""
    r = VC.semantic_search_batch(embedding_vectors(spark, base), label_centroids(spark, base), k=5)
    return r.select("query_id", "tenant_id", "id", F.round("score", 6).alias("score"), "rank")


@register("c8_ann_search")
def _c8(spark, base):
    """LSH candidates + exact re-rank for the label-0 centroid in t0 (approximate)."""
    vecs = embedding_vectors(spark, base)
    q = label_centroids(spark, base).filter(F.col("query_id") == "label-0").first()["qvector"]
    r = VC.ann_search(VC.ann_index(vecs), q, k=10, tenant_id="t0")
    return r.select("id", "tenant_id", F.round("score", 6).alias("score"))


@register("c8_ivf_all_cells")
def _c8i(spark, base):
    """The inverted-file index, searched in all cells: the exact top 10 of t0 for the label-0 centroid."""
    import uuid
    from ..operators.ivf import build_ivf
    from ..session import checkpoint_dir
    index = build_ivf(embedding_vectors(spark, base), f"{checkpoint_dir(spark)}/ivf-{uuid.uuid4()}")
    q = label_centroids(spark, base).filter(F.col("query_id") == "label-0").first()["qvector"]
    return index.search(q, 10, "t0", probes=len(index.centroids)).select("id", "tenant_id", F.round("score", 6).alias("score"))


@register("c8_ivf_recall")
def _c8r(spark, base):
    """Recall of the index at its default probes for every label centroid in its tenant (k = 10)."""
    import uuid
    from ..operators.ivf import build_ivf
    from ..session import checkpoint_dir
    vecs, queries = embedding_vectors(spark, base), label_centroids(spark, base)
    index = build_ivf(vecs, f"{checkpoint_dir(spark)}/ivf-{uuid.uuid4()}")
    true = VC.semantic_search_batch(vecs, queries, k=10).select("query_id", "id")
    found = None
    for r in queries.collect():  # one query vector a label
        got = index.search(r.qvector, 10, r.tenant_id).select(F.lit(r.query_id).alias("query_id"), "id")
        found = got if found is None else found.unionByName(got)
    hit = true.join(found.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


# ------------------------------------------------------------------ insight
from ..operators import insight as IN  # noqa: E402


def services_df(spark):
    rows = [(f"t{t}", s) for t in range(5) for s in fx.SERVICES + ["billing"]]
    return spark.createDataFrame(rows, "tenant_id STRING, service STRING")


@register("f1_explain")
def _f1(spark, base):
    """root-cause sentence per (tenant, service) from its 100 newest logs."""
    return IN.explain(services_df(spark), flows.event_log_rows(spark, base))


@register("f2_explain_context")
def _f2(spark, base):
    """5 newest log messages and metric samples per (tenant, service)."""
    c = IN.explain_context(flows.event_log_rows(spark, base), flows.event_metric_rows(spark, base), k=5)
    return c.select("tenant_id", "service", F.array_join("recent_logs", " | ").alias("recent_logs"),
                    F.array_join(F.transform("metric_data", lambda m: F.concat(
                        m["name"], F.lit("="), F.round(m["value"] * 100).cast("bigint").cast("string"))), " | ")
                    .alias("metric_data"))


@register("f3_error_rate")
def _f3(spark, base):
    """daily error rate per tenant."""
    return IN.error_rate(flows.event_log_rows(spark, base), "1 day")


@register("f4_p99")
def _f4(spark, base):
    """daily p99 of 'purchase' per tenant (exact order statistic)."""
    return IN.p99(flows.event_metric_rows(spark, base), "purchase", "1 day")


@register("f5_throughput")
def _f5(spark, base):
    """hourly events per second per tenant."""
    return IN.throughput(flows.event_log_rows(spark, base), "1 hour")


@register("f6_gauge_card")
def _f6(spark, base):
    """latest and mean 'view' gauge per tenant."""
    return IN.gauge_card(flows.event_metric_rows(spark, base), "view")


@register("f7_pct_change")
def _f7(spark, base):
    """day-over-day change of the event count per tenant."""
    kpi = IN.throughput(flows.event_log_rows(spark, base), "1 day").select("tenant_id", "bucket_start", "events")
    return IN.pct_change(kpi, "events")


@register("f8_traffic")
def _f8(spark, base):
    """F8: hourly requests per (tenant, service)."""
    return IN.traffic(fx.event_base(fx.read_table(spark, base, "events")), "1 hour")


# ------------------------------------------------------------------ storage, metadata, wire
from ..operators import storage as ST  # noqa: E402
from ..operators.rows import log_rows as _log_rows  # noqa: E402
from ..sources import events_io as EIO  # noqa: E402


@register("a15_event_roundtrip")
def _a15(spark, base):
    """Log events → wire JSON → events → log rows (must equal B1)."""
    from ..session import checkpoint_dir
    checkpoint_dir(spark)
    # the wire format is a transport boundary (a topic in production): cut the
    # lineage there so the decode plan does not re-inline the encode plan
    enc = EIO.encode_events(flows.event_log_events(spark, base)).checkpoint(eager=True)
    return _log_rows(EIO.decode_events(enc))


@register("a15_metric_roundtrip")
def _a15m(spark, base):
    """Metric events through the wire format (must equal B2)."""
    ev = flows.event_metric_rows  # noqa: F841  (same rows as B2)
    b = fx.event_base(fx.read_table(spark, base, "events"))
    from ..operators.events import metric_events
    samples = b.select(
        F.col("event_id").cast("string").alias("request_id"), F.lit(0).alias("sample_no"),
        "tenant_id", "service", F.lit("").alias("instance"), "environment", "ts",
        F.col("event_type").alias("name"), "value",
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"))
    from ..session import checkpoint_dir
    checkpoint_dir(spark)
    enc = EIO.encode_events(metric_events(samples, ts_col="ts", ingested_at=F.col("ts"))).checkpoint(eager=True)
    return metric_rows(EIO.decode_events(enc))


@register("b5_partitioned_logs")
def _b5(spark, base):
    """Month partition column and range/sort layout of the logs table."""
    return ST.layout(flows.event_log_rows(spark, base), "logs").select(
        "yyyymm", "tenant_id", "timestamp", "level", "message")


@register("b6_retention")
def _b6(spark, base):
    """30-day retention as of 2024-02-10."""
    import datetime as dt
    r = ST.apply_retention(flows.event_log_rows(spark, base), dt.datetime(2024, 2, 10), 30)
    return r.select("tenant_id", "timestamp", "level", "message")


@register("b7_plan_retention")
def _b7(spark, base):
    """Per-plan retention (free 7 days, pro/enterprise 30) as of 2024-01-31."""
    import datetime as dt
    r = ST.apply_plan_retention(flows.event_log_rows(spark, base), MD.tenants(spark), dt.datetime(2024, 1, 31))
    return r.select("tenant_id", "timestamp", "level", "message")


@register("b7_plan_days")
def _b7p(spark, base):
    """Days from the plan (7/30/365), one tenant with its own number, one of an unknown plan."""
    import datetime as dt
    t = MD.tenants(spark).withColumn("retention_days", F.when(F.col("id") == "t2", 12)).withColumn("plan", F.when(F.col("id") == "t4", "trial").otherwise(F.col("plan")))
    r = ST.apply_plan_retention(flows.event_log_rows(spark, base), t, dt.datetime(2024, 2, 4))
    return r.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("oldest"))


@register("b10_purge_tables")
def _b10t(spark, base):
    """What every table keeps after the purge of t0 and t4."""
    tables = {"tenants": MD.tenants(spark), "users": MD.users(spark), "alert_rules": MD.rules(spark), "incidents": incidents_df(spark, base)}
    out = ST.purge_tenants(tables, spark.createDataFrame([("t0",), ("t4",)], "tenant_id STRING"))
    rows = None
    for name, df in out.items():
        part = df.select(F.lit(name).alias("table_name"), (F.col("id") if name == "tenants" else F.col("tenant_id")).alias("tenant_id"), F.col("id").alias("row_id"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@register("c9_capped_limit")
def _c9(spark, base):
    """A limit of 100,000 comes down to the cap of 1,000."""
    return Q.search_logs(flows.event_log_rows(spark, base), "t1", limit=100_000).select("timestamp", "level", "service", "message")


# ------------------------------------------------------------------ every kind of signal
@register("a13_signals")
def _a13s(spark, base):
    """Logs, metrics, traces and anomalies in one pass: signals by topic and tenant."""
    from ..operators.events import signal_rows
    rows = signal_rows(fx.signal_events(spark, base), fx.anomalies(spark, base))
    return rows.groupBy("topic", F.col("key").alias("tenant_id")).agg(F.count(F.lit(1)).alias("signals"))


@register("b2_metric_kinds")
def _b2k(spark, base):
    """B2: gauges, counters, histograms and summaries as metric rows."""
    return metric_rows(fx.signal_events(spark, base))


@register("b3_trace_rows")
def _b3t(spark, base):
    """Spans keep their own rows; logs and metrics drop out."""
    from ..operators.rows import trace_rows
    return trace_rows(fx.signal_events(spark, base))


@register("a14_event_source")
def _a14(spark, base):
    """Events of every kind, and malformed lines, through JSON-lines segments and the event
    source: what comes back, and the rejects with their reasons."""
    import uuid
    from ..session import checkpoint_dir
    topic = f"{checkpoint_dir(spark)}/topic-{uuid.uuid4()}"
    ev = fx.read_table(spark, base, "events").select("event_id")
    bad = ev.where(F.col("event_id") % 50 == 0).select(F.concat(F.when(F.col("event_id") % 100 == 0, '{"id": oops ').otherwise('{"id":"x","n":'),
                                                              F.col("event_id").cast("string"), F.when(F.col("event_id") % 100 == 0, "").otherwise("}")).alias("value"))
    EIO.encode_events(fx.signal_events(spark, base)).select("value").unionByName(bad).write.text(topic)
    got = EIO.read_events(spark, topic, fmt="signal_events", rejects=True)
    p = F.col("payload")
    v = p["metric"]["value"]
    good = got["events"].select(
        "id", "tenant_id", p["type"].alias("payload_type"), F.coalesce(v["kind"], p["log"]["level"], p["trace"]["status"]).alias("kind"),
        F.coalesce(p["log"]["message"], p["metric"]["name"], p["trace"]["operation_name"]).alias("name"), F.coalesce(v["value"], v["sum"]).alias("value"),
        F.coalesce(F.size(v["buckets"]), F.size(v["quantiles"]), F.lit(0)).cast("bigint").alias("parts"), F.unix_micros("timestamp").alias("ts_us"), F.lit("").alias("reason"))
    rejects = got["rejects"].select(*[F.lit(None).cast(t).alias(c) for c, t in (("id", "string"), ("tenant_id", "string"), ("payload_type", "string"), ("kind", "string"))],
                                    F.col("value").cast("string").alias("name"), F.lit(None).cast("double").alias("value"), F.lit(0).cast("bigint").alias("parts"),
                                    F.lit(0).cast("bigint").alias("ts_us"), "reason")
    return good.unionByName(rejects)


@register("b10_purge_tenant")
def _b10(spark, base):
    """Purge tenant t0 from incidents, users and rules with cascades."""
    inc = _resolved(spark, base)
    acks = inc.filter(F.col("tenant_id").isin("t0", "t2")).select(
        "tenant_id", "id", (F.col("opened_at") + F.expr("INTERVAL 10 MINUTES")).alias("acknowledged_at"),
        F.lit("u0").alias("acknowledged_by"))
    inc = AL.acknowledge_incidents(inc, acks)
    tables = {"tenants": MD.tenants(spark), "users": MD.users(spark), "alert_rules": MD.rules(spark),
              "incidents": inc}
    out = ST.purge_tenants(tables, spark.createDataFrame([("t0",)], "tenant_id STRING"))
    return out["incidents"].select("id", "tenant_id", "alert_rule_id", "status", "acknowledged_by")


@register("b11_audit_unique")
def _b11(spark, base):
    """Repeated (tenant, message) pairs in the logs table."""
    return ST.audit_unique(flows.event_log_rows(spark, base), ["tenant_id", "message"])


@register("a16_insert_ignore")
def _a16(spark, base):
    """Seed tenants seen in the events into a table holding t0, t1 (insert-if-absent)."""
    target = MD.tenants(spark).filter(F.col("id").isin("t0", "t1")).select("id", "name", "plan", "ingest_rate_per_second")
    seen = fx.event_base(fx.read_table(spark, base, "events")).select(
        F.col("tenant_id").alias("id"), F.concat(F.lit("tenant "), F.col("tenant_id")).alias("name"),
        F.lit("free").alias("plan"), F.lit(100).alias("ingest_rate_per_second"), "ts")
    return ST.insert_ignore(target, seen, ["id"], order=["ts"])


@register("d5_score_isolation")
def _d5(spark, base):
    """Fit a forest per (tenant, metric) on a bounded sample, score every row."""
    m = flows.event_metric_rows(spark, base)
    models = DT.fit_isolation(m)
    s = DT.score_isolation(m, models)
    return s.select("tenant_id", "name", "timestamp", "value", F.round("anomaly_score", 6).alias("anomaly_score"),
                    "is_anomaly")
