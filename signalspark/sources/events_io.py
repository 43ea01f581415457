"""Event wire JSON (tagged unions) and event sources/sinks.

The wire form mirrors the event model: ``payload`` is tagged by ``type``
(log/metric/trace) with the arm's fields inlined, a metric value is tagged by
``kind``, histogram/summary pairs are 2-element arrays, levels are upper-case.
Sources and sinks are plain DataFrame readers/writers; streaming uses the
same decode on ``readStream`` (file source here; ``format("kafka")`` with
the same ``value`` column on a cluster).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LEVELS
from ..schemas import SOURCE_DDL
from . import event_source

WIRE_DDL = (f"id STRING, tenant_id STRING, source {SOURCE_DDL}, payload VARIANT, timestamp TIMESTAMP, "
            "ingested_at TIMESTAMP, labels MAP<STRING, STRING>")
TS_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _payload_json() -> Column:
    p = F.col("payload")
    lg, mt, tr = p["log"], p["metric"], p["trace"]
    v = mt["value"]
    value = F.when(v["kind"].isin("gauge", "counter"),
                   F.to_json(F.struct(v["kind"].alias("kind"), v["value"].alias("value"))))
    value = value.when(v["kind"] == "histogram", F.to_json(F.struct(
        v["kind"].alias("kind"),
        F.transform(v["buckets"], lambda b: F.array(b["le"], b["count"].cast("double"))).alias("buckets"),
        v["sum"].alias("sum"), v["count"].alias("count"))))
    value = value.when(v["kind"] == "summary", F.to_json(F.struct(
        v["kind"].alias("kind"), F.transform(v["quantiles"], lambda q: F.array(q["q"], q["v"])).alias("quantiles"),
        v["sum"].alias("sum"), v["count"].alias("count"))))
    log_json = F.to_json(F.struct(F.lit("log").alias("type"), lg["level"].alias("level"), lg["message"].alias("message"),
                                  lg["trace_id"].alias("trace_id"), lg["span_id"].alias("span_id"),
                                  F.parse_json(F.coalesce(lg["fields"], F.lit("{}"))).alias("fields")))
    metric_json = F.to_json(F.struct(F.lit("metric").alias("type"), mt["name"].alias("name"),
                                     F.parse_json(value).alias("value"), mt["unit"].alias("unit")))
    trace_json = F.to_json(F.struct(F.lit("trace").alias("type"), tr["trace_id"].alias("trace_id"),
                                    tr["span_id"].alias("span_id"), tr["parent_span_id"].alias("parent_span_id"),
                                    tr["operation_name"].alias("operation_name"),
                                    F.date_format(tr["start_time"], TS_FMT).alias("start_time"),
                                    F.date_format(tr["end_time"], TS_FMT).alias("end_time"),
                                    tr["status"].alias("status"),
                                    F.parse_json(F.coalesce(tr["attributes"], F.lit("{}"))).alias("attributes")))
    return F.when(p["type"] == "log", log_json).when(p["type"] == "metric", metric_json).otherwise(trace_json)


def encode_events(events: DataFrame, out: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Event rows → one JSON text per event in ``out`` (plus ``tenant_id`` as key, and ``keep``)."""
    body = F.to_json(F.struct(
        F.col("id"), F.col("tenant_id"), F.col("source"), F.parse_json(_payload_json()).alias("payload"),
        F.date_format("timestamp", TS_FMT).alias("timestamp"), F.date_format("ingested_at", TS_FMT).alias("ingested_at"),
        F.col("labels")))
    return events.select(*keep, F.col("tenant_id").alias("key"), body.alias(out))


def _get(path: str, typ: str) -> Column:
    """A part of the payload, NULL where it is missing or of another type."""
    return F.try_variant_get(F.col("payload"), path, typ)


def _payload() -> Column:
    """The typed payload struct of a decoded ``payload`` variant."""
    g = _get
    pairs_b = F.from_json(F.to_json(g("$.value.buckets", "variant")), "array<array<double>>")
    pairs_q = F.from_json(F.to_json(g("$.value.quantiles", "variant")), "array<array<double>>")
    value = F.struct(g("$.value.kind", "string").alias("kind"), g("$.value.value", "double").alias("value"),
                     F.transform(pairs_b, lambda a: F.struct(F.get(a, 0).alias("le"), F.get(a, 1).cast("bigint").alias("count")))
                     .alias("buckets"),
                     F.transform(pairs_q, lambda a: F.struct(F.get(a, 0).alias("q"), F.get(a, 1).alias("v"))).alias("quantiles"),
                     g("$.value.sum", "double").alias("sum"), g("$.value.count", "bigint").alias("count"))
    typ = g("$.type", "string")
    log = F.struct(F.upper(g("$.level", "string")).alias("level"), g("$.message", "string").alias("message"),
                   g("$.trace_id", "string").alias("trace_id"), g("$.span_id", "string").alias("span_id"),
                   F.to_json(g("$.fields", "variant")).alias("fields"))
    metric = F.struct(g("$.name", "string").alias("name"), value.alias("value"), g("$.unit", "string").alias("unit"))
    trace = F.struct(g("$.trace_id", "string").alias("trace_id"), g("$.span_id", "string").alias("span_id"),
                     g("$.parent_span_id", "string").alias("parent_span_id"),
                     g("$.operation_name", "string").alias("operation_name"),
                     F.try_to_timestamp(g("$.start_time", "string")).alias("start_time"),
                     F.try_to_timestamp(g("$.end_time", "string")).alias("end_time"),
                     g("$.status", "string").alias("status"),
                     F.to_json(g("$.attributes", "variant")).alias("attributes"))
    return F.struct(typ.alias("type"), F.when(typ == "log", log).alias("log"),
                    F.when(typ == "metric", metric).alias("metric"), F.when(typ == "trace", trace).alias("trace"))


EVENT_COLUMNS = ("id", "tenant_id", "source", "payload", "timestamp", "ingested_at", "labels")


def _events(wire: DataFrame, keep=()) -> DataFrame:
    return wire.select(*keep, "id", "tenant_id", "source", _payload().alias("payload"), "timestamp", "ingested_at",
                       F.coalesce(F.col("labels"), F.create_map().cast("map<string,string>")).alias("labels"))


def decode_events(df: DataFrame, col: str = "value") -> DataFrame:
    """JSON text → event rows with the typed payload struct."""
    return _events(df.select(F.from_json(F.col(col), WIRE_DDL).alias("e")).select("e.*"))


def _fault(p: Column) -> Column:
    """Why an event can't be taken, or NULL: a required part that is missing or of another type."""
    typ, kind = p["type"], p["metric"]["value"]["kind"]
    lg, mt, tr, v = p["log"], p["metric"], p["trace"], p["metric"]["value"]
    plain = kind.isin("gauge", "counter")
    parts = F.when(kind == "histogram", v["buckets"].isNull()).otherwise(v["quantiles"].isNull())
    return (F.when(F.col("id").isNull(), "missing id").when(F.coalesce(F.col("tenant_id"), F.lit("")) == "", "missing tenant_id")
            .when(F.col("source.service").isNull() | F.col("source.instance").isNull() | F.col("source.environment").isNull(), "incomplete source")
            .when(F.col("timestamp").isNull() | F.col("ingested_at").isNull(), "bad timestamp")
            .when(typ.isNull() | ~typ.isin("log", "metric", "trace"), "unknown payload type")
            .when((typ == "log") & (lg["message"].isNull() | lg["level"].isNull() | ~lg["level"].isin(*LEVELS)), "bad log payload")
            .when((typ == "metric") & (mt["name"].isNull() | kind.isNull() | ~kind.isin("gauge", "counter", "histogram", "summary")), "bad metric payload")
            .when((typ == "metric") & F.when(plain, v["value"].isNull()).otherwise(v["sum"].isNull() | v["count"].isNull() | parts), "bad metric value")
            .when((typ == "trace") & (tr["trace_id"].isNull() | tr["span_id"].isNull() | tr["operation_name"].isNull()
                                      | tr["start_time"].isNull() | tr["end_time"].isNull() | tr["status"].isNull()), "bad trace payload"))


def decode_or_reject(df: DataFrame, col: str = "value", keep: tuple[str, ...] = ("segment", "position")) -> dict[str, DataFrame]:
    """``{"events": …, "rejects": …}`` of wire texts (string or binary column ``col``).

    A text that is no UTF-8, no JSON object, or an event with a required part missing goes to
    ``rejects`` as (``keep``, value, reason), its bytes unchanged, and stops nothing. ``keep``
    names columns that say where a text came from. Null texts are rejects too."""
    have = [c for c in keep if c in df.columns]
    raw = F.col(col).cast("binary")
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    wire = df.select(*have, raw.alias("raw"), text.alias("text")).withColumn("e", F.from_json("text", WIRE_DDL))
    known = _events(wire.select(*have, "raw", "text", "e.*"), [*have, "raw", "text"])
    reason = (F.when(F.col("raw").isNull(), "no text").when(F.col("text").isNull(), "not UTF-8")
              .when(F.coalesce(F.get_json_object("text", "$").substr(1, 1), F.lit("")) != "{", "not a JSON object").otherwise(_fault(F.col("payload"))))
    # one struct through a generator, so that the filters below hold no copy of the decoding
    told = known.select(F.inline(F.array(F.struct(*have, "raw", *EVENT_COLUMNS, reason.alias("reason")))))
    return {"events": told.where("reason is null").select(*EVENT_COLUMNS),
            "rejects": told.where("reason is not null").select(*have, F.col("raw").alias("value"), "reason")}


def write_events(events: DataFrame, path: str, fmt: str = "json", mode: str = "append") -> None:
    """A14 (batch sink): encoded events as JSON lines or parquet ``value`` rows."""
    enc = encode_events(events)
    if fmt == "json":
        enc.select("value").write.mode(mode).text(path)
    else:
        enc.write.mode(mode).format(fmt).save(path)


def read_events(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False,
                max_files_per_trigger: int | None = None, rejects: bool = False, **options):
    """A14 (source): events of a path, as a batch or a streaming DataFrame.

    ``fmt`` is ``signal_events`` (a folder of growing segments, see ``event_source``), ``json``
    (text files), a table format with a ``value`` column, or ``kafka`` with the usual
    ``kafka.bootstrap.servers``/``subscribe`` options. With ``rejects`` the result is
    ``decode_or_reject``'s pair instead of the events alone."""
    r = spark.readStream if stream else spark.read
    if stream and max_files_per_trigger and fmt not in ("kafka", event_source.FORMAT):
        options = {**options, "maxFilesPerTrigger": str(max_files_per_trigger)}
    if fmt == "json":
        raw = r.options(**options).text(path)
    elif fmt == event_source.FORMAT:
        event_source.register(spark)
        raw = r.format(fmt).options(**options).load(path)
        raw = raw if rejects else raw.withColumn("value", F.col("value").cast("string"))
    elif fmt == "kafka":
        raw = r.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"))
    else:
        raw = (r.schema("key STRING, value STRING") if stream else r).format(fmt).options(**options).load(path)
    return decode_or_reject(raw) if rejects else decode_events(raw, "value")
