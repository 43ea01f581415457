"""Spark DDL for the event model and the at-rest tables."""

METRIC_VALUE_DDL = ("STRUCT<kind: STRING, value: DOUBLE, "
                    "buckets: ARRAY<STRUCT<le: DOUBLE, count: BIGINT>>, "
                    "quantiles: ARRAY<STRUCT<q: DOUBLE, v: DOUBLE>>, sum: DOUBLE, count: BIGINT>")
LOG_PAYLOAD_DDL = "STRUCT<level: STRING, message: STRING, trace_id: STRING, span_id: STRING, fields: STRING>"
METRIC_PAYLOAD_DDL = f"STRUCT<name: STRING, value: {METRIC_VALUE_DDL}, unit: STRING>"
TRACE_PAYLOAD_DDL = ("STRUCT<trace_id: STRING, span_id: STRING, parent_span_id: STRING, "
                     "operation_name: STRING, start_time: TIMESTAMP, end_time: TIMESTAMP, "
                     "status: STRING, attributes: STRING>")
SOURCE_DDL = "STRUCT<service: STRING, instance: STRING, environment: STRING, k8s_context: STRING>"
PAYLOAD_DDL = (f"STRUCT<type: STRING, log: {LOG_PAYLOAD_DDL}, metric: {METRIC_PAYLOAD_DDL}, "
               f"trace: {TRACE_PAYLOAD_DDL}>")

EVENT_DDL = (f"id STRING, tenant_id STRING, source {SOURCE_DDL}, payload {PAYLOAD_DDL}, "
             "timestamp TIMESTAMP, ingested_at TIMESTAMP, labels MAP<STRING, STRING>")

LOG_ROW_DDL = ("tenant_id STRING, timestamp BIGINT, level STRING, message STRING, service STRING, "
               "instance STRING, environment STRING, trace_id STRING, labels STRING")
METRIC_ROW_DDL = ("tenant_id STRING, timestamp BIGINT, name STRING, value DOUBLE, service STRING, "
                  "environment STRING, labels STRING")
VECTOR_ROW_DDL = ("id STRING, vector ARRAY<FLOAT>, tenant_id STRING, service STRING, environment STRING, "
                  "level STRING, message STRING, timestamp BIGINT")
RULE_DDL = ("id STRING, tenant_id STRING, name STRING, description STRING, severity STRING, "
            "rule_type STRING, rule_config STRING, channels STRING, cooldown_secs INT, is_enabled BOOLEAN")
INCIDENT_DDL = ("id STRING, tenant_id STRING, alert_rule_id STRING, title STRING, description STRING, "
                "severity STRING, status STRING, context STRING, opened_at TIMESTAMP, "
                "acknowledged_at TIMESTAMP, resolved_at TIMESTAMP, acknowledged_by STRING, resolved_by STRING")
TENANT_DDL = ("id STRING, name STRING, slug STRING, plan STRING, ingest_rate_per_second INT, "
              "retention_days INT, max_users BIGINT, max_ws_connections BIGINT, is_active BOOLEAN")
USER_DDL = "id STRING, tenant_id STRING, email STRING, role STRING, is_active BOOLEAN"
