"""Small relational metadata (tenants, alert rules, limit overrides).

These are the inputs a deployment keeps in its metadata database; here they
are inline rows, rendered both as Spark DataFrames and as SQL ``VALUES`` for
the oracle, so both sides join the same metadata to the data-derived streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import RULE_DDL, TENANT_DDL, USER_DDL

TENANTS = [
    ("t0", "Harbor", "harbor", "enterprise", 20000, 45, 60, 80, True),
    ("t1", "Acme", "acme", "free", 100, 7, 3, 5, True),
    ("t2", "Globex", "globex", "pro", 5000, 30, 25, 50, True),
    ("t3", "Initech", "initech", "free", 100, 7, 3, 5, False),
    ("t4", "Umbrella", "umbrella", "pro", 5000, 30, 25, 50, True),
]

USERS = [
    ("u0", "t0", "admin@harbor.example", "admin", True),
    ("u1", "t1", "ops@acme.example", "member", True),
    ("u2", "t2", "viewer@globex.example", "viewer", True),
    ("u3", "t2", "ops@globex.example", "member", False),
    ("u4", "t4", "admin@umbrella.example", "admin", True),
]

_R = "00000000-0000-4000-8000-00000000000"
RULES = [
    (_R + "1", "t0", "Out of band", "score far outside the usual band", "warning",
     "ai_anomaly", '{"threshold": 0.8}', '[{"type": "webhook", "url": "https://hooks.example.com/w0"}]', 420, True),
    (_R + "2", "t0", "Any anomaly", None, "critical", "ai_anomaly", "{}",
     '[{"type":"slack","url":"https://hooks.example.com/s0"},{"type":"pagerduty","routing_key":"rk-0"}]', 3600, True),
    (_R + "3", "t1", "String threshold", "threshold given as text", "info", "ai_anomaly", '{"threshold":"0.9"}',
     "[]", 600, True),
    (_R + "4", "t1", "Disabled rule", None, "warning", "ai_anomaly", '{"threshold":0.1}',
     '[{"type":"webhook","url":"https://example.com/w1"}]', 300, False),
    (_R + "5", "t2", "Purchase volume", None, "warning", "threshold",
     '{"metric":"purchase","comparator":">","threshold":120,"window_secs":86400}',
     '[{"type":"slack","url":"https://hooks.example.com/s2"}]', 900, True),
    (_R + "6", "t2", "Low bar", "sensitive rule", "critical", "ai_anomaly", '{"threshold":0.5}',
     '[{"type":"slack","url":"https://hooks.example.com/s3"},{"type":"webhook","url":"https://example.com/w2"},'
     '{"type":"pagerduty","routing_key":"rk-2"}]', 7200, True),
    (_R + "7", "t3", "Odd channel", None, "warning", "ai_anomaly", '{"threshold":0.95}',
     '[{"type":"email","to":"ops@example.com"},{"type":"webhook","url":"https://example.com/w3"}]', 1800, True),
    (_R + "8", "t4", "Zero cooldown", None, "info", "ai_anomaly", '{"threshold":0.99}',
     '[{"type":"pagerduty","routing_key":"rk-4"}]', 0, True),
    (_R + "9", "t4", "Few errors", None, "warning", "threshold",
     '{"metric":"error","comparator":"<","threshold":30,"window_secs":21600}', "[]", 300, True),
]

# per-tenant admission overrides (requests per period); t2 keeps the default
LIMIT_OVERRIDES = [("t0", 6), ("t1", 2), ("t3", 3), ("t4", 1)]


def tenants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TENANTS, TENANT_DDL)


def users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(USERS, USER_DDL)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_DDL)


def limit_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIMIT_OVERRIDES, "tenant_id STRING, ingest_rate_per_second INT")


def sql_values(rows, names: list[str]) -> str:
    """``(VALUES …) t(names)`` text for the SQL oracle."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(names)})"
