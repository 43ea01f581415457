"""Fixed values that must equal the reference behaviour for identical results.

These are stated plainly, in their natural order, and kept together here.
"""

# --- Fixed values: log levels, ordered from least to most severe. ---
LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]

# --- Fixed values: accepted level spellings (case-insensitive, trimmed). ---
LEVEL_SPELLINGS = {
    "TRACE": ["TRACE", "TRC"],
    "DEBUG": ["DEBUG", "DBG"],
    "INFO": ["INFO", "INF", "INFORMATION"],
    "WARN": ["WARN", "WARNING", "WRN"],
    "ERROR": ["ERROR", "ERR", "ERRO"],
    "FATAL": ["FATAL", "CRIT", "CRITICAL", "PANIC"],
}
DEFAULT_LEVEL = "INFO"

# --- Fixed values: plain-text level prefix alternatives, in match order. ---
LEVEL_PREFIX_WORDS = [
    "TRACE", "TRC", "DEBUG", "DBG", "INFO", "INF", "INFORMATION",
    "WARN", "WARNING", "WRN", "ERROR", "ERR", "ERRO",
    "FATAL", "CRITICAL", "CRIT", "PANIC",
]

# --- Fixed values: JSON log keys, in lookup order. ---
JSON_MESSAGE_KEYS = ["message", "msg", "log", "text", "body"]
JSON_LEVEL_KEYS = ["level", "severity", "lvl", "loglevel"]
TRACE_ID_KEYS = ["trace_id", "traceId"]
SPAN_ID_KEYS = ["span_id", "spanId"]

# --- Fixed values: logfmt keys, in lookup order. ---
LOGFMT_MESSAGE_KEYS = ["message", "msg", "log"]
LOGFMT_LEVEL_KEYS = ["level", "severity"]

# --- Fixed values: Unicode White_Space code points (what a Rust-style trim strips). ---
WS_CHARS = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# --- Fixed values: ingest admission and plans. ---
DEFAULT_ADMISSION_LIMIT = 1000  # requests per second per tenant
# plan -> (ingest_rate_per_second, retention_days, max_users, max_ws_connections)
PLAN_LIMITS = {
    "free": (100, 7, 3, 5),
    "pro": (5000, 30, 25, 50),
    "enterprise": (100000, 365, 4294967295, 4294967295),
}
DEFAULT_ENVIRONMENT = "production"
DEFAULT_INSTANCE = ""

# --- Fixed values: storage. ---
RETENTION_DAYS = 30
FLUSH_ROWS = 1000
FLUSH_SECONDS = 5

# --- Fixed values: query limits (default, cap). ---
LOG_LIMIT = (100, 1000)
METRIC_LIMIT = (500, 5000)
SEARCH_LIMIT = (10, 100)
INCIDENT_LIMIT = 50
LIVE_METRIC_ROWS = 10

# --- Fixed values: anomaly detection. ---
MIN_HISTORY = 5
IFOREST_TREES = 100
IFOREST_MAX_SAMPLES = 256
IFOREST_CONTAMINATION = 0.1
INSUFFICIENT_HISTORY = "Insufficient history"
EULER_GAMMA = 0.5772156649

# --- Fixed values: alerting. ---
DEFAULT_RULE_THRESHOLD = 0.8
DEFAULT_ANOMALY_SCORE = 0.0
DEFAULT_COOLDOWN_SECS = 300
DEFAULT_INCIDENT_SEVERITY = "warning"
ALERT_TITLE_FORMAT = "Anomaly detected: %s"
ALERT_FALLBACK_DESCRIPTION = "Metric: %s"
UNKNOWN_METRIC = "unknown"
PAGERDUTY_SOURCE = "signalspark-alerting"  # our own source name (a parameter)
PAGERDUTY_SEVERITY = "critical"
PAGERDUTY_ACTION = "trigger"
INCIDENT_STATUSES = ["open", "acknowledged", "resolved"]

# --- Fixed values: rule-based root cause sentences. ---
EXPLAIN_PREFIX = "Root cause analysis for %s: "
EXPLAIN_TIMEOUT = "Dependency timeout detected in downstream service."
EXPLAIN_ERROR = "Application level exceptions found in recent logs."
EXPLAIN_UNUSUAL = "Unusual log patterns detected; suggest manual audit."
EXPLAIN_NO_CONTEXT = "Insufficient context to provide automated root cause."
