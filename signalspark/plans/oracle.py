"""DuckDB SQL that states each registered query independently of Spark.

The fixtures and operator semantics are re-expressed here in plain SQL over
the same parquet views, so the driver can compare row counts, schemas and
value hashes. Builders return SQL fragments; ``ORACLE`` maps query names to
complete statements.
"""

from __future__ import annotations

from ..constants import (EULER_GAMMA, IFOREST_CONTAMINATION, IFOREST_MAX_SAMPLES, IFOREST_TREES, INSUFFICIENT_HISTORY,
                         JSON_LEVEL_KEYS, JSON_MESSAGE_KEYS, LEVEL_PREFIX_WORDS,
                         LEVEL_SPELLINGS, LOGFMT_LEVEL_KEYS, LOGFMT_MESSAGE_KEYS,
                         MIN_HISTORY, SPAN_ID_KEYS, TRACE_ID_KEYS, WS_CHARS)
from ..operators.detect import POOL_SHARE
from ..operators.forest import HASH_DIGITS, LEFT, MODULUS, RIGHT, UNIT

WS = f"[{WS_CHARS}]"
PAIR_RE = WS + '*([^=]*)=(?:"([^"]*)"?|([^ ]*))'
PREFIX_RE = ("(?i)^" + WS + "*[\\[\\(<]?(" + "|".join(LEVEL_PREFIX_WORDS) + ")[\\]>):"
             + WS_CHARS + "-]*" + WS + "*")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+\\z')}, '', 'g')"


def level_of(x: str) -> str:
    u = f"upper({trim_ws(x)})"
    arms = " ".join(f"WHEN {u} IN ({', '.join(q(s) for s in sp)}) THEN {q(lv)}"
                    for lv, sp in LEVEL_SPELLINGS.items())
    return f"(CASE {arms} ELSE 'INFO' END)"


# ---------------------------------------------------------------- fixtures
EV = """ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         't' || CAST(user_id % 5 AS VARCHAR) AS tenant_id,
         ['checkout','auth','api','search'][CAST(user_id % 4 AS BIGINT) + 1] AS service,
         CASE WHEN event_id % 10 = 0 THEN 'staging' ELSE 'production' END AS environment,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'INFO'
                         WHEN 'click' THEN 'DEBUG' WHEN 'view' THEN 'TRACE' END AS src_level,
         event_type || ' k' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS src_message
  FROM events)"""

LL = """ll AS (
  SELECT event_id, ts, tenant_id, service, service || '-' || CAST(user_id % 3 AS VARCHAR) AS instance,
         environment, user_id, event_type, value, src_level, src_message,
         CASE event_id % 4
           WHEN 0 THEN '{"level":"' || lower(src_level) || '","message":"' || src_message || '","trace_id":"tr'
                       || CAST(event_id AS VARCHAR) || '","user":' || CAST(user_id AS VARCHAR) || '}'
           WHEN 1 THEN 'level=' || lower(src_level) || ' msg="' || src_message || '" user=' || CAST(user_id AS VARCHAR)
                       || ' span_id=sp' || CAST(event_id AS VARCHAR)
           WHEN 2 THEN '[' || src_level || '] ' || src_message
           ELSE src_message END AS raw
  FROM ev)"""

DOC_LINES = """dl AS (
  SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS request_id, 't' || CAST(doc_id % 5 AS VARCHAR) AS tenant_id,
         source AS service, lang AS instance, 'production' AS environment,
         CAST(unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS BIGINT) AS line_no,
         unnest(string_split(text, chr(10))) AS raw
  FROM documents)"""


def parse_ctes(src: str, out: str) -> str:
    """CTEs ``{out}_a .. {out}`` adding parsed columns to every row of ``src``."""
    pat = q(PAIR_RE)
    pre = q(PREFIX_RE)

    def jstr(k: str) -> str:
        path = q('$."' + k + '"')
        return f"(CASE WHEN json_type(line, {path}) = 'VARCHAR' THEN json_extract_string(line, {path}) END)"

    def first_key(keys) -> str:
        arms = " ".join(f"WHEN list_contains(dk, {q(k)}) THEN {q(k)}" for k in keys)
        return f"(CASE {arms} END)"

    def obj(keys_expr: str) -> str:
        return ("('{' || array_to_string(list_transform(list_sort(" + keys_expr + "), lambda k: to_json(k) || ':' || "
                "CAST(json_extract(line, '$.\"' || k || '\"') AS VARCHAR)), ',') || '}')")

    skip = ", ".join(q(k) for k in JSON_MESSAGE_KEYS + JSON_LEVEL_KEYS + TRACE_ID_KEYS + SPAN_ID_KEYS)
    j_message = "COALESCE(" + ", ".join(jstr(k) for k in JSON_MESSAGE_KEYS) + ", " + obj("json_keys(line)") + ")"
    j_level = "COALESCE(" + ", ".join(jstr(k) for k in JSON_LEVEL_KEYS) + ", 'INFO')"
    j_trace = (f"(CASE WHEN list_contains(json_keys(line), {q(TRACE_ID_KEYS[0])}) THEN {jstr(TRACE_ID_KEYS[0])} "
               f"ELSE {jstr(TRACE_ID_KEYS[1])} END)")
    j_span = (f"(CASE WHEN list_contains(json_keys(line), {q(SPAN_ID_KEYS[0])}) THEN {jstr(SPAN_ID_KEYS[0])} "
              f"ELSE {jstr(SPAN_ID_KEYS[1])} END)")
    j_fields = obj(f"list_filter(json_keys(line), lambda k: k NOT IN ({skip}))")
    l_fields = ("('{' || array_to_string(list_transform(list_sort(list_filter(list_transform(dk, lambda k, i: "
                "{'k': k, 'v': dv[i]}), lambda e: e.k IS DISTINCT FROM msg_key AND e.k IS DISTINCT FROM lvl_key "
                "AND e.k IS DISTINCT FROM trc_key AND e.k IS DISTINCT FROM spn_key)), "
                "lambda e: to_json(e.k) || ':' || to_json(e.v)), ',') || '}')")
    return f"""{out}_a AS (SELECT *, {trim_ws('raw')} AS line FROM {src}),
{out}_b AS (
  SELECT *,
    (CASE WHEN starts_with(line, '{{') AND json_valid(line) THEN json_type(line) = 'OBJECT' ELSE false END) AS is_json,
    list_transform(regexp_extract_all(line, {pat}, 1), lambda k: {trim_ws('k')}) AS lk,
    list_transform(regexp_extract_all(line, {pat}, 2), lambda x, i: coalesce(x, '')
                   || coalesce(regexp_extract_all(line, {pat}, 3)[i], '')) AS lv,
    regexp_extract(line, {pre}, 0) AS pfx, regexp_extract(line, {pre}, 1) AS pfx_lvl
  FROM {out}_a),
{out}_c AS (
  SELECT *, (NOT is_json AND contains(line, '=')) AS is_logfmt,
    list_filter(lk, lambda k, i: NOT list_contains(lk[i + 1:], k)) AS dk,
    list_filter(lv, lambda v, i: NOT list_contains(lk[i + 1:], lk[i])) AS dv
  FROM {out}_b),
{out}_d AS (
  SELECT *, {first_key(LOGFMT_MESSAGE_KEYS)} AS msg_key, {first_key(LOGFMT_LEVEL_KEYS)} AS lvl_key,
         {first_key(TRACE_ID_KEYS)} AS trc_key, {first_key(SPAN_ID_KEYS)} AS spn_key
  FROM {out}_c),
{out} AS (
  SELECT * EXCLUDE (line, is_json, is_logfmt, lk, lv, dk, dv, pfx, pfx_lvl, msg_key, lvl_key, trc_key, spn_key),
    CASE WHEN is_json THEN 'json' WHEN is_logfmt THEN 'logfmt' ELSE 'plain' END AS log_format,
    {level_of(f"CASE WHEN is_json THEN {j_level} WHEN is_logfmt THEN COALESCE(dv[list_position(dk, lvl_key)], 'INFO') WHEN length(pfx) > 0 THEN pfx_lvl ELSE 'INFO' END")} AS level,
    CASE WHEN is_json THEN {j_message} WHEN is_logfmt THEN COALESCE(dv[list_position(dk, msg_key)], line)
         ELSE substr(line, length(pfx) + 1) END AS message,
    CASE WHEN is_json THEN {j_trace} WHEN is_logfmt THEN dv[list_position(dk, trc_key)] END AS trace_id,
    CASE WHEN is_json THEN {j_span} WHEN is_logfmt THEN dv[list_position(dk, spn_key)] END AS span_id,
    CASE WHEN is_json THEN {j_fields} WHEN is_logfmt THEN {l_fields} ELSE '{{}}' END AS fields
  FROM {out}_d)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# log rows (B1) over the events fixture
LOGS = with_(EV, LL, parse_ctes("ll", "pl"), """logs AS (
  SELECT tenant_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS timestamp, level, message, service, instance,
         environment, COALESCE(trace_id, '') AS trace_id, '{}' AS labels
  FROM pl)""")

ORACLE: dict[str, str] = {}

ORACLE["a1_explode_log_envelopes"] = with_(EV, LL) + """
SELECT tenant_id || '/' || service || '/' || environment || '/' || CAST(event_id // 64 AS VARCHAR) AS request_id,
       tenant_id, service, '' AS instance, environment,
       CAST(row_number() OVER (PARTITION BY tenant_id, service, environment, event_id // 64
                               ORDER BY ts, event_id) - 1 AS BIGINT) AS line_no,
       raw
FROM ll"""

ORACLE["a2_parse_event_lines"] = with_(EV, LL, parse_ctes("ll", "pl")) + """
SELECT event_id, raw, log_format, level, message, trace_id, span_id, fields FROM pl"""

ORACLE["a2_parse_document_lines"] = with_(DOC_LINES, parse_ctes("dl", "pd")) + """
SELECT request_id, line_no, log_format, level, message, trace_id, span_id, fields FROM pd"""

ORACLE["b1_log_rows"] = LOGS + "SELECT * FROM logs"

ORACLE["c2_search_logs"] = LOGS + """
SELECT tenant_id, timestamp, level, message, service, trace_id FROM logs
WHERE tenant_id = 't1' AND timestamp >= 0 AND contains(lower(message), 'k1')
ORDER BY timestamp DESC, level, service, message, trace_id LIMIT 100"""

ORACLE["c2_search_logs_filtered"] = LOGS + """
SELECT tenant_id, timestamp, level, message, service, trace_id FROM logs
WHERE tenant_id = 't3' AND timestamp BETWEEN 1704499200 AND 1705449599 AND level = 'ERROR' AND service = 'api'
ORDER BY timestamp DESC, level, service, message, trace_id LIMIT 1000"""

ORACLE["c10_format_logs"] = LOGS + """
SELECT strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S') AS time_text,
       substr(level, 1, 4) AS level_text, service, message FROM logs"""

ORACLE["c11_min_level"] = LOGS + """
SELECT tenant_id, timestamp, level, service, message FROM logs WHERE level IN ('WARN', 'ERROR', 'FATAL')"""


# ---------------------------------------------------------------- metrics side
FLOAT_RE = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"

EXPO = """ex AS (
  SELECT tenant_id || '/' || service || '/' || CAST(event_id // 64 AS VARCHAR) AS request_id,
         tenant_id, service, min(ts) AS received_at,
         string_agg('# TYPE ' || event_type || ' gauge' || chr(10) || event_type || '{user="' || CAST(user_id AS VARCHAR)
                    || '",env="' || environment || '"} ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || 'e-2 '
                    || CAST(epoch_ms(ts) AS VARCHAR)
                    || CASE WHEN event_id % 7 = 0 THEN chr(10) || event_type || '_bad 1d' ELSE '' END,
                    chr(10) ORDER BY ts, event_id) AS exposition
  FROM ev GROUP BY ALL)"""


def sorted_json_obj(keys: str, vals: str) -> str:
    """JSON object text from parallel key/value lists, last duplicate wins, keys sorted."""
    return ("('{' || array_to_string(list_transform(list_sort(list_filter(list_transform(" + keys
            + ", lambda k, i: {'k': k, 'v': " + vals + "[i]}), lambda e, i: NOT list_contains(" + keys
            + "[i + 1:], e.k))), lambda e: to_json(e.k) || ':' || to_json(e.v)), ',') || '}')")


SAMPLES = """sl AS (
  SELECT request_id, tenant_id, service, received_at,
         CAST(unnest(generate_series(0, len(string_split(exposition, chr(10))) - 1)) AS BIGINT) AS sample_no,
         unnest(string_split(exposition, chr(10))) AS l
  FROM ex),
sm AS (SELECT *, """ + trim_ws("l") + """ AS line FROM sl),
sp AS (SELECT *, string_split(line, ' ') AS parts FROM sm WHERE line <> '' AND NOT starts_with(line, '#')),
sq AS (SELECT *, parts[1] AS nl, strpos(parts[1], '{') AS brace FROM sp
       WHERE len(parts) >= 2 AND regexp_matches(parts[2], """ + q(FLOAT_RE) + """)),
sr AS (SELECT *, CASE WHEN brace = 0 THEN nl ELSE substr(nl, 1, brace - 1) END AS name,
              list_filter(list_transform(string_split(substr(nl, brace + 1, length(nl) - 1 - brace), ','),
                                         lambda p: """ + trim_ws("p") + """), lambda p: contains(p, '=')) AS lp,
              TRY_CAST(parts[2] AS DOUBLE) AS value
       FROM sq WHERE brace = 0 OR brace < length(nl)),
samples AS (
  SELECT request_id, tenant_id, service, received_at, sample_no, name, value,
         CASE WHEN brace = 0 THEN '{}' ELSE """ + sorted_json_obj(
    "list_transform(lp, lambda p: " + trim_ws("substr(p, 1, strpos(p, '=') - 1)") + ")",
    "list_transform(lp, lambda p: trim(" + trim_ws("substr(p, strpos(p, '=') + 1)") + ", '\"'))") + """ END AS labels
  FROM sr)"""

METRICS = """metrics AS (
  SELECT tenant_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS timestamp, event_type AS name, value, service,
         environment, '{"user":"' || CAST(user_id AS VARCHAR) || '"}' AS labels
  FROM ev)"""

ORACLE["a7_parse_exposition"] = with_(EV, EXPO, SAMPLES) + """
SELECT request_id, sample_no, name, labels, value FROM samples"""

ORACLE["a8_prometheus_metric_rows"] = with_(EV, EXPO, SAMPLES) + """
SELECT tenant_id, CAST(epoch_us(received_at) // 1000000 AS BIGINT) AS timestamp, name, value, service,
       'production' AS environment, labels FROM samples"""

ORACLE["b2_metric_rows"] = with_(EV, METRICS) + "SELECT * FROM metrics"

ORACLE["c3_query_metrics"] = with_(EV, METRICS) + """
SELECT tenant_id, timestamp, name, value, service FROM metrics
WHERE tenant_id = 't2' AND name = 'purchase' AND timestamp BETWEEN 1704067200 AND 1705276799
ORDER BY timestamp DESC, name, service, value LIMIT 500"""

ORACLE["c4_latest_metrics"] = with_(EV, METRICS) + """
SELECT * FROM (
  SELECT tenant_id, name, value, service, timestamp,
         CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp DESC, name, service, value DESC) AS INTEGER) AS rank
  FROM metrics) WHERE rank <= 10"""

ORACLE["a9_event_ids"] = with_(EV) + """
SELECT event_id, tenant_id,
       substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id
FROM (SELECT event_id, tenant_id, sha256(concat_ws(chr(31), 'log', tenant_id, CAST(event_id AS VARCHAR))) AS h FROM ev)"""

ORACLE["a13_route_signals"] = with_(EV, EXPO, SAMPLES) + """
SELECT topic, tenant_id, CAST(count(*) AS BIGINT) AS events FROM (
  SELECT 'logs' AS topic, tenant_id FROM ev
  UNION ALL SELECT 'metrics' AS topic, tenant_id FROM samples)
GROUP BY ALL"""


# ---------------------------------------------------------------- sequential operators
from ..sources.metadata import LIMIT_OVERRIDES, RULES, TENANTS, USERS, sql_values  # noqa: E402

RULE_COLS = ["id", "tenant_id", "name", "description", "severity", "rule_type", "rule_config", "channels",
             "cooldown_secs", "is_enabled"]
RULES_CTE = f"rules AS (SELECT * FROM {sql_values(RULES, RULE_COLS)})"
TENANTS_CTE = ("tenants AS (SELECT * FROM " + sql_values(TENANTS, [
    "id", "name", "slug", "plan", "ingest_rate_per_second", "retention_days", "max_users", "max_ws_connections",
    "is_active"]) + ")")
USERS_CTE = f"users AS (SELECT * FROM {sql_values(USERS, ['id', 'tenant_id', 'email', 'role', 'is_active'])})"
OVERRIDES_CTE = f"overrides AS (SELECT * FROM {sql_values(LIMIT_OVERRIDES, ['tenant_id', 'lim'])})"


def with_rec(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def token_bucket(src: str, name: str) -> str:
    """Recursive token bucket over ``src(k, t, tie, cap, rate, cost, …)``."""
    y = "least(i.cap, p.s + (i.t - p.t) * i.rate)"
    return f"""{name}_in AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, tie) AS rn FROM {src}),
{name}(k, rn, t, s, admitted) AS (
  SELECT k, rn, t, CASE WHEN cap >= cost THEN cap - cost ELSE cap END, cap >= cost FROM {name}_in WHERE rn = 1
  UNION ALL
  SELECT i.k, i.rn, i.t, CASE WHEN {y} >= i.cost THEN {y} - i.cost ELSE {y} END, {y} >= i.cost
  FROM {name} p JOIN {name}_in i ON i.k = p.k AND i.rn = p.rn + 1)"""


REQ_A10 = """req AS (SELECT tenant_id AS k, epoch_us(ts) AS t, event_id AS tie, event_id, tenant_id,
                  CAST(4 AS BIGINT) * 7200000000 AS cap, CAST(4 AS BIGINT) AS rate, CAST(7200000000 AS BIGINT) AS cost
           FROM ev)"""

ORACLE["a10_admission"] = with_rec(EV, REQ_A10, token_bucket("req", "tb")) + """
SELECT i.event_id, i.tenant_id, p.admitted, CAST(p.s AS BIGINT) AS tokens_units
FROM tb p JOIN tb_in i ON i.k = p.k AND i.rn = p.rn"""

ORACLE["a11_admission_overrides"] = with_rec(EV, OVERRIDES_CTE, """req AS (
  SELECT e.tenant_id AS k, epoch_us(e.ts) AS t, e.event_id AS tie, e.event_id, e.tenant_id,
         CAST(COALESCE(o.lim, 4) AS BIGINT) * 3600000000 AS cap, CAST(COALESCE(o.lim, 4) AS BIGINT) AS rate,
         CAST(3600000000 AS BIGINT) AS cost
  FROM ev e LEFT JOIN overrides o ON e.tenant_id = o.tenant_id)""", token_bucket("req", "tb")) + """
SELECT i.event_id, i.tenant_id, p.admitted, CAST(p.s AS BIGINT) AS tokens_units
FROM tb p JOIN tb_in i ON i.k = p.k AND i.rn = p.rn"""

ORACLE["a12_ingest_summary"] = with_rec(EV, """env AS (
  SELECT tenant_id || '/' || service || '/' || environment || '/' || CAST(event_id // 64 AS VARCHAR) AS request_id,
         tenant_id, min(ts) AS received_at, count(*) AS n_lines
  FROM ev GROUP BY tenant_id, service, environment, event_id // 64)""", """req AS (
  SELECT tenant_id AS k, epoch_us(received_at) AS t, request_id AS tie, tenant_id, n_lines,
         CAST(4 AS BIGINT) * 7200000000 AS cap, CAST(4 AS BIGINT) AS rate, CAST(7200000000 AS BIGINT) AS cost
  FROM env)""", token_bucket("req", "tb")) + """
SELECT i.tenant_id, CAST(count(*) FILTER (WHERE p.admitted) AS BIGINT) AS accepted_requests,
       CAST(count(*) FILTER (WHERE NOT p.admitted) AS BIGINT) AS rejected_requests,
       CAST(COALESCE(sum(CASE WHEN p.admitted THEN i.n_lines ELSE 0 END), 0) AS BIGINT) AS accepted_lines
FROM tb p JOIN tb_in i ON i.k = p.k AND i.rn = p.rn GROUP BY i.tenant_id"""

AN = """an AS (
  SELECT event_id AS anomaly_id, tenant_id, event_type AS metric_name, least(1.0, value / 200.0) AS anomaly_score, ts,
         '{"anomaly_id":' || CAST(event_id AS VARCHAR) || ',"metric_name":"' || event_type || '","tenant_id":"'
         || tenant_id || '"}' AS context
  FROM ev)"""

MT = """mt AS (
  SELECT a.*, r.id AS rule_id, r.name AS rule_name, r.description AS rule_description, r.severity AS rule_severity,
         r.rule_type, r.rule_config, r.channels, r.cooldown_secs,
         'Anomaly detected: ' || r.name AS title,
         COALESCE(r.description, 'Metric: ' || COALESCE(a.metric_name, 'unknown')) AS description
  FROM an a JOIN rules r ON a.tenant_id = r.tenant_id
  WHERE r.is_enabled AND r.rule_type = 'ai_anomaly'
    AND COALESCE(a.anomaly_score, 0.0) >= COALESCE(
        CASE WHEN json_type(r.rule_config, '$.threshold') IN ('DOUBLE', 'UBIGINT', 'BIGINT', 'HUGEINT')
             THEN CAST(json_extract(r.rule_config, '$.threshold') AS DOUBLE) END, 0.8))"""

COOL = """cd_in AS (
  SELECT *, epoch_us(ts) AS t,
         CASE WHEN cooldown_secs < 0 THEN CAST(4611686018427387904 AS BIGINT)
              ELSE CAST(cooldown_secs AS BIGINT) * 1000000 END AS cdus,
         row_number() OVER (PARTITION BY rule_id ORDER BY epoch_us(ts), anomaly_id) AS rn
  FROM mt),
cd(rule_id, rn, last_t, stored, fired) AS (
  SELECT rule_id, rn, t, cdus, true FROM cd_in WHERE rn = 1
  UNION ALL
  SELECT i.rule_id, i.rn,
         CASE WHEN i.t - p.last_t >= p.stored THEN i.t ELSE p.last_t END,
         CASE WHEN i.t - p.last_t >= p.stored THEN i.cdus ELSE p.stored END,
         i.t - p.last_t >= p.stored
  FROM cd p JOIN cd_in i ON i.rule_id = p.rule_id AND i.rn = p.rn + 1),
alerts AS (SELECT i.*, p.fired FROM cd_in i JOIN cd p ON i.rule_id = p.rule_id AND i.rn = p.rn)"""

INCIDENTS = """inc AS (
  SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-'
         || substr(h, 21, 12) AS id, tenant_id, alert_rule_id, title, description, severity, status, context, opened_at
  FROM (SELECT sha256(concat_ws(chr(31), 'incident', rule_id, CAST(anomaly_id AS VARCHAR))) AS h, tenant_id,
               rule_id AS alert_rule_id, title, description, 'warning' AS severity, 'open' AS status, context,
               ts AS opened_at
        FROM alerts WHERE fired))"""

ALERT_BASE = with_rec(EV, AN, RULES_CTE, MT, COOL)

ORACLE["e1_match_rules"] = with_(EV, AN, RULES_CTE, MT) + """
SELECT anomaly_id, tenant_id, rule_id, metric_name, anomaly_score, title, description FROM mt"""

ORACLE["e3_cooldown"] = ALERT_BASE + """
SELECT anomaly_id, rule_id, CAST(epoch_us(ts) AS BIGINT) AS ts_us, fired FROM alerts"""

ORACLE["e5_open_incidents"] = with_rec(EV, AN, RULES_CTE, MT, COOL, INCIDENTS) + """
SELECT id, tenant_id, alert_rule_id, title, description, severity, status, context,
       CAST(epoch_us(opened_at) AS BIGINT) AS opened_at_us FROM inc"""

ORACLE["e6_open_unique"] = with_rec(EV, AN, RULES_CTE, MT, COOL, INCIDENTS) + """
SELECT id, tenant_id, alert_rule_id, CAST(epoch_us(opened_at) AS BIGINT) AS opened_at_us FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, alert_rule_id ORDER BY opened_at, id) AS rn FROM inc)
WHERE rn = 1"""

RESOLVED = """res AS (
  SELECT i.*, CASE WHEN i.alert_rule_id LIKE '%6' THEN 'resolved' ELSE i.status END AS status2,
         CASE WHEN i.alert_rule_id LIKE '%6' THEN i.opened_at + INTERVAL 2 HOUR END AS resolved_at,
         CASE WHEN i.alert_rule_id LIKE '%6' THEN 'u3' END AS resolved_by
  FROM inc i)"""

ORACLE["e7_resolve_incidents"] = with_rec(EV, AN, RULES_CTE, MT, COOL, INCIDENTS, RESOLVED) + """
SELECT id, tenant_id, status2 AS status, CAST(epoch_us(resolved_at) AS BIGINT) AS resolved_at_us, resolved_by
FROM res"""

ORACLE["c5_open_incidents"] = with_rec(EV, AN, RULES_CTE, MT, COOL, INCIDENTS, RESOLVED) + """
SELECT id, title, description, severity, status2 AS status, context, CAST(epoch_us(opened_at) AS BIGINT) AS opened_at_us
FROM res WHERE tenant_id = 't1' AND status2 <> 'resolved' ORDER BY opened_at DESC, id LIMIT 50"""

ORACLE["e8_acknowledge_incidents"] = with_rec(EV, AN, RULES_CTE, MT, COOL, INCIDENTS, RESOLVED) + """
SELECT id, tenant_id,
       CASE WHEN tenant_id IN ('t0', 't2') AND status2 = 'open' THEN 'acknowledged' ELSE status2 END AS status,
       CAST(epoch_us(CASE WHEN tenant_id IN ('t0', 't2') AND status2 = 'open' THEN opened_at + INTERVAL 10 MINUTE END)
            AS BIGINT) AS acknowledged_at_us,
       CASE WHEN tenant_id IN ('t0', 't2') AND status2 = 'open' THEN 'u0' END AS acknowledged_by
FROM res"""

CHANNELS = """chan AS (
  SELECT anomaly_id, tenant_id, rule_id, ts, title, description,
         CAST(unnest(generate_series(0, len(chs) - 1)) AS INTEGER) AS channel_no, unnest(chs) AS ch
  FROM (SELECT *, COALESCE(json_transform(channels, '[{"type":"VARCHAR","url":"VARCHAR","routing_key":"VARCHAR"}]'),
                           []) AS chs
        FROM alerts WHERE fired))"""

ORACLE["e9_notifications"] = ALERT_BASE.rstrip("\n") + ",\n" + CHANNELS + """
SELECT anomaly_id, tenant_id, rule_id, CAST(epoch_us(ts) AS BIGINT) AS ts_us, channel_no, ch.type AS channel_type,
       CASE WHEN ch.type = 'pagerduty' THEN 'https://events.pagerduty.com/v2/enqueue' ELSE ch.url END AS target,
       CASE ch.type
         WHEN 'slack' THEN '{"text":' || to_json('*' || title || '*' || chr(10) || description) || '}'
         WHEN 'pagerduty' THEN '{"event_action":"trigger","payload":{"severity":"critical","source":"signalspark-alerting","summary":'
                               || to_json(title) || '},"routing_key":' || to_json(ch.routing_key) || '}'
         WHEN 'webhook' THEN '{"description":' || to_json(description) || ',"timestamp":"'
                             || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","title":' || to_json(title) || '}'
       END AS payload
FROM chan WHERE ch.type IN ('slack', 'pagerduty', 'webhook')"""

ORACLE["e9_notification_rejects"] = ALERT_BASE.rstrip("\n") + ",\n" + CHANNELS + """
SELECT anomaly_id, tenant_id, rule_id, CAST(epoch_us(ts) AS BIGINT) AS ts_us, channel_no, ch.type AS channel_type,
       'unknown channel type' AS reason
FROM chan WHERE ch.type IS NULL OR ch.type NOT IN ('slack', 'pagerduty', 'webhook')"""

_CHANNEL_FIELDS = '[{"type":"VARCHAR","url":"VARCHAR","routing_key":"VARCHAR"}]'
_PAYLOAD = ORACLE["e9_notifications"][ORACLE["e9_notifications"].index("SELECT anomaly_id, tenant_id, rule_id, CAST(epoch_us(ts) AS BIGINT) AS ts_us, channel_no"):]

ORACLE["e9_unsendable"] = with_rec(EV, AN, """rules AS (SELECT * REPLACE (CASE tenant_id WHEN 't0' THEN 'oops'
    WHEN 't2' THEN '[{"type":"slack"},{"url":"https://example.com"},{"type":"webhook","url":"https://example.com/ok"}]' ELSE '{"type":"slack","url":"https://example.com"}' END AS channels)
  FROM (SELECT * FROM """ + sql_values(RULES, RULE_COLS) + """))""", MT, COOL) + """
SELECT tenant_id, rule_id, channel_no, channel_type, reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT tenant_id, rule_id, -1 AS channel_no, CAST(NULL AS VARCHAR) AS channel_type, 'channels are no list' AS reason FROM alerts WHERE fired AND tenant_id <> 't2'
  UNION ALL SELECT tenant_id, rule_id, c.no, c.type, c.reason FROM alerts, (VALUES (0, 'slack', 'missing address'), (1, NULL, 'unknown channel type'), (2, 'webhook', 'sent')) AS c(no, type, reason)
  WHERE fired AND tenant_id = 't2') GROUP BY ALL"""

ORACLE["e1_tenant_ids"] = with_(EV, AN, RULES_CTE, MT) + """,
u AS (SELECT a.anomaly_id, '00000000-0000-4000-8000-0000000000A' || substr(a.tenant_id, 2, 1) AS u FROM an a)
SELECT lower(u) AS tenant_id, rule_id AS what, CAST(count(*) AS BIGINT) AS n FROM mt JOIN u USING (anomaly_id) WHERE anomaly_id % 8 <= 4 GROUP BY ALL
UNION ALL SELECT CASE anomaly_id % 8 WHEN 5 THEN substr(u, 1, 35) WHEN 6 THEN '' END, CASE WHEN anomaly_id % 8 = 5 THEN 'invalid tenant_id' ELSE 'missing tenant_id' END, count(*)
FROM u WHERE anomaly_id % 8 > 4 GROUP BY ALL"""

ORACLE["e6_open_unique_existing"] = with_rec(EV, AN, RULES_CTE, MT, COOL, INCIDENTS) + """
SELECT id, tenant_id, alert_rule_id, CAST(epoch_us(opened_at) AS BIGINT) AS opened_at_us FROM inc
WHERE right(alert_rule_id, 1) NOT IN ('2', '6') QUALIFY row_number() OVER (PARTITION BY tenant_id, alert_rule_id ORDER BY opened_at, id) = 1"""

ORACLE["e10_threshold_rules"] = with_(EV, METRICS, RULES_CTE) + """
SELECT tenant_id, rule_id, name, window_start, CAST(count(*) AS BIGINT) AS samples FROM (
  SELECT m.tenant_id, r.id AS rule_id, m.name, m.value, json_extract_string(r.rule_config, '$.comparator') AS cmp,
         CAST(json_extract(r.rule_config, '$.threshold') AS DOUBLE) AS thr,
         CAST(floor(m.timestamp / CAST(json_extract(r.rule_config, '$.window_secs') AS BIGINT))
              * CAST(json_extract(r.rule_config, '$.window_secs') AS BIGINT) AS BIGINT) AS window_start
  FROM metrics m JOIN rules r ON m.tenant_id = r.tenant_id
   AND m.name = json_extract_string(r.rule_config, '$.metric')
  WHERE r.is_enabled AND r.rule_type = 'threshold')
GROUP BY tenant_id, rule_id, name, window_start, cmp, thr
HAVING (cmp = '>' AND avg(value) > thr) OR (cmp = '>=' AND avg(value) >= thr) OR (cmp = '<' AND avg(value) < thr)
    OR (cmp = '<=' AND avg(value) <= thr) OR (cmp = '==' AND avg(value) = thr) OR (cmp = '!=' AND avg(value) <> thr)"""


# ---------------------------------------------------------------- detection
def c_sql(n: str) -> str:
    return (f"(CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 "
            f"ELSE 2.0 * (ln({n} - 1.0) + 0.5772156649) - 2.0 * ({n} - 1.0) / {n} END)")


def series_ctes(seconds: int = 86400) -> str:
    return f"""ser AS (SELECT tenant_id, name, CAST(timestamp // {seconds} AS BIGINT) AS day, timestamp, value,
               row_number() OVER (PARTITION BY tenant_id, name, timestamp // {seconds}
                                  ORDER BY timestamp DESC, value DESC) AS rn
        FROM metrics),
cnt AS (SELECT tenant_id, name, day, count(*) AS n, max(timestamp) AS last_ts FROM ser GROUP BY ALL),
dv AS (SELECT tenant_id, name, day, value AS x, count(*) AS mult,
              row_number() OVER (PARTITION BY tenant_id, name, day ORDER BY value) AS k
       FROM ser GROUP BY tenant_id, name, day, value),
gaps AS (SELECT a.tenant_id, a.name, a.day, a.k AS j, a.x AS xj, b.x AS xj1
         FROM dv a JOIN dv b ON a.tenant_id = b.tenant_id AND a.name = b.name AND a.day = b.day AND b.k = a.k + 1),
dep AS (SELECT d.tenant_id, d.name, d.day, d.x,
               COALESCE(sum(CASE WHEN g.j >= d.k THEN (g.xj1 - g.xj) / (g.xj1 - d.x)
                                 ELSE (g.xj1 - g.xj) / (d.x - g.xj) END), 0.0) + {c_sql('CAST(d.mult AS DOUBLE)')} AS h
        FROM dv d LEFT JOIN gaps g ON d.tenant_id = g.tenant_id AND d.name = g.name AND d.day = g.day
        GROUP BY d.tenant_id, d.name, d.day, d.x, d.k, d.mult),
pts AS (SELECT s.tenant_id, s.name, s.day, s.rn, c.n, c.last_ts,
               -pow(2.0, -dep.h / {c_sql('CAST(least(c.n, 256) AS DOUBLE)')}) AS sc
        FROM ser s JOIN dep ON s.tenant_id = dep.tenant_id AND s.name = dep.name AND s.day = dep.day AND s.value = dep.x
        JOIN cnt c ON s.tenant_id = c.tenant_id AND s.name = c.name AND s.day = c.day),
off AS (SELECT tenant_id, name, day, quantile_cont(sc, 0.1) AS offset FROM pts GROUP BY ALL),
det AS (SELECT p.tenant_id, p.name, p.day, p.n, p.last_ts,
               CASE WHEN p.n < 5 THEN 0.0 ELSE 0.5 - (p.sc - o.offset) END AS anomaly_score,
               CASE WHEN p.n < 5 THEN false ELSE (p.sc - o.offset) < 0 END AS is_anomaly,
               CASE WHEN p.n < 5 THEN 'Insufficient history' END AS reason
        FROM pts p JOIN off o ON p.tenant_id = o.tenant_id AND p.name = o.name AND p.day = o.day WHERE p.rn = 1)"""


ORACLE["d1_recent_values"] = with_(EV, METRICS) + """
SELECT tenant_id, name, day, CAST(count(*) AS BIGINT) AS n_values, max(timestamp) AS last_ts,
       string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY timestamp, rn DESC) AS values_cents
FROM (SELECT tenant_id, name, CAST(timestamp // 86400 AS BIGINT) AS day, timestamp, value,
             row_number() OVER (PARTITION BY tenant_id, name, timestamp // 86400 ORDER BY timestamp DESC, value DESC) AS rn
      FROM metrics)
GROUP BY tenant_id, name, day"""

ORACLE["d2_short_history"] = with_(EV, METRICS, series_ctes(21600)) + """
SELECT tenant_id, name, day AS quarter_day, CAST(n AS BIGINT) AS n_values, round(anomaly_score, 6) AS anomaly_score,
       is_anomaly, reason
FROM det"""

ORACLE["d4_detect_expected"] = with_(EV, METRICS, series_ctes()) + """
SELECT tenant_id, name, day, CAST(n AS BIGINT) AS n_values, round(anomaly_score, 6) AS anomaly_score, is_anomaly, reason
FROM det"""

ORACLE["d1_recent_rows"] = with_(EV, METRICS) + """
SELECT tenant_id, name, timestamp, value, CAST(row_number() OVER (PARTITION BY tenant_id, name ORDER BY timestamp DESC, value DESC) AS INTEGER) AS rank
FROM metrics QUALIFY rank <= 20"""

ANOM_FROM_DET = """an AS (
  SELECT tenant_id || '/' || name || '/' || CAST(day AS VARCHAR) || '/' || CAST(last_ts AS VARCHAR) AS anomaly_id,
         tenant_id, name AS metric_name, anomaly_score, make_timestamp(last_ts * 1000000) AS ts
  FROM det WHERE is_anomaly)"""

ORACLE["d6_anomaly_events"] = with_(EV, METRICS, series_ctes(), ANOM_FROM_DET) + """
SELECT anomaly_id, tenant_id, metric_name, round(anomaly_score, 6) AS anomaly_score,
       CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM an"""

ORACLE["e11_notifications"] = with_rec(EV, METRICS, series_ctes(), ANOM_FROM_DET.replace("AS ts\n", "AS ts, '' AS context\n"), RULES_CTE, MT, COOL, CHANNELS) + "\n" + _PAYLOAD

ORACLE["e11_alert_flow"] = with_rec(EV, METRICS, series_ctes(), ANOM_FROM_DET.replace(
    "AS ts\n", "AS ts, '' AS context\n"), RULES_CTE, MT, COOL, INCIDENTS) + """
SELECT id, tenant_id, alert_rule_id, title, description, severity, status,
       CAST(epoch_us(opened_at) AS BIGINT) AS opened_at_us FROM inc"""


# ---------------------------------------------------------------- isolation forest
def forest_ctes(keys: str, src: str) -> list[str]:
    """Forests of all series of ``src`` and the score of each distinct value (``scored``)."""
    text = f"concat_ws(chr(31), {keys})"
    units = f"""CASE WHEN len(s) <= 1 THEN 0 WHEN len(s) = 2 THEN {UNIT}
      ELSE CAST(round({UNIT} * (2 * (ln(len(s) - 1) + {EULER_GAMMA!r}) - 2.0 * (len(s) - 1) / len(s))) AS BIGINT) END"""
    pool = IFOREST_TREES * IFOREST_MAX_SAMPLES
    return [f"""fr AS (SELECT *, {text} AS sk, count(*) OVER (PARTITION BY {keys}) AS n,
  CAST('0x' || substr(md5(concat_ws(chr(31), {text}, timestamp)), 1, {HASH_DIGITS}) AS BIGINT) AS h FROM {src} WHERE value IS NOT NULL)""",
            f"""pool AS (SELECT sk, value, row_number() OVER (PARTITION BY sk ORDER BY h, timestamp, value) - 1 AS r FROM fr
  WHERE n <= {POOL_SHARE * pool} OR h < {16.0**HASH_DIGITS * POOL_SHARE * pool!r} / n QUALIFY r < {pool})""",
            f"""drawn AS (SELECT sk, list(value ORDER BY r) AS vs, count(*) AS p, least(count(*), {IFOREST_MAX_SAMPLES}) AS psi,
  CAST(ceil(log2(greatest(least(count(*), {IFOREST_MAX_SAMPLES}), 2))) AS INT) AS deepest FROM pool GROUP BY sk)""",
            f"""node AS (SELECT sk, t, CAST('0x' || substr(md5(sk || '#' || t), 1, {HASH_DIGITS}) AS BIGINT) + 1 AS k, 0 AS d, deepest,
    list_sort([vs[(t * psi + i) % p + 1] FOR i IN range(psi)]) AS s, xs
  FROM drawn JOIN (SELECT sk, list(DISTINCT value) AS xs FROM fr GROUP BY sk) USING (sk), range({IFOREST_TREES}) AS trees(t)
  UNION ALL
  SELECT sk, t, k * CASE side WHEN 0 THEN {LEFT} ELSE {RIGHT} END % {MODULUS}, d + 1, deepest, [v FOR v IN s IF (v <= cut) = (side = 0)], [x FOR x IN xs IF (x <= cut) = (side = 0)]
  FROM (SELECT *, s[1] + (s[-1] - s[1]) * (CAST(k AS DOUBLE) / {MODULUS}) AS cut FROM node WHERE d < deepest AND len(s) > 1 AND s[1] < s[-1]), (VALUES (0), (1)) AS c(side))""",
            f"""paths AS (SELECT sk, x, sum(path) AS total FROM (SELECT sk, unnest(xs) AS x, CAST(d AS BIGINT) * {UNIT} + {units} AS path
  FROM node WHERE NOT (d < deepest AND len(s) > 1 AND s[1] < s[-1])) GROUP BY sk, x)""",
            f"""scored AS (SELECT paths.sk, x, CASE WHEN psi <= 1 THEN -1.0 ELSE -pow(2.0, -(total / CAST({UNIT} AS DOUBLE) / {IFOREST_TREES})
    / CASE WHEN psi = 2 THEN 1.0 ELSE 2 * (ln(psi - 1) + {EULER_GAMMA!r}) - 2.0 * (psi - 1) / psi END) END AS score
  FROM paths JOIN drawn USING (sk))"""]


def forest_verdicts(keys: str, src: str) -> list[str]:
    """Verdict on the newest value of every series: the shape of ``det``."""
    return [*forest_ctes(keys, src), f"""det AS (SELECT *, round(CASE WHEN n < {MIN_HISTORY} THEN 0.0 ELSE 0.5 - (last - cut) END, 6) AS anomaly_score, n >= {MIN_HISTORY} AND last < cut AS is_anomaly,
    CASE WHEN n < {MIN_HISTORY} THEN '{INSUFFICIENT_HISTORY}' END AS reason
  FROM (SELECT {keys}, any_value(n) AS n, max(timestamp) AS last_ts, quantile_cont(score, {IFOREST_CONTAMINATION}) AS cut, arg_max(score, (timestamp, value)) AS last
        FROM fr JOIN scored ON scored.sk = fr.sk AND x = value GROUP BY {keys}))"""]


DAILY = "daily AS (SELECT *, CAST(floor(timestamp / 86400) AS BIGINT) AS day FROM metrics)"
FOREST_DET = [DAILY, *forest_verdicts("tenant_id, name, day", "daily")]

ORACLE["d3_detect"] = with_rec(EV, METRICS, *FOREST_DET) + """
SELECT tenant_id, name, day, CAST(n AS BIGINT) AS n_values, anomaly_score, is_anomaly, reason FROM det"""

ORACLE["d5_score_isolation"] = with_rec(EV, METRICS, *forest_ctes("tenant_id, name", "metrics")) + f"""
SELECT tenant_id, name, timestamp, value, round(0.5 - (score - cut), 6) AS anomaly_score, score < cut AS is_anomaly
FROM (SELECT fr.*, score, quantile_cont(score, {IFOREST_CONTAMINATION}) OVER (PARTITION BY fr.sk) AS cut FROM fr JOIN scored ON scored.sk = fr.sk AND x = value)"""

ORACLE["e11_alert_flow_iforest"] = with_rec(EV, METRICS, *FOREST_DET, ANOM_FROM_DET.replace(
    "AS ts\n", "AS ts, '{\"anomaly_score\":' || CAST(anomaly_score AS VARCHAR) || ',\"is_anomaly\":true,\"metric_name\":\"' || name || '\",\"tenant_id\":\"' || tenant_id || '\"}' AS context\n"),
    RULES_CTE, MT, COOL, INCIDENTS) + """
SELECT id, tenant_id, alert_rule_id, title, context, CAST(epoch_us(opened_at) AS BIGINT) AS opened_at_us FROM inc"""


# ---------------------------------------------------------------- vectors
def hashed_vectors(src: str, key: str, text: str, name: str) -> str:
    """Signed MD5 feature hashing (dim 384) of whitespace tokens, as SQL."""
    return f"""{name}_tok AS (SELECT {key} AS vid, unnest(regexp_split_to_array(lower({text}), '[ \\t\\n\\r]+')) AS t
              FROM {src}),
{name}_slot AS (SELECT vid, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 384 AS b,
                       CASE WHEN substr(md5(t), 9, 1) < '8' THEN 1.0 ELSE -1.0 END AS sg
                FROM {name}_tok WHERE t <> ''),
{name}_agg AS (SELECT vid, b, sum(sg) AS c FROM {name}_slot GROUP BY vid, b),
{name} AS (SELECT a.vid, a.b, a.c, CASE WHEN sum(a.c * a.c) OVER (PARTITION BY a.vid) = 0 THEN 0.0
                   ELSE a.c / sqrt(sum(a.c * a.c) OVER (PARTITION BY a.vid)) END AS x FROM {name}_agg a)"""


ORACLE["b9_embed_documents"] = with_(hashed_vectors("documents", "doc_id", "text", "hv")) + """
SELECT d.doc_id, CAST(COALESCE(s.nnz, 0) AS BIGINT) AS nnz, COALESCE(s.checksum, 0.0) AS checksum
FROM documents d LEFT JOIN (
  SELECT vid, count(*) FILTER (WHERE x <> 0) AS nnz,
         round(sum(CAST(CAST(x AS FLOAT) AS DOUBLE) * (b + 1)), 4) AS checksum
  FROM hv GROUP BY vid) s ON d.doc_id = s.vid"""

LOG_POINTS = """pts AS (
  SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-'
         || substr(h, 21, 12) AS id, tenant_id, message, timestamp, event_id
  FROM (SELECT sha256(concat_ws(chr(31), 'log', tenant_id, CAST(event_id AS VARCHAR))) AS h, tenant_id, message,
               CAST(epoch_us(ts) // 1000000 AS BIGINT) AS timestamp, event_id FROM pl))"""

ORACLE["b8_vector_upsert"] = with_(EV, LL, parse_ctes("ll", "pl"), LOG_POINTS,
                                   """now AS (SELECT id, tenant_id, CASE WHEN event_id % 2 = 0 THEN message ELSE 'old ' || event_id END AS message,
  timestamp + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 60 END AS timestamp FROM pts WHERE event_id % 2 = 0 OR event_id % 3 = 0)""",
                                   hashed_vectors("now", "id", "message", "hv")) + """
SELECT n.id, n.tenant_id, n.message, n.timestamp, CAST(COALESCE(s.nnz, 0) AS BIGINT) AS nnz, COALESCE(s.checksum, 0.0) AS checksum
FROM now n LEFT JOIN (SELECT vid, count(*) FILTER (WHERE x <> 0) AS nnz, round(sum(CAST(CAST(x AS FLOAT) AS DOUBLE) * (b + 1)), 4) AS checksum
  FROM hv GROUP BY vid) s ON n.id = s.vid"""

ORACLE["c6_semantic_search"] = with_(EV, LL, parse_ctes("ll", "pl"), LOG_POINTS,
                                    hashed_vectors("pts", "id", "message", "hv"),
                                    hashed_vectors("(SELECT 'q' AS qid, 'error k1' AS qt)", "qid", "qt", "qv"),
                                    """fv AS (SELECT vid, b, CAST(CAST(x AS FLOAT) AS DOUBLE) AS f FROM hv),
fn AS (SELECT vid, b, CASE WHEN sum(f * f) OVER (PARTITION BY vid) = 0 THEN 0.0
                           ELSE f / sqrt(sum(f * f) OVER (PARTITION BY vid)) END AS u FROM fv)""") + """
SELECT p.id, p.tenant_id, p.message, p.timestamp, round(COALESCE(s.score, 0.0), 6) AS score
FROM pts p LEFT JOIN (SELECT fn.vid, sum(fn.u * qv.x) AS score FROM fn JOIN qv ON fn.b = qv.b GROUP BY fn.vid) s
  ON p.id = s.vid
WHERE p.tenant_id = 't1'
ORDER BY COALESCE(s.score, 0.0) DESC, p.id LIMIT 10"""

ORACLE["c7_semantic_search_batch"] = """
WITH ev AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS pos,
                   CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cen AS (SELECT label, pos, avg(x) AS c FROM ev GROUP BY label, pos),
cn AS (SELECT label, pos, c / sqrt(sum(c * c) OVER (PARTITION BY label)) AS q FROM cen),
vn AS (SELECT vec_id, label, pos, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS u FROM ev),
sc AS (SELECT 'label-' || CAST(cn.label AS VARCHAR) AS query_id, 't' || CAST(cn.label % 5 AS VARCHAR) AS tenant_id,
              CAST(vn.vec_id AS VARCHAR) AS id, sum(cn.q * vn.u) AS score
       FROM cn JOIN vn ON cn.pos = vn.pos AND cn.label % 5 = vn.label % 5
       GROUP BY cn.label, vn.vec_id)
SELECT query_id, tenant_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 5"""

ORACLE["c8_ivf_all_cells"] = ORACLE["c7_semantic_search_batch"].rsplit("SELECT query_id", 1)[0] + """
SELECT id, tenant_id, round(score, 6) AS score FROM sc WHERE query_id = 'label-0' ORDER BY sc.score DESC, id LIMIT 10"""


# ---------------------------------------------------------------- insight
SERVICES_CTE = ("svc AS (SELECT * FROM " + sql_values(
    [(f"t{t}", s) for t in range(5) for s in ["checkout", "auth", "api", "search", "billing"]],
    ["tenant_id", "service"]) + ")")

ORACLE["f1_explain"] = LOGS.rstrip("\n") + ",\n" + SERVICES_CTE + """,
rl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, service
                                                  ORDER BY timestamp DESC, level, message, trace_id) AS rn FROM logs)
       WHERE rn <= 100),
g AS (SELECT tenant_id, service, bool_or(contains(lower(message), 'timeout')) AS tmo,
             bool_or(contains(lower(message), 'error')) AS er, count(*) AS n FROM rl GROUP BY ALL)
SELECT s.tenant_id, s.service, CAST(COALESCE(g.n, 0) AS BIGINT) AS n_logs,
       'Root cause analysis for ' || s.service || ': ' ||
       CASE WHEN COALESCE(g.n, 0) = 0 THEN 'Insufficient context to provide automated root cause.'
            WHEN g.tmo THEN 'Dependency timeout detected in downstream service.'
            WHEN g.er THEN 'Application level exceptions found in recent logs.'
            ELSE 'Unusual log patterns detected; suggest manual audit.' END AS explanation
FROM svc s LEFT JOIN g ON s.tenant_id = g.tenant_id AND s.service = g.service"""

ORACLE["f2_explain_context"] = with_(EV, LL, parse_ctes("ll", "pl"), """logs AS (
  SELECT tenant_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS timestamp, level, message, service,
         COALESCE(trace_id, '') AS trace_id FROM pl)""", METRICS) + """,
rl AS (SELECT tenant_id, service, string_agg(message, ' | ' ORDER BY rn DESC) AS recent_logs FROM (
         SELECT *, row_number() OVER (PARTITION BY tenant_id, service ORDER BY timestamp DESC, level, message, trace_id) AS rn
         FROM logs) WHERE rn <= 5 GROUP BY ALL),
rm AS (SELECT tenant_id, service, string_agg(name || '=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ' | '
                                              ORDER BY rn DESC) AS metric_data FROM (
         SELECT *, row_number() OVER (PARTITION BY tenant_id, service ORDER BY timestamp DESC, name, value DESC) AS rn
         FROM metrics) WHERE rn <= 5 GROUP BY ALL)
SELECT COALESCE(rl.tenant_id, rm.tenant_id) AS tenant_id, COALESCE(rl.service, rm.service) AS service,
       COALESCE(recent_logs, '') AS recent_logs, COALESCE(metric_data, '') AS metric_data
FROM rl FULL JOIN rm ON rl.tenant_id = rm.tenant_id AND rl.service = rm.service"""

ORACLE["f3_error_rate"] = LOGS + """
SELECT tenant_id, CAST(floor(timestamp / 86400) * 86400 AS BIGINT) AS bucket_start, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE level IN ('ERROR', 'FATAL')) AS BIGINT) AS errors,
       CAST(count(*) FILTER (WHERE level IN ('ERROR', 'FATAL')) AS DOUBLE) / count(*) AS error_rate
FROM logs GROUP BY ALL"""

ORACLE["f4_p99"] = with_(EV, METRICS) + """
SELECT tenant_id, bucket_start, list_sort(vals)[CAST(greatest(1, ceil(0.99 * len(vals))) AS BIGINT)] AS p99,
       CAST(len(vals) AS BIGINT) AS samples
FROM (SELECT tenant_id, CAST(floor(timestamp / 86400) * 86400 AS BIGINT) AS bucket_start, list(value) AS vals
      FROM metrics WHERE name = 'purchase' GROUP BY ALL)"""

ORACLE["f5_throughput"] = LOGS + """
SELECT tenant_id, CAST(floor(timestamp / 3600) * 3600 AS BIGINT) AS bucket_start, CAST(count(*) AS BIGINT) AS events,
       CAST(count(*) AS DOUBLE) / 3600.0 AS events_per_sec
FROM logs GROUP BY ALL"""

ORACLE["f6_gauge_card"] = with_(EV, METRICS) + """
SELECT tenant_id, arg_max(value, (timestamp, value)) AS latest_value, max(timestamp) AS latest_ts,
       CAST(count(*) AS BIGINT) AS samples,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS mean_value
FROM metrics WHERE name = 'view' GROUP BY tenant_id"""

ORACLE["f7_pct_change"] = LOGS + """
SELECT tenant_id, bucket_start, events, prev_value,
       CASE WHEN prev_value <> 0 THEN CAST(events - prev_value AS DOUBLE) * 100.0 / prev_value END AS pct_change
FROM (SELECT tenant_id, bucket_start, events, lag(events) OVER (PARTITION BY tenant_id ORDER BY bucket_start) AS prev_value
      FROM (SELECT tenant_id, CAST(floor(timestamp / 86400) * 86400 AS BIGINT) AS bucket_start,
                   CAST(count(*) AS BIGINT) AS events FROM logs GROUP BY ALL))"""

ORACLE["f8_traffic"] = with_(EV) + """
SELECT tenant_id, service, CAST(floor(epoch_us(ts) / 3600000000) * 3600 AS BIGINT) AS bucket_start,
       CAST(count(*) AS BIGINT) AS requests
FROM ev GROUP BY ALL"""


# ---------------------------------------------------------------- storage, metadata, wire format
ORACLE["a15_event_roundtrip"] = LOGS + "SELECT * FROM logs"
ORACLE["a15_metric_roundtrip"] = with_(EV, METRICS) + "SELECT * FROM metrics"

ORACLE["b5_partitioned_logs"] = LOGS + """
SELECT CAST(strftime(make_timestamp(timestamp * 1000000), '%Y%m') AS INTEGER) AS yyyymm, tenant_id, timestamp, level,
       message FROM logs"""

ORACLE["b6_retention"] = LOGS + """
SELECT tenant_id, timestamp, level, message FROM logs WHERE timestamp >= 1707523200 - 30 * 86400"""

ORACLE["b7_plan_retention"] = LOGS.rstrip("\n") + ",\n" + TENANTS_CTE + """
SELECT l.tenant_id, l.timestamp, l.level, l.message FROM logs l LEFT JOIN tenants t ON l.tenant_id = t.id
WHERE l.timestamp >= 1706659200 - COALESCE(t.retention_days, 30) * 86400"""

ORACLE["b7_plan_days"] = LOGS.rstrip("\n") + ",\n" + TENANTS_CTE + """
SELECT tenant_id, CAST(count(*) AS BIGINT) AS n, min(timestamp) AS oldest FROM (
  SELECT l.tenant_id, l.timestamp, CASE WHEN t.id = 't2' THEN 12 WHEN t.id = 't4' THEN 30 WHEN t.plan = 'free' THEN 7 WHEN t.plan = 'pro' THEN 30 WHEN t.plan = 'enterprise' THEN 365 ELSE 30 END AS days
  FROM logs l LEFT JOIN tenants t ON l.tenant_id = t.id) WHERE timestamp >= 1707004800 - days * 86400 GROUP BY tenant_id"""

ORACLE["b10_purge_tables"] = with_rec(EV, AN, RULES_CTE, MT, COOL, INCIDENTS, TENANTS_CTE, USERS_CTE) + """
SELECT 'tenants' AS table_name, id AS tenant_id, id AS row_id FROM tenants WHERE id NOT IN ('t0', 't4')
UNION ALL SELECT 'users', tenant_id, id FROM users WHERE tenant_id NOT IN ('t0', 't4')
UNION ALL SELECT 'alert_rules', tenant_id, id FROM rules WHERE tenant_id NOT IN ('t0', 't4')
UNION ALL SELECT 'incidents', tenant_id, id FROM inc WHERE tenant_id NOT IN ('t0', 't4')"""

ORACLE["c9_capped_limit"] = LOGS + """
SELECT timestamp, level, service, message FROM logs WHERE tenant_id = 't1' ORDER BY timestamp DESC, level, message, trace_id LIMIT 1000"""

KINDS = """sg AS (SELECT *, ['log', 'metric', 'metric', 'metric', 'metric', 'trace'][event_id % 6 + 1] AS payload_type,
    [src_level, 'gauge', 'counter', 'histogram', 'summary', CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END][event_id % 6 + 1] AS kind,
    CASE event_id % 6 WHEN 1 THEN CAST(value AS DOUBLE) WHEN 2 THEN CAST(user_id AS DOUBLE) WHEN 3 THEN value * 2 WHEN 4 THEN value * 2 END AS metric_value FROM ev)"""

ORACLE["a13_signals"] = with_(EV, KINDS) + """
SELECT topic, tenant_id, CAST(count(*) AS BIGINT) AS signals FROM (SELECT CASE payload_type WHEN 'log' THEN 'logs' WHEN 'metric' THEN 'metrics' ELSE 'traces' END AS topic, tenant_id FROM sg
  UNION ALL SELECT 'anomalies', tenant_id FROM ev) GROUP BY ALL"""

ORACLE["b2_metric_kinds"] = with_(EV, KINDS) + """
SELECT tenant_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS timestamp, event_type AS name, metric_value AS value, service, environment, '{"user":"' || user_id || '"}' AS labels
FROM sg WHERE payload_type = 'metric'"""

ORACLE["b3_trace_rows"] = with_(EV, KINDS) + """
SELECT tenant_id, 'tr' || event_id AS trace_id, 'sp' || event_id AS span_id, '' AS parent_span_id, event_type AS operation_name, CAST(epoch_us(ts) AS BIGINT) AS start_us,
  CAST(1000000 AS BIGINT) AS duration_us, kind AS status, service, environment, '{"user":"' || user_id || '"}' AS labels FROM sg WHERE payload_type = 'trace'"""

ORACLE["a14_event_source"] = with_(EV, KINDS) + """
SELECT 'ev' || event_id AS id, tenant_id, payload_type, kind, CASE payload_type WHEN 'log' THEN src_message ELSE event_type END AS name, metric_value AS value,
  CAST(CASE kind WHEN 'histogram' THEN 2 WHEN 'summary' THEN 1 ELSE 0 END AS BIGINT) AS parts, CAST(epoch_us(ts) AS BIGINT) AS ts_us, '' AS reason FROM sg
UNION ALL SELECT NULL, NULL, NULL, NULL, CASE WHEN event_id % 100 = 0 THEN '{"id": oops ' || event_id ELSE '{"id":"x","n":' || event_id || '}' END, NULL, 0, 0,
  CASE WHEN event_id % 100 = 0 THEN 'not a JSON object' ELSE 'missing tenant_id' END FROM ev WHERE event_id % 50 = 0"""

ORACLE["b10_purge_tenant"] = with_rec(EV, AN, RULES_CTE, MT, COOL, INCIDENTS, RESOLVED) + """
SELECT id, tenant_id, alert_rule_id, status2 AS status,
       CASE WHEN tenant_id = 't2' AND status2 = 'open' THEN NULL END AS acknowledged_by
FROM res WHERE tenant_id <> 't0'"""

ORACLE["b11_audit_unique"] = LOGS + """
SELECT tenant_id, message, CAST(count(*) AS BIGINT) AS count FROM logs GROUP BY tenant_id, message HAVING count(*) > 1"""

ORACLE["a16_insert_ignore"] = with_(EV, TENANTS_CTE) + """
SELECT id, name, plan, ingest_rate_per_second FROM tenants WHERE id IN ('t0', 't1')
UNION ALL
SELECT tenant_id AS id, 'tenant ' || tenant_id AS name, 'free' AS plan, 100 AS ingest_rate_per_second
FROM (SELECT DISTINCT tenant_id FROM ev) WHERE tenant_id NOT IN ('t0', 't1')"""
