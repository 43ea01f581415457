"""Rule matching, cooldown, incidents, notification payloads.

Rules and tenants are metadata tables joined to the anomaly stream; the
anomaly side is never collected. The rule side is broadcast only behind a
size check (``broadcast_if_small``); otherwise the planner/AQE choose.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import (ALERT_FALLBACK_DESCRIPTION, ALERT_TITLE_FORMAT, DEFAULT_ANOMALY_SCORE,
                         DEFAULT_INCIDENT_SEVERITY, DEFAULT_RULE_THRESHOLD, PAGERDUTY_ACTION,
                         PAGERDUTY_SEVERITY, PAGERDUTY_SOURCE, UNKNOWN_METRIC)
from ..plans.joins import broadcast_if_small
from ..plans.ordered_scan import Kernel, ordered_scan
from .events import stable_uuid

_HYPHENATED = r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
#: The accepted texts of a UUID: hyphenated, in braces, as a URN, or 32 digits.
UUID_RE = r"^(" + _HYPHENATED + r"|\{" + _HYPHENATED + r"\}|urn:uuid:" + _HYPHENATED + r"|[0-9a-fA-F]{32})$"
CHANNELS_DDL = "array<struct<type:string,url:string,routing_key:string>>"
NEVER_US = 2**62  # a negative cooldown, cast to unsigned in the reference, never expires


def canonical_uuid(c: Column) -> Column:
    """The hyphenated lower-case text of a UUID in any accepted form; NULL for any other text."""
    x = F.lower(F.regexp_replace(F.regexp_replace(c, "^urn:uuid:", ""), "[-{}]", ""))
    told = F.concat_ws("-", F.substring(x, 1, 8), F.substring(x, 9, 4), F.substring(x, 13, 4), F.substring(x, 17, 4), F.substring(x, 21, 12))
    return F.when(c.rlike(UUID_RE), told)


def rule_threshold(rule_config: Column) -> Column:
    """``threshold`` if it is a JSON number, else 0.8 (a string "0.9" is not)."""
    t = F.from_json(rule_config, "threshold double", {"allowNumericLeadingZeros": "false", "allowNonNumericNumbers": "false"})["threshold"]
    number = ~F.isnan(t) & (F.abs(t) < float("inf"))  # texts such as "NaN" are no numbers
    return F.when(number, t).otherwise(F.lit(DEFAULT_RULE_THRESHOLD))


def match_rules(anomalies: DataFrame, rules: DataFrame, validate_uuid: bool = False) -> dict[str, DataFrame]:
    """E1+E2+E4: anomalies ⨝ enabled rules of the same tenant that fire on score.

    Returns ``{"matches": …, "rejects": …}``; an anomaly without a (valid)
    tenant id goes to ``rejects`` instead of failing the batch. ``validate_uuid`` asks for a
    UUID; matches then bear its hyphenated lower-case form, which the rules must use.
    """
    tid = F.col("tenant_id")
    ok = tid.isNotNull() & (tid != "")
    if validate_uuid:
        ok = ok & canonical_uuid(tid).isNotNull()
    rejects = anomalies.filter(~F.coalesce(ok, F.lit(False))).withColumn(
        "reason", F.when(tid.isNull() | (tid == ""), "missing tenant_id").otherwise("invalid tenant_id"))
    good = anomalies.filter(F.coalesce(ok, F.lit(False)))
    if validate_uuid:
        good = good.withColumn("tenant_id", canonical_uuid(tid))
    r = rules.filter(F.col("is_enabled")).select(
        "tenant_id", F.col("id").alias("rule_id"), F.col("name").alias("rule_name"),
        F.col("description").alias("rule_description"), F.col("severity").alias("rule_severity"),
        "rule_type", "rule_config", "channels", "cooldown_secs")
    m = good.join(broadcast_if_small(r), "tenant_id", "inner")
    score = F.coalesce(F.col("anomaly_score"), F.lit(DEFAULT_ANOMALY_SCORE))
    m = m.filter((F.col("rule_type") == "ai_anomaly") & (score >= rule_threshold(F.col("rule_config"))))
    metric = F.coalesce(F.col("metric_name"), F.lit(UNKNOWN_METRIC))
    m = m.withColumn("title", F.format_string(ALERT_TITLE_FORMAT, F.col("rule_name"))) \
         .withColumn("description", F.coalesce(F.col("rule_description"),
                                                 F.format_string(ALERT_FALLBACK_DESCRIPTION, metric)))
    return {"matches": m, "rejects": rejects}


class CooldownKernel(Kernel):
    """Fire iff ``t − last_fired ≥ stored cooldown``; store this row's cooldown on fire."""

    out_ddl = "fired BOOLEAN"

    def fold(self, rows, entry):
        t = rows["_t"].to_numpy(dtype=np.int64)
        cd = rows["_cd"].to_numpy(dtype=np.int64)
        fired = np.zeros(len(t), dtype=bool)
        if entry is None or entry["exit"] is None:
            last, c = None, None
        else:
            last, c = entry["exit"]
        for i in range(len(t)):
            if last is None or int(t[i]) - last >= c:
                fired[i] = True
                last, c = int(t[i]), int(cd[i])
        return {"fired": fired}, (None if last is None else [last, c])

    def transfer(self, rows):
        """Exit state as a function of the first firing index: runs of equal
        exits, each with the largest timestamp it covers."""
        t = rows["_t"].to_numpy(dtype=np.int64)
        cd = rows["_cd"].to_numpy(dtype=np.int64)
        n = len(t)
        nxt = np.searchsorted(t, t + cd, side="left")
        nxt = np.maximum(nxt, np.arange(1, n + 1))
        ex_t = np.empty(n, dtype=np.int64)
        ex_c = np.empty(n, dtype=np.int64)
        for j in range(n - 1, -1, -1):
            k = nxt[j]
            if k < n:
                ex_t[j], ex_c[j] = ex_t[k], ex_c[k]
            else:
                ex_t[j], ex_c[j] = t[j], cd[j]
        runs = []
        for j in range(n):
            e = (int(ex_t[j]), int(ex_c[j]))
            if runs and runs[-1][1] == e[0] and runs[-1][2] == e[1]:
                runs[-1][0] = int(t[j])
            else:
                runs.append([int(t[j]), e[0], e[1]])
        return {"runs": runs}

    def apply(self, fn, prev_exit, prev_t, first_t):
        runs = fn["runs"]
        if prev_exit is None:
            return [runs[0][1], runs[0][2]]
        last, c = prev_exit
        due = last + c
        for tmax, et, ec in runs:  # first run reaching the due time
            if tmax >= due:
                return [et, ec]
        return prev_exit


STATE_DDL = "rule_id STRING, last_us BIGINT, cooldown_us BIGINT"


def _cooldown_us(cooldown_col: str) -> Column:
    cd = F.col(cooldown_col).cast("bigint")
    return F.when(cd < 0, F.lit(NEVER_US)).otherwise(cd * 1_000_000)


def apply_cooldown(matches: DataFrame, key: str = "rule_id", ts: str = "ts", id_col: str = "anomaly_id",
                   cooldown_col: str = "cooldown_secs", num_partitions: int | None = None, state: DataFrame | None = None) -> DataFrame:
    """Add ``fired`` — per rule, suppress while inside the stored cooldown.

    ``state`` (see ``cooldown_state``) carries on from earlier matches: until a rule's last firing
    plus its cooldown none fires, late ones neither; the first match from then on does, as if it
    were the rule's first."""
    df = matches.withColumn("_t", F.unix_micros(F.col(ts))).withColumn("_cd", _cooldown_us(cooldown_col))
    held = None
    if state is not None:
        until = state.select(F.col("rule_id").alias(key), (F.col("last_us") + F.col("cooldown_us")).alias("_until"))
        df = df.join(broadcast_if_small(until), key, "left")
        waits = F.coalesce(F.col("_t") < F.col("_until"), F.lit(False))
        held, df = df.filter(waits).withColumn("fired", F.lit(False)), df.filter(~waits).drop("_until")
    out = ordered_scan(df, key, "_t", id_col, CooldownKernel(), num_partitions).drop("_t", "_cd")
    return out if held is None else out.unionByName(held.select(*out.columns))


def cooldown_state(alerts: DataFrame, before: DataFrame | None = None, ts: str = "ts", id_col: str = "anomaly_id",
                   cooldown_col: str = "cooldown_secs") -> DataFrame:
    """Per rule its last firing and the cooldown stored then: what ``apply_cooldown`` needs to go on."""
    fired = alerts.filter(F.col("fired")).select("rule_id", F.unix_micros(F.col(ts)).alias("last_us"), _cooldown_us(cooldown_col).alias("cooldown_us"),
                                                 F.col(id_col).cast("string").alias("_id"))
    if before is not None:
        fired = before.withColumn("_id", F.lit("")).unionByName(fired)
    last = F.max_by(F.struct("last_us", "cooldown_us"), F.struct("last_us", "_id"))
    return fired.groupBy("rule_id").agg(last.alias("x")).select("rule_id", "x.*")


def cooldown_reference(rows):
    """Plain sequential cooldown over (key, t_us, cooldown_us) rows, for tests."""
    state, out = {}, []
    for k, t, cd in rows:
        cd = NEVER_US if cd < 0 else cd
        s = state.get(k)
        if s is None or t - s[0] >= s[1]:
            state[k] = (t, cd)
            out.append(True)
        else:
            out.append(False)
    return out


def open_incidents_from(alerts: DataFrame, severity_from_rule: bool = False) -> DataFrame:
    """E5: one ``open`` incident per fired alert; context = the anomaly JSON.

    Severity defaults to ``warning`` as in the reference (the rule's severity is
    not copied) unless ``severity_from_rule``.
    """
    a = alerts.filter(F.col("fired")) if "fired" in alerts.columns else alerts
    sev = F.col("rule_severity") if severity_from_rule else F.lit(DEFAULT_INCIDENT_SEVERITY)
    return a.select(
        stable_uuid(F.lit("incident"), "rule_id", "anomaly_id").alias("id"),
        "tenant_id", F.col("rule_id").alias("alert_rule_id"), "title", "description",
        sev.alias("severity"), F.lit("open").alias("status"), "context",
        F.col("ts").alias("opened_at"),
        F.lit(None).cast("timestamp").alias("acknowledged_at"), F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(None).cast("string").alias("acknowledged_by"), F.lit(None).cast("string").alias("resolved_by"))


def open_unique(new_incidents: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Open only if no unresolved incident exists for (tenant, rule);
    among new ones keep the earliest per key.

    New incidents come down to one a key in each task before they are shuffled; only those meet
    the unresolved ones."""
    cols = new_incidents.columns
    first = F.min_by(F.struct(*cols), F.struct("opened_at", "id"))
    n = new_incidents.groupBy("tenant_id", "alert_rule_id").agg(first.alias("_i")).select("_i.*")
    if existing is not None:
        live = existing.filter(F.col("status") != "resolved").select("tenant_id", "alert_rule_id").distinct()
        n = n.join(live, ["tenant_id", "alert_rule_id"], "left_anti").select(*cols)
    return n


def _latest(updates: DataFrame, ts_col: str, cols: list[str]) -> DataFrame:
    """Latest update per (tenant_id, id): a partial-aggregating ``max_by``."""
    return updates.groupBy("tenant_id", "id").agg(
        F.max_by(F.struct(ts_col, *cols), F.col(ts_col)).alias("_u"))


def resolve_incidents(incidents: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Status → resolved, with time and user; unconditional and repeatable.

    Keyed on (tenant_id, id), unlike the reference's id-only update.
    """
    u = _latest(resolutions, "resolved_at", ["resolved_by"])
    j = incidents.join(u, ["tenant_id", "id"], "left")
    hit = F.col("_u").isNotNull()
    return j.select(*[
        (F.when(hit, F.lit("resolved")).otherwise(F.col("status")).alias("status") if c == "status" else
         F.when(hit, F.col("_u.resolved_at")).otherwise(F.col("resolved_at")).alias("resolved_at") if c == "resolved_at" else
         F.when(hit, F.col("_u.resolved_by")).otherwise(F.col("resolved_by")).alias("resolved_by") if c == "resolved_by" else
         F.col(c)) for c in incidents.columns])


def acknowledge_incidents(incidents: DataFrame, acks: DataFrame) -> DataFrame:
    """Open → acknowledged (others unchanged)."""
    u = _latest(acks, "acknowledged_at", ["acknowledged_by"])
    j = incidents.join(u, ["tenant_id", "id"], "left")
    hit = F.col("_u").isNotNull() & (F.col("status") == "open")
    return j.select(*[
        (F.when(hit, F.lit("acknowledged")).otherwise(F.col("status")).alias("status") if c == "status" else
         F.when(hit, F.col("_u.acknowledged_at")).otherwise(F.col("acknowledged_at")).alias("acknowledged_at")
         if c == "acknowledged_at" else
         F.when(hit, F.col("_u.acknowledged_by")).otherwise(F.col("acknowledged_by")).alias("acknowledged_by")
         if c == "acknowledged_by" else F.col(c)) for c in incidents.columns])


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def notifications(alerts: DataFrame, source: str = PAGERDUTY_SOURCE) -> dict[str, DataFrame]:
    """One payload row per (fired alert, channel); JSON keys in sorted order.

    What can't be sent goes to ``rejects`` with a reason, and neither the incident nor the other
    channels suffer (the reference aborts the rest of the evaluation there): a channel of unknown
    type, one without its address, and channels that are no JSON list (``channel_no`` -1). NULL
    channels are none.
    """
    a = alerts.filter(F.col("fired")) if "fired" in alerts.columns else alerts
    listed = F.when(F.trim("channels").startswith("["), F.from_json("channels", CHANNELS_DDL))
    broken = F.array(F.struct(F.lit(-1).alias("channel_no"), F.lit(None).cast("struct<type:string,url:string,routing_key:string>").alias("ch")))
    numbered = F.transform(listed, lambda c, i: F.struct(i.alias("channel_no"), c.alias("ch")))
    x = a.select("*", F.inline(F.when(F.col("channels").isNotNull(), F.coalesce(numbered, broken))))
    typ = F.col("ch.type")
    slack = F.to_json(F.struct(F.concat(F.lit("*"), F.col("title"), F.lit("*\n"), F.col("description")).alias("text")))
    pd_ = F.to_json(F.struct(
        F.lit(PAGERDUTY_ACTION).alias("event_action"),
        F.struct(F.lit(PAGERDUTY_SEVERITY).alias("severity"), F.lit(source).alias("source"),
                 F.col("title").alias("summary")).alias("payload"),
        F.col("ch.routing_key").alias("routing_key")))
    hook = F.to_json(F.struct(F.col("description").alias("description"), iso_utc(F.col("ts")).alias("timestamp"),
                              F.col("title").alias("title")))
    address = F.when(typ == "pagerduty", F.col("ch.routing_key")).when(typ.isin("slack", "webhook"), F.col("ch.url"))
    target = F.when(typ == "pagerduty", F.lit("https://events.pagerduty.com/v2/enqueue")).otherwise(F.col("ch.url"))
    payload = F.when(typ == "slack", slack).when(typ == "pagerduty", pd_).when(typ == "webhook", hook)
    reason = (F.when(F.col("channel_no") < 0, "channels are no list").when(payload.isNull(), "unknown channel type")
              .when(F.coalesce(address, F.lit("")) == "", "missing address"))
    x = x.withColumn("channel_type", typ).withColumn("target", target).withColumn("payload", payload).withColumn("reason", reason)
    keep = [c for c in ("anomaly_id", "tenant_id", "rule_id", "ts") if c in a.columns]
    return {"notifications": x.filter(F.col("reason").isNull()).select(*keep, "channel_no", "channel_type", "target", "payload"),
            "rejects": x.filter(F.col("reason").isNotNull()).select(*keep, "channel_no", "channel_type", "reason")}


def run_alerting(anomalies: DataFrame, rules: DataFrame, state: DataFrame | None = None, validate_uuid: bool = False,
                 severity_from_rule: bool = False, source: str = PAGERDUTY_SOURCE) -> dict[str, DataFrame]:
    """Anomalies against rules (E1, E2), cooldown (E3), incidents (E4, E5) and notifications.

    Returns ``alerts`` (every match, with ``fired``), ``incidents``, ``notifications``,
    ``rejects`` (anomalies of no valid tenant), ``notification_rejects`` and ``state``, which the
    next call takes to carry cooldowns on; calls on consecutive slices of time, each with the state
    of the one before, give together what one call on all of them gives."""
    m = match_rules(anomalies, rules, validate_uuid)
    alerts = apply_cooldown(m["matches"], state=state)
    sent = notifications(alerts, source)
    return {"alerts": alerts, "incidents": open_incidents_from(alerts, severity_from_rule), "notifications": sent["notifications"],
            "rejects": m["rejects"], "notification_rejects": sent["rejects"], "state": cooldown_state(alerts, state)}


COMPARATORS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b,
               "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def _threshold_rules(rules: DataFrame) -> DataFrame:
    """Enabled threshold rules with their settings; a rule without a window has one of 60 seconds."""
    cfg = F.from_json("rule_config", "metric string, comparator string, threshold double, window_secs bigint")
    return (rules.filter(F.col("is_enabled") & (F.col("rule_type") == "threshold"))
            .select("tenant_id", F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), cfg.alias("c"))
            .select("tenant_id", "rule_id", "rule_name", F.col("c.metric").alias("name"),
                    F.col("c.comparator").alias("comparator"), F.col("c.threshold").alias("threshold"),
                    F.coalesce(F.col("c.window_secs"), F.lit(60)).alias("window_secs")))


#: Values and thresholds as decimals: a window's sum is exact, whatever the order of its rows.
EXACT, EXACT_THRESHOLD = "decimal(38,9)", "decimal(19,9)"
THRESHOLD_KEYS = ("tenant_id", "rule_id", "rule_name", "name", "comparator", "threshold", "window_secs")


def _window_sums() -> list[Column]:
    return [F.sum(F.col("value").cast(EXACT)).alias("window_sum"), F.count("value").alias("samples")]


def _crossed(g: DataFrame) -> DataFrame:
    """Windows whose exact mean the rule's comparator takes: the sum against threshold times count."""
    limit = F.col("threshold").cast(EXACT_THRESHOLD) * F.col("samples").cast("decimal(18,0)")
    cmp = None
    for op, fn in COMPARATORS.items():
        c = (F.col("comparator") == op) & fn(F.col("window_sum"), limit)
        cmp = c if cmp is None else (cmp | c)
    return g.filter(cmp).withColumn("window_mean", F.col("window_sum").cast("double") / F.col("samples"))


def evaluate_threshold_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """``threshold`` rules — mean of a metric per tumbling ``window_secs``
    window of the rule's tenant, compared with the threshold.

    The reference only declares this rule type; the window mean is our choice. The comparison is
    exact in decimals of nine places. Partial aggregation happens before the shuffle on (rule, window).
    """
    m = metrics.join(broadcast_if_small(_threshold_rules(rules)), ["tenant_id", "name"], "inner")
    start = (F.floor(F.col("timestamp") / F.col("window_secs")) * F.col("window_secs")).cast("bigint")
    return _crossed(m.groupBy(*THRESHOLD_KEYS, start.alias("window_start")).agg(*_window_sums()))


def threshold_stream(metrics: DataFrame, rules: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """E10 (stream): the windows of ``evaluate_threshold_rules``, each told once it is final.

    A window is final when the watermark (newest time seen less ``watermark``) passes its end; rows
    that come later than that are left out of it (Spark counts them). Rules of one window length
    share an aggregation over event-time windows; the lengths, a handful, are read from the rules
    when the query starts."""
    r = _threshold_rules(rules)
    lengths = sorted(x.window_secs for x in r.select("window_secs").distinct().collect())
    timed = metrics.withColumn("_at", F.timestamp_seconds("timestamp")).withWatermark("_at", watermark)
    out = None
    for secs in lengths:
        m = timed.join(broadcast_if_small(r.where(F.col("window_secs") == secs)), ["tenant_id", "name"], "inner")
        g = m.groupBy(*THRESHOLD_KEYS, F.window("_at", f"{secs} seconds").alias("w")).agg(*_window_sums())
        found = _crossed(g.withColumn("window_start", F.unix_seconds("w.start")).drop("w"))
        out = found if out is None else out.unionByName(found)
    return out
