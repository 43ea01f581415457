"""Golden corpus for the log-line parser (reference unit tests are rows 1–3 and 5)."""

import json

import pytest

from signalspark.operators.parse_logs import parse_logs

GOLDEN = [
    # raw, level, message, trace_id, fields(JSON text)
    ('{"level":"error","message":"db timeout","trace_id":"abc123"}', "ERROR", "db timeout", "abc123", {}),
    ('level=warn msg="high latency" service=api duration=450ms', "WARN", "high latency", None,
     {"duration": "450ms", "service": "api"}),
    ("[ERROR] something exploded", "ERROR", "something exploded", None, {}),
    ('{"level":3,"severity":"warn","msg":"x"}', "WARN", "x", None, {}),
    ('{"trace_id":null,"traceId":"t","msg":"m"}', "INFO", "m", None, {}),
    ('{"b":"y","a":1}', "INFO", '{"a":1,"b":"y"}', None, {"a": 1, "b": "y"}),
    ('{"a":1} k=v', "INFO", '{"a":1} k=v', None, {'{"a":1} k': "v"}),
    ("{bad json", "INFO", "{bad json", None, {}),
    ("[ERROR] x=1", "INFO", "[ERROR] x=1", None, {"[ERROR] x": "1"}),
    ("WARNING: disk full", "WARN", "ING: disk full", None, {}),
    ("INFORMATION ready", "INFO", "RMATION ready", None, {}),
    ("ERRO bad", "ERROR", "O bad", None, {}),
    ("errors were found", "ERROR", "s were found", None, {}),
    ("<CRIT> - meltdown", "FATAL", "meltdown", None, {}),
    ("", "INFO", "", None, {}),
    ("hello world", "INFO", "hello world", None, {}),
    ("msg=a message=b", "INFO", "b", None, {"msg": "a"}),
    ('a="x=y" level=ERR tail', "ERROR", 'a="x=y" level=ERR tail', None, {"a": "x=y"}),
    ("level=warn foo bar msg=hi", "WARN", "level=warn foo bar msg=hi", None, {"foo bar msg": "hi"}),
    ("PANIC", "FATAL", "", None, {}),
    ("[2024-01-01] ERROR x", "INFO", "[2024-01-01] ERROR x", None, {}),
    ('{"msg":"m","text":"t"}', "INFO", "m", None, {}),
    ("a=1 a=2", "INFO", "a=1 a=2", None, {"a": "2"}),
    ('{"a":1,"a":2,"msg":"q"}', "INFO", "q", None, {"a": 2}),
    ("   [WARN]  spaced 　", "WARN", "spaced", None, {}),
    ('{"a":1}}', "INFO", '{"a":1}}', None, {}),
    ("{'a':1}", "INFO", "{'a':1}", None, {}),
    ('level=" trace " x=1 trace_id=t1 traceId=t2', "TRACE", 'level=" trace " x=1 trace_id=t1 traceId=t2', "t1",
     {"traceId": "t2", "x": "1"}),
    ('k="unterminated value', "INFO", 'k="unterminated value', None, {"k": "unterminated value"}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "id int, raw string")
    return {r.id: r for r in parse_logs(df).collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden_line(parsed, i):
    raw, level, message, trace, fields = GOLDEN[i]
    r = parsed[i]
    assert (r.level, r.message, r.trace_id) == (level, message, trace), raw
    assert json.loads(r.fields) == fields, raw


def test_fields_are_key_sorted(parsed):
    r = parsed[1]
    assert r.fields == '{"duration":"450ms","service":"api"}'


def test_level_normalisation(spark):
    from pyspark.sql import functions as F
    from signalspark.functions.text import normalize_level
    cases = {"ERR": "ERROR", "WARNING": "WARN", "CRIT": "FATAL", " dbg ": "DEBUG", "information": "INFO",
             "nope": "INFO", "Trc": "TRACE", "panic": "FATAL", "erro": "ERROR", "wrn": "WARN", "inf": "INFO"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.lv for r in df.select("s", normalize_level(F.col("s")).alias("lv")).collect()}
    assert got == cases


def test_filters_hold_no_copy_of_the_parser(spark):
    from conftest import SF001
    from signalspark.plans.registry import QUERIES
    for name in ("b1_log_rows", "c2_search_logs", "c2_search_logs_filtered", "c11_min_level"):
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") <= 2, name
