"""Golden corpus for the Prometheus exposition parser."""

import math

from signalspark.operators.parse_prom import parse_exposition

BODY = "\n".join([
    "# HELP foo A counter",
    'foo{job="bar"} 42.0',
    "up 1 1700000000000",
    'foo{a="b c"} 1',
    "foo  1",
    "foo\t1",
    'foo{a="x,y"} 1',
    'foo{a="b=c"} 2',
    "foo{} 1",
    'h_bucket{le="+Inf"} 7',
    "x NaN",
    "x +Inf",
    "x 1d",
    'foo{a="b"}',
    "foo{ 1",
    "",
    "   ",
    "y .5e1",
])


def test_reference_line(spark):
    df = spark.createDataFrame([("# HELP foo A counter\nfoo{job=\"bar\"} 42.0\n",)], "body string")
    rows = parse_exposition(df, "body").collect()
    assert len(rows) == 1
    assert (rows[0].name, rows[0].value, rows[0].labels) == ("foo", 42.0, {"job": "bar"})


def test_golden_body(spark):
    df = spark.createDataFrame([(BODY,)], "body string")
    rows = [(r.name, dict(r.labels), r.value) for r in parse_exposition(df, "body").orderBy("sample_no").collect()]
    assert rows[:6] == [
        ("foo", {"job": "bar"}, 42.0),
        ("up", {}, 1.0),
        ("foo", {"a": "x"}, 1.0),
        ("foo", {"a": "b=c"}, 2.0),
        ("foo", {}, 1.0),
        ("h_bucket", {"le": "+Inf"}, 7.0),
    ]
    assert rows[6][0] == "x" and math.isnan(rows[6][2])
    assert rows[7] == ("x", {}, math.inf)
    assert rows[8] == ("y", {}, 5.0)
    assert len(rows) == 9
