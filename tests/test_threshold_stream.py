"""Exact means, and windows streamed once they are final."""

import datetime as dt
import os

from signalspark.operators import alerting as AL

RULE_DDL = "id string, tenant_id string, name string, rule_type string, rule_config string, is_enabled boolean"
ROW_DDL = "tenant_id string, timestamp long, name string, value double"


def _rules(spark, *told):
    cfg = '{"metric":"m","comparator":"%s","threshold":%s,"window_secs":%d}'
    return spark.createDataFrame([(f"r{i}", "t", f"n{i}", "threshold", cfg % x, True) for i, x in enumerate(told)], RULE_DDL)


def _told(df):
    return sorted((r.rule_id, r.window_start, r.samples, str(r.window_sum)) for r in df.collect())


def test_mean_is_exact(spark):
    rows = [("t", i, "m", v) for i, v in enumerate([0.1] * 10 + [1e15, 0.2, -1e15])] + [("t", 100, "m", None)]
    df = spark.createDataFrame(rows, ROW_DDL).repartition(7)
    rules = _rules(spark, ("==", 0.1, 10), (">", 0.1, 10), ("<=", 0.1, 10), ("==", 0.0666666666, 10))
    assert [(r[0], r[1]) for r in _told(AL.evaluate_threshold_rules(df, rules))] == [("r0", 0), ("r2", 0), ("r2", 10)]


def test_stream_equals_batch_but_for_late_rows(spark, tmp_path):
    rules = _rules(spark, (">", 10.0, 60), ("<", 20.0, 300), (">=", 0.0, 60))
    day = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    rows = [("t", day + s, "m", float(s % 37)) for s in range(0, 3600, 7)] + [("t", day + 5, "other", 1.0), ("u", day + 5, "m", 99.0)]
    late = [("t", day + 30, "m", 1000.0)]
    files = [[r for r in rows if r[1] < day + 1200], [r for r in rows if day + 1200 <= r[1] < day + 2400], [r for r in rows if r[1] >= day + 2400] + late, [("t", day + 10_000, "m", 1.0)]]
    (tmp_path / "in").mkdir()
    for n, part in enumerate(files):
        spark.createDataFrame(part, ROW_DDL).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        (tmp_path / "in" / f"{n}.parquet").write_bytes(next((tmp_path / f"p{n}").glob("*.parquet")).read_bytes())
        os.utime(tmp_path / "in" / f"{n}.parquet", (10**9 + n, 10**9 + n))
    stream = spark.readStream.schema(ROW_DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (AL.threshold_stream(stream, rules, "2 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark"))
         .trigger(availableNow=True).start(str(tmp_path / "out")))
    q.awaitTermination(300)
    want = _told(AL.evaluate_threshold_rules(spark.createDataFrame(rows, ROW_DDL), rules))
    assert len(want) > 60 and _told(spark.read.parquet(str(tmp_path / "out"))) == want
