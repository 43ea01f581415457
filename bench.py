"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion through the ``noop`` sink (full execution,
nothing collected); the first run warms the JVM and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a2_parse_document_lines", "a7_parse_exposition", "b1_log_rows", "c2_search_logs", "c4_latest_metrics",
    "a10_admission", "e3_cooldown", "e9_notifications", "d3_detect", "d4_detect_expected", "e11_alert_flow",
    "b9_embed_documents", "c6_semantic_search", "c7_semantic_search_batch", "f1_explain", "f8_traffic",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession
    from signalspark.plans.registry import QUERIES
    from signalspark.session import configure
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("signalspark-bench")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(int(cpus) * 2))
             .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "16g"))
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    names = [n for n in HEADLINE if n in QUERIES]
    QUERIES["b1_log_rows"](spark, base).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for n in names:
        t = time.perf_counter()
        QUERIES[n](spark, base).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t, 3)
    sf = os.path.basename(base.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "spark": spark.version,
                      "shuffle_partitions": int(cpus) * 2}))


if __name__ == "__main__":
    main()
