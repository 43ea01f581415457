"""F4 against a sorted list: ties, few samples, extreme shares, a coarse sketch."""

import math
import random

import pytest

from signalspark.operators import insight


@pytest.mark.parametrize("q", [0.0, 0.001, 0.5, 0.99, 0.9999, 1.0])
@pytest.mark.parametrize("sketch", [50, 10_000])
def test_equals_sorted_list(spark, monkeypatch, q, sketch):
    monkeypatch.setattr(insight, "SKETCH", sketch)
    rng = random.Random(int(q * 1000) + sketch)
    groups = {("a", 0): [rng.gauss(0, 1) for _ in range(3000)], ("a", 86400): [rng.choice([0.0, 1.0, 5.0]) for _ in range(700)], ("b", 0): [3.5],
              ("b", 86400): [-1e300, 0.0, 1e300], ("c", 0): [2.0] * 400 + [7.0]}
    rows = [(t, b + i % 80000, "m", v) for (t, b), vs in groups.items() for i, v in enumerate(vs)] + [("a", 1, "m", None), ("a", 1, "x", 1.0), ("d", 1, "m", None)]
    df = spark.createDataFrame(rows, "tenant_id string, timestamp long, name string, value double").repartition(5)
    got = {(r.tenant_id, r.bucket_start): (r.p99, r.samples) for r in insight.p99(df, "m", q=q).collect()}
    assert got == {k: (sorted(v)[max(1, math.ceil(q * len(v))) - 1], len(v)) for k, v in groups.items()}
