"""Detection: D2 guard, D3 properties, D4 formula, D5 consistency."""

import numpy as np
import pytest

from signalspark.operators.detect import (detect_values, expected_verdict, forest_step_function,
                                          iforest_score_samples)


def test_short_history():
    assert detect_values([1.0, 2.0, 3.0, 4.0]) == (0.0, False, "Insufficient history")
    assert expected_verdict([1.0, 2.0, 3.0, 4.0]) == (0.0, False, "Insufficient history")


def test_constant_series_is_not_anomalous():
    score, flag, _ = detect_values(np.ones(40))
    assert score == pytest.approx(0.5) and not flag


def test_outlier_last_value_is_flagged():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 200), [9.0]])
    score, flag, _ = detect_values(x)
    assert flag and score > 0.6
    s2, f2, _ = expected_verdict(x)
    assert f2 and s2 > 0.6


def test_score_is_half_minus_decision_and_flag_iff_above_half():
    rng = np.random.default_rng(1)
    for seed in range(20):
        x = rng.normal(0, 1, 64)
        score, flag, _ = detect_values(x, seed=seed)
        assert flag == (score > 0.5)


def test_expected_depth_matches_monte_carlo():
    """D4 equals the limit of many unlimited-depth random trees (no height limit)."""
    rng = np.random.default_rng(2)
    x = np.sort(rng.normal(0, 1, 30))
    from signalspark.operators.detect import _forest_depths_full, c_factor
    mc = _forest_depths_full(x, 20000, 10**6, np.random.default_rng(3)) / 20000
    d, mult = np.unique(x, return_counts=True)
    g = np.diff(d)
    exp = np.array([sum(g[j] / (d[j + 1] - d[k]) for j in range(k, len(d) - 1))
                    + sum(g[j] / (d[k] - d[j]) for j in range(k)) for k in range(len(d))]) + c_factor(mult)
    assert np.abs(mc - exp).max() < 0.05


def test_step_function_equals_direct_scoring():
    """D5's step function reproduces per-tree scoring of the fitted sample."""
    rng = np.random.default_rng(4)
    s = rng.normal(0, 1, 100)
    breaks, paths, psi = forest_step_function(s, trees=50, seed=9)
    assert len(paths) == len(breaks) + 1 and psi == 100
    h = paths[np.searchsorted(breaks, s, side="left")]
    assert np.all(h > 0) and h.argmin() in (s.argmax(), s.argmin()) or h.min() < h.mean()


def test_d5_spark_runs_and_flags_share(spark):
    from conftest import SF001
    from signalspark.plans.registry import QUERIES
    rows = QUERIES["d5_score_isolation"](spark, SF001).collect()
    assert len(rows) == 1000
    share = sum(r.is_anomaly for r in rows) / len(rows)
    assert 0.0 < share < 0.3


def test_long_series_are_judged_whole(spark):
    """A series of far more rows than a tree's sample: nothing is cut, the outlier at its end stands out."""
    from signalspark.operators.detect import detect_series, recent_values
    rng = np.random.default_rng(5)
    rows = [("t", "long", i, float(v)) for i, v in enumerate(rng.normal(0, 1, 3000))] + [("t", "long", 3000, 50.0)]
    rows += [("t", "short", i, 1.0) for i in range(4)] + [("t", "flat", i, 2.0) for i in range(9)] + [("t", "none", 0, None)]
    m = spark.createDataFrame(rows, "tenant_id string, name string, timestamp long, value double")
    got = {r.name: r for r in detect_series(m).collect()}
    assert set(got) == {"long", "short", "flat"}
    assert got["long"].n_values == 3001 and got["long"].is_anomaly and got["long"].anomaly_score > 0.5
    assert got["short"].reason == "Insufficient history" and got["short"].anomaly_score == 0.0
    assert got["flat"].anomaly_score == pytest.approx(0.5) and not got["flat"].is_anomaly
    sizes = {r.name: len(r["values"]) for r in recent_values(m.where("value is not null")).collect()}
    assert sizes == {"long": 3001, "short": 4, "flat": 9}


def test_expected_verdict_in_blocks(monkeypatch):
    from signalspark.operators import detect
    x = np.random.default_rng(6).normal(0, 1, 300)
    whole = expected_verdict(x)
    monkeypatch.setattr(detect, "DEPTH_CELLS", 1000)
    assert expected_verdict(x)[0] == pytest.approx(whole[0], abs=1e-12)


def test_short_and_long_series_both_occur(spark):
    from conftest import SF01
    from signalspark.plans.registry import QUERIES
    reasons = {r.reason for r in QUERIES["d2_short_history"](spark, SF01).select("reason").distinct().collect()}
    assert reasons == {None, "Insufficient history"}


def test_batch_search_breaks_ties_by_id(spark):
    from signalspark.operators.vectors import semantic_search_batch
    vecs = spark.createDataFrame([(f"{i:03d}", "t", [1.0, 2.0, 3.0]) for i in reversed(range(400))],
                                 "id string, tenant_id string, vector array<double>")
    query = spark.createDataFrame([("q", "t", [3.0, 2.0, 1.0])], "query_id string, tenant_id string, qvector array<double>")
    got = semantic_search_batch(vecs, query, k=5).orderBy("rank").collect()
    assert [r.id for r in got] == ["000", "001", "002", "003", "004"]


def test_expected_depths_of_many_values(monkeypatch):
    """Of a long series few depths are summed value by value, and the verdict is that of all of them."""
    from signalspark.operators import detect as DT
    rng, exact = np.random.default_rng(3), DT._depths_at
    for values in (rng.exponential(40, 6000), rng.lognormal(0, 4, 6000), np.concatenate([rng.random(3000) * 1e-9, rng.random(3000) * 1e9])):
        done = []
        monkeypatch.setattr(DT, "_depths_at", lambda d, places: done.append(len(places)) or exact(d, places))
        monkeypatch.setattr(DT, "FAR_FROM", 2048)
        got = DT.expected_verdict(values)
        assert sum(done) < 60
        monkeypatch.setattr(DT, "FAR_FROM", 10**9)
        assert got == DT.expected_verdict(values)
