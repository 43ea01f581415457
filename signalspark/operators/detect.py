"""Metric series windows and isolation-forest anomaly scores.

D1 gives whole series, or on request their newest ``n`` values (``row_number() <= n``,
planned as WindowGroupLimit: a partial top-n per partition before the shuffle).
D3 and D5 never hold a series: forests are fitted on bounded samples (see ``forest``),
rows are scored in salted groups, and the threshold is an exact aggregate over all rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..constants import (EULER_GAMMA, IFOREST_CONTAMINATION, IFOREST_MAX_SAMPLES, IFOREST_TREES,
                         INSUFFICIENT_HISTORY, MIN_HISTORY)
from ..plans.joins import broadcast_if_small
from . import forest

#: Cells of one block of D4's distance matrix.
DEPTH_CELLS = 1 << 20
#: Distinct values from which D4 sums runs by moments, terms of those (an error of 3 ** -FAR_TERMS),
#: values of a run that is summed one by one, and a distance of depths far above that error.
FAR_FROM, FAR_TERMS, NEAR_RUN, NEAR_DEPTH = 2048, 20, 64, 1e-6

DETECT_DDL = "anomaly_score DOUBLE, is_anomaly BOOLEAN, reason STRING"


def recent_rows(metrics: DataFrame, n: int | None = None, keys=("tenant_id", "name"), ts: str = "timestamp", value: str = "value") -> DataFrame:
    """D1 as rows: the newest ``n`` samples of every series (or all) with ``rank``, 1 the newest.

    No series is gathered in one row; with an ``n`` each task cuts its part before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(value).desc())
    out = metrics.select(*keys, ts, value).withColumn("rank", F.row_number().over(w))
    return out if n is None else out.filter(F.col("rank") <= n)


def recent_values(metrics: DataFrame, n: int | None = None, keys=("tenant_id", "name"),
                  ts: str = "timestamp", value: str = "value") -> DataFrame:
    """Per series all values, or the newest ``n``, as ``values`` (oldest → newest)."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(value).desc())
    top = metrics.select(*keys, ts, value).withColumn("_rn", F.row_number().over(w))
    if n is not None:
        top = top.filter(F.col("_rn") <= n)
    # the rank falls from oldest to newest and is unique, so that it alone tells the order
    g = top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("_rn")).alias("r"), F.col(value).alias("v")))).alias("_s"),
                               F.max(ts).alias("last_ts"))
    return g.select(*keys, "last_ts", F.transform("_s", lambda x: x["v"]).alias("values"))


# ----------------------------------------------------------------------------- D3
def c_factor(n):
    """Average unsuccessful-search path length c(n) of a binary search tree."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _tree_paths(sample_sorted: np.ndarray, x: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """Path length of every ``x`` in one random 1-D isolation tree built on
    ``sample_sorted``: split uniform in [min, max] of the node, ``<=`` goes
    left, leaves at ``limit`` depth, with one value, or with equal values."""
    bounds, leaf_len = [], []
    stack = [(0, len(sample_sorted), 0)]
    while stack:  # in-order: right pushed first so leaves come out left → right
        lo, hi, d = stack.pop()
        size = hi - lo
        if d >= limit or size <= 1 or sample_sorted[lo] == sample_sorted[hi - 1]:
            leaf_len.append(d + float(c_factor([size])[0]))
            continue
        thr = rng.uniform(sample_sorted[lo], sample_sorted[hi - 1])
        mid = lo + int(np.searchsorted(sample_sorted[lo:hi], thr, side="right"))
        stack.append((mid, hi, d + 1))
        stack.append((lo, mid, d + 1))
        bounds.append(thr)
    # bounds were appended in pre-order; leaves are in order; sort bounds to match
    bounds = np.sort(np.asarray(bounds))
    return np.asarray(leaf_len)[np.searchsorted(bounds, x, side="left")]


def _forest_depths_full(x_sorted: np.ndarray, trees: int, limit: int, rng: np.random.Generator) -> np.ndarray:
    """Summed path lengths of every sorted point over ``trees`` trees that are
    all built on the full (sorted) sample, grown level by level for all trees
    at once. A node is an index range [lo, hi) of the sorted values; a split
    at a uniform threshold sends values ``<=`` it left, i.e. splits the range
    at ``searchsorted(x, thr, 'right')``."""
    n = len(x_sorted)
    lo = np.zeros(trees, dtype=np.int64)
    hi = np.full(trees, n, dtype=np.int64)
    diff = np.zeros(n + 1)
    depth = 0
    while len(lo):
        size = hi - lo
        vmin, vmax = x_sorted[lo], x_sorted[hi - 1]
        leaf = (depth >= limit) | (size <= 1) | (vmin == vmax)
        if leaf.any():
            val = depth + c_factor(size[leaf])
            np.add.at(diff, lo[leaf], val)
            np.add.at(diff, hi[leaf], -val)
        lo, hi, vmin, vmax = lo[~leaf], hi[~leaf], vmin[~leaf], vmax[~leaf]
        if not len(lo):
            break
        thr = rng.uniform(vmin, vmax)
        mid = np.clip(np.searchsorted(x_sorted, thr, side="right"), lo, hi)
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        depth += 1
    return np.cumsum(diff)[:n]


def iforest_score_samples(values: np.ndarray, trees: int = IFOREST_TREES, max_samples: int = IFOREST_MAX_SAMPLES,
                          seed: int = 42) -> np.ndarray:
    """``score_samples`` (= −2^(−E[h]/c(ψ))) of every value, fitted on the values."""
    x = np.asarray(values, dtype=float)
    n = len(x)
    psi = min(max_samples, n)
    limit = int(math.ceil(math.log2(max(psi, 2))))
    rng = np.random.default_rng(seed)
    if psi == n:  # every tree sees all points: vectorised over trees
        order = np.argsort(x, kind="stable")
        depth = np.empty(n)
        depth[order] = _forest_depths_full(x[order], trees, limit, rng)
    else:
        depth = np.zeros(n)
        for _ in range(trees):
            sample = x[rng.choice(n, psi, replace=False)]
            depth += _tree_paths(np.sort(sample), x, limit, rng)
    return -np.power(2.0, -(depth / trees) / float(c_factor([psi])[0]))


def detect_values(values, seed: int = 42, trees: int = IFOREST_TREES,
                  contamination: float = IFOREST_CONTAMINATION) -> tuple[float, bool, str | None]:
    """D2+D3 on one series: judge its last value."""
    v = np.asarray(values if values is not None else [], dtype=float)
    if len(v) < MIN_HISTORY:
        return 0.0, False, INSUFFICIENT_HISTORY
    s = iforest_score_samples(v, trees=trees, seed=seed)
    offset = np.percentile(s, 100.0 * contamination)
    decision = s[-1] - offset
    return float(0.5 - decision), bool(decision < 0), None


def series_seed(*parts: str) -> int:
    return int.from_bytes(hashlib.sha256("\x1f".join(parts).encode()).digest()[:4], "little")


@F.pandas_udf(T.StructType([T.StructField("anomaly_score", T.DoubleType()),
                             T.StructField("is_anomaly", T.BooleanType()),
                             T.StructField("reason", T.StringType())]))
def _detect_udf(values: pd.Series, seed_key: pd.Series) -> pd.DataFrame:
    out = [detect_values(v, seed=series_seed(k)) for v, k in zip(values, seed_key)]
    return pd.DataFrame(out, columns=["anomaly_score", "is_anomaly", "reason"])


# Marked non-deterministic only so that the optimizer never copies the forest
# into a pushed-down filter (which would fit every forest twice).
_detect_once = _detect_udf.asNondeterministic()


def detect_series(metrics: DataFrame, keys=("tenant_id", "name"), ts: str = "timestamp", value: str = "value",
                  id_cols=("timestamp",), contamination: float = IFOREST_CONTAMINATION) -> DataFrame:
    """D2 + D3: verdict on the newest value of every whole series.

    (keys, last_ts, n_values, anomaly_score, is_anomaly, reason). The forest comes
    from ``fit_isolation``; every row is scored in salted groups and the threshold is
    the exact, interpolated quantile over all rows: a forest is a step function, so a
    series has a bounded number of distinct scores. Of values that tie in time the
    greatest is the newest. A series without non-null values has no row."""
    m = metrics.select(*dict.fromkeys([*keys, ts, value, *id_cols])).where(F.col(value).isNotNull())
    models = fit_isolation(m, keys, value, id_cols)
    scored = _score_rows(m, models, keys, value, id_cols)
    g = scored.groupBy(*keys).agg(F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_values"),
                                  F.percentile("score_samples", contamination).alias("_offset"),
                                  F.max_by("score_samples", F.struct(ts, value)).alias("_last"))
    short = F.col("n_values") < MIN_HISTORY
    decision = F.col("_last") - F.col("_offset")
    return g.select(*keys, "last_ts", "n_values",
                    F.when(short, F.lit(0.0)).otherwise(F.lit(0.5) - decision).alias("anomaly_score"),
                    F.when(short, F.lit(False)).otherwise(decision < 0).alias("is_anomaly"),
                    F.when(short, F.lit(INSUFFICIENT_HISTORY)).alias("reason"))


def detect(series: DataFrame, values: str = "values", keys=("tenant_id", "name")) -> DataFrame:
    """D3 on arrays that D1 made: isolation-forest verdict on the last value.

    Runs as an Arrow-batched pandas UDF, in parallel over series, each of which is
    held whole; ``detect_series`` is the form for series of any length.
    """
    seed_key = F.concat_ws("\u001f", *[F.col(k).cast("string") for k in keys])
    return series.withColumn("_d", _detect_once(F.col(values), seed_key)).select("*", "_d.*").drop("_d")


# ----------------------------------------------------------------------------- D4
def _depths_at(d: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Exact expected depths of some places of the sorted distinct values, in blocks of all of them."""
    m, h = len(d), np.zeros(len(places))
    g = np.diff(d)                               # gap j lies between d[j] and d[j+1]
    j = np.arange(m - 1)[None, :]
    step = max(1, DEPTH_CELLS // m)
    for at in range(0, len(places), step):
        k = places[at:at + step, None]
        x_k = d[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            right = np.where(j >= k, g[None, :] / (d[1:][None, :] - x_k), 0.0)
            left = np.where(j < k, g[None, :] / (x_k - d[:-1][None, :]), 0.0)
        h[at:at + step] = right.sum(axis=1) + left.sum(axis=1)
    return h


def _sums_below(d: np.ndarray, g: np.ndarray) -> np.ndarray:
    """For every k the sum of g[i] / (d[k] - d[i]) over i < k, to some ten digits.

    A run of values acts on what lies three of its radii or more from its middle by the first
    FAR_TERMS moments (all terms are positive, so that the rest is relatively small); on nearer
    values its halves do, down to runs that are summed one by one."""
    out, size = np.zeros(len(d)), NEAR_RUN
    for s in range(0, len(d), size):
        x = d[s:s + size]
        out[s:s + size] = np.tril(g[s:s + size] / (x[:, None] - x), -1).sum(1)
    while size < len(d):
        for s in range(0, len(d) - size, 2 * size):  # the lower half of each run of 2 * size on its upper half
            todo = [(s, s + size, s + size, min(s + 2 * size, len(d)))]
            while todo:
                a, b, lo, hi = todo.pop()
                if b - a > NEAR_RUN:
                    middle, radius = d[a] / 2 + d[b - 1] / 2, d[b - 1] / 2 - d[a] / 2
                    far = max(lo, int(np.searchsorted(d[:hi], middle + 3 * radius)))
                    if far < hi:
                        u, z = (d[a:b] - middle) / radius, radius / (d[far:hi] - middle)
                        moments = (g[a:b] * u ** np.arange(FAR_TERMS)[:, None]).sum(1)
                        out[far:hi] += np.polynomial.polynomial.polyval(z, moments) * z / radius
                    if lo < far:
                        half = (a + b) // 2
                        todo += [(a, half, lo, far), (half, b, lo, far)]
                else:
                    for at in range(lo, hi, DEPTH_CELLS // NEAR_RUN):
                        to = min(hi, at + DEPTH_CELLS // NEAR_RUN)
                        out[at:to] += (g[a:b] / (d[at:to, None] - d[a:b])).sum(1)
        size *= 2
    return out


def _depths(d: np.ndarray, mult: np.ndarray, last: int, share: float) -> np.ndarray:
    """Expected depths of the sorted distinct values. Of a long series only those are exact (as of
    ``_depths_at``) that may lie next to the ``share`` quantile, and that of place ``last``; all others
    are near enough to stand on their side of it."""
    every = np.arange(len(d))
    if len(d) < 2:
        return np.zeros(len(d))
    if len(d) < FAR_FROM or not np.isfinite(d).all():
        return _depths_at(d, every)
    g = np.diff(d)
    with np.errstate(all="ignore"):
        h = _sums_below(d, np.append(g, 0.0)) + _sums_below(-d[::-1], np.append(g[::-1], 0.0))[::-1]
    if not np.isfinite(h).all():
        return _depths_at(d, every)
    whole = h + c_factor(mult)
    by = np.argsort(whole, kind="stable")
    below = np.cumsum(mult[by])
    rank = (below[-1] - 1) * share               # the quantile lies between two neighbouring ranks
    low, high = (whole[by[np.searchsorted(below, r, side="right")]] for r in (math.floor(rank), math.ceil(rank)))
    near = (whole >= low - NEAR_DEPTH) & (whole <= high + NEAR_DEPTH)
    near[last] = True
    h[near] = _depths_at(d, every[near])
    return h


def expected_verdict(values, contamination: float = IFOREST_CONTAMINATION) -> tuple[float, bool, str | None]:
    """D4 on one series: the depth of its newest value against the quantile of all depths, both exact."""
    x = np.asarray(values if values is not None else [], dtype=float)
    n = len(x)
    if n < MIN_HISTORY:
        return 0.0, False, INSUFFICIENT_HISTORY
    d, mult = np.unique(x, return_counts=True)
    at = min(int(np.searchsorted(d, x[-1])), len(d) - 1)
    h = _depths(d, mult, at, contamination) + c_factor(mult)
    psi = min(n, IFOREST_MAX_SAMPLES)
    s_d = -np.power(2.0, -h / float(c_factor([psi])[0]))
    offset = np.percentile(np.repeat(s_d, mult), 100.0 * contamination)
    decision = s_d[at] - offset
    return float(0.5 - decision), bool(decision < 0), None


@F.pandas_udf(T.StructType([T.StructField("anomaly_score", T.DoubleType()),
                             T.StructField("is_anomaly", T.BooleanType()),
                             T.StructField("reason", T.StringType())]))
def _expected_udf(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([expected_verdict(v) for v in values], columns=["anomaly_score", "is_anomaly", "reason"])


def detect_expected(series: DataFrame, values: str = "values") -> DataFrame:
    """Deterministic isolation score — the limit of infinitely many random
    1-D trees without a height limit.

    For sorted distinct values d₁<…<d_m, a point at d_k has expected depth
    Σ_{j≥k} g_j/(d_{j+1}−d_k) + Σ_{j<k} g_j/(d_k−d_j) + c(multiplicity), with
    g_j = d_{j+1}−d_j. Computed per series in an Arrow-batched UDF, in parallel over
    series: in blocks of a numpy matrix, or for many distinct values by moments of
    runs, with exact sums for the values that decide; no pair rows are emitted. Not a substitute for D3 (no height limit), but reproducible and
    SQL-checkable.
    """
    return series.withColumn("_x", _expected_udf(F.col(values))).select("*", "_x.*").drop("_x")


# ----------------------------------------------------------------------------- D6
def to_anomaly_events(detections: DataFrame, keys=("tenant_id", "name"), ts: str = "last_ts",
                      only_anomalies: bool = True) -> DataFrame:
    """Detections → the anomaly stream rows the rule engine consumes
    (tenant_id, metric_name, anomaly_score, ts, context JSON)."""
    d = detections.filter(F.col("is_anomaly")) if only_anomalies else detections
    t = F.col(ts)
    t = F.timestamp_seconds(t) if dict(detections.dtypes).get(ts) in ("bigint", "int") else t
    ctx = F.to_json(F.struct(F.col("anomaly_score"), F.col("is_anomaly"), F.col(keys[1]).alias("metric_name"),
                             F.col(keys[0]).alias("tenant_id")))
    aid = F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.unix_seconds(t).cast("string"))
    return d.select(aid.alias("anomaly_id"),
                    F.col(keys[0]).alias("tenant_id"), F.col(keys[1]).alias("metric_name"),
                    "anomaly_score", t.alias("ts"), ctx.alias("context"))


# ----------------------------------------------------------------------------- D5
MODEL_DDL = "breaks ARRAY<DOUBLE>, paths ARRAY<BIGINT>, psi BIGINT"
#: A series of more than so many times the pool is thinned by hash before the shuffle.
POOL_SHARE = 4


def forest_step_function(sample: np.ndarray, trees: int = IFOREST_TREES, seed: int = 42,
                         max_samples: int = IFOREST_MAX_SAMPLES):
    """Mean path length of a forest fitted on ``sample`` as a step function of
    the value: sorted ``breaks`` and ``paths`` (len(breaks) + 1 pieces). Every
    tree draws its own ``max_samples`` values."""
    pool = np.sort(np.asarray(sample, dtype=float))
    psi = min(max_samples, len(pool))
    limit = int(math.ceil(math.log2(max(psi, 2))))
    rng = np.random.default_rng(seed)
    all_bounds, per_tree = [], []
    for _ in range(trees):
        s = pool if psi == len(pool) else np.sort(rng.choice(pool, psi, replace=False))
        bounds, leaf_len = [], []
        stack = [(0, psi, 0)]
        while stack:
            lo, hi, d = stack.pop()
            size = hi - lo
            if d >= limit or size <= 1 or s[lo] == s[hi - 1]:
                leaf_len.append(d + float(c_factor([size])[0]))
                continue
            thr = rng.uniform(s[lo], s[hi - 1])
            mid = lo + int(np.searchsorted(s[lo:hi], thr, side="right"))
            stack.append((mid, hi, d + 1))
            stack.append((lo, mid, d + 1))
            bounds.append(thr)
        b = np.sort(np.asarray(bounds))
        per_tree.append((b, np.asarray(leaf_len)))
        all_bounds.append(b)
    breaks = np.unique(np.concatenate(all_bounds)) if all_bounds else np.array([])
    # evaluate each tree on one probe per piece: a break itself belongs to the left piece
    probes = np.concatenate([breaks, [np.inf]]) if len(breaks) else np.array([0.0])
    total = np.zeros(len(probes))
    for b, ll in per_tree:
        total += ll[np.searchsorted(b, probes, side="left")]
    return breaks, total / trees, psi


def _series_key(keys) -> Column:
    return F.concat_ws("\u001f", *[F.col(k).cast("string") for k in keys])


def fit_isolation(metrics: DataFrame, keys=("tenant_id", "name"), value: str = "value", id_cols=("timestamp",),
                  max_samples: int = IFOREST_MAX_SAMPLES, trees: int = IFOREST_TREES) -> DataFrame:
    """D5 fit: per series a forest whose trees each draw ``max_samples`` rows, with its number of rows n.

    They draw from the ``trees * max_samples`` rows of least hash. Of a series of more than
    ``POOL_SHARE`` times as many, rows beyond a hash that about so many reach are left out before
    the shuffle, so that no task sorts a hot series; of the others each task sends at most the
    pool (``row_number() <= n`` is a WindowGroupLimit: see ``session``). A model of a series that
    the pool holds whole has one step a distinct value."""
    keys, pool = list(keys), trees * max_samples
    h = F.conv(F.substring(F.md5(F.concat_ws("\u001f", *[F.col(c).cast("string") for c in [*keys, *id_cols]])), 1, forest.HASH_DIGITS), 16, 10).cast("bigint")
    counts = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = _fresh(metrics).join(broadcast_if_small(_fresh(counts)), keys, "inner").withColumn("_h", h)
    most = POOL_SHARE * pool
    near = rows.where((F.col("_n") <= most) | (F.col("_h") < 16.0**forest.HASH_DIGITS * most / F.col("_n")))
    w = Window.partitionBy(*keys).orderBy("_h", *id_cols, value)
    samp = near.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= pool)
    g = samp.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("_sample"),
                                F.max("_n").alias("n"))

    @F.pandas_udf(MODEL_DDL)
    def fit(samples: pd.Series, key: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for s, k, rows in zip(samples, key, n):
            model = forest.fit(s, k, trees, max_samples)
            out.append(forest.at_values(model, np.unique(s)) if len(s) == rows else model)
        return pd.DataFrame({"breaks": [m[0] for m in out], "paths": [m[1] for m in out], "psi": [m[2] for m in out]})

    # so many tasks as asked for: a merged one would fit every series alone
    spread = g.repartition(int(metrics.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return spread.select(*keys, "n", fit(F.col("_sample"), _series_key(keys), F.col("n")).alias("m")).select(*keys, "n", F.lit(trees).alias("trees"), "m.*")


def _fresh(df: DataFrame) -> DataFrame:
    """New attribute ids, for joins of two sides that derive from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _score_rows(metrics: DataFrame, models: DataFrame, keys, value: str, id_cols,
                rows_per_group: int = 200_000) -> DataFrame:
    """Every row with its ``score_samples``.

    Rows are salted into ⌈rows/rows_per_group⌉ groups per series and the
    series' model is replicated to each salt, so the cogroup never puts a hot
    series in one task."""
    keys, fresh = list(keys), _fresh
    salted = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / rows_per_group)).cast("int")
    models = fresh(models).withColumn("_salts", salted("n"))
    counts = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, salted("_n").alias("_salts"))
    rows = fresh(metrics).join(broadcast_if_small(fresh(counts)), keys, "inner").withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in keys + list(id_cols)], F.col(value)), F.col("_salts")).cast("int"))
    mods = models.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    in_cols = metrics.columns
    tasks = int(metrics.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def score(rpdf: pd.DataFrame, mpdf: pd.DataFrame) -> pd.DataFrame:
        if rpdf.empty:
            return pd.DataFrame(columns=in_cols + ["score_samples"])
        m = mpdf.iloc[0]
        breaks, paths = np.asarray(m["breaks"], dtype=float), np.asarray(m["paths"], dtype=np.int64)
        h = paths[np.searchsorted(breaks, rpdf[value].to_numpy(dtype=float), side="left")] / forest.UNIT / int(m["trees"])
        out = rpdf[in_cols].copy()
        out["score_samples"] = -np.power(2.0, -h / float(c_factor([int(m["psi"])])[0])) if m["psi"] > 1 else -1.0
        return out

    schema = T.StructType(list(metrics.schema.fields) + [T.StructField("score_samples", T.DoubleType())])
    return (rows.repartition(tasks, *keys, "_salt").groupBy(*keys, "_salt")
            .cogroup(mods.repartition(tasks, *keys, "_salt").groupBy(*keys, "_salt")).applyInPandas(score, schema))


def score_isolation(metrics: DataFrame, models: DataFrame, keys=("tenant_id", "name"), value: str = "value",
                    id_cols=("timestamp",), rows_per_group: int = 200_000,
                    contamination: float = IFOREST_CONTAMINATION) -> DataFrame:
    """D5 score: every row of every series gets ``anomaly_score``/``is_anomaly``.

    The threshold is the exact ``contamination`` quantile of the series' scores;
    a forest is a step function, so a series has a bounded number of them."""
    keys = list(keys)
    scored = _score_rows(metrics.where(F.col(value).isNotNull()), models, keys, value, id_cols, rows_per_group)
    offs = scored.groupBy(*keys).agg(F.percentile("score_samples", contamination).alias("_offset"))
    j = _fresh(scored).join(_fresh(offs), keys, "inner")
    decision = F.col("score_samples") - F.col("_offset")
    return j.select(*metrics.columns, (F.lit(0.5) - decision).alias("anomaly_score"), (decision < 0).alias("is_anomaly"))
