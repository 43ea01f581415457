"""Per-tenant token-bucket admission.

Bucket semantics: capacity C tokens, refilled continuously at R tokens per
period, capped at C; a new tenant starts full; a request is admitted if at
least one token is present after the refill and then spends one token; a
denied request spends nothing. One token per *request*.

Arithmetic is integral: one token = ``period_us`` units and the refill adds
``R`` units per elapsed microsecond, so decisions never depend on float
rounding and the SQL oracle agrees exactly.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_ADMISSION_LIMIT
from ..plans.joins import broadcast_if_small
from ..plans.ordered_scan import Kernel, ordered_scan


class TokenBucketKernel(Kernel):
    out_ddl = "admitted BOOLEAN, tokens_units BIGINT"

    def __init__(self, time_col: str = "_t"):
        self.t = time_col

    @staticmethod
    def _params(rows: pd.DataFrame):
        return int(rows["_cap"].iloc[0]), int(rows["_rate"].iloc[0]), int(rows["_cost"].iloc[0])

    def fold(self, rows, entry):
        cap, rate, cost = self._params(rows)
        t = rows[self.t].to_numpy(dtype=np.int64)
        n = len(t)
        adm = np.zeros(n, dtype=bool)
        tok = np.zeros(n, dtype=np.int64)
        if entry is None:
            y = cap
        else:
            y = min(cap, int(entry["exit"]) + (int(t[0]) - int(entry["t"])) * rate)
        s = 0
        for i in range(n):
            if i:
                y = min(cap, s + (int(t[i]) - int(t[i - 1])) * rate)
            if y >= cost:
                s = y - cost
                adm[i] = True
            else:
                s = y
            tok[i] = s
        return {"admitted": adm, "tokens_units": tok}, int(s)

    def transfer(self, rows):
        """Exit state as a piecewise function of y0 = tokens after the first
        refill, y0 ∈ [0, cap]: pieces [lo, hi, kind, v] with state = y0 + v
        (kind 0) or the constant v (kind 1)."""
        cap, rate, cost = self._params(rows)
        t = rows[self.t].to_numpy(dtype=np.int64)
        pieces = [[0, cap, 0, 0]]
        for i in range(len(t)):
            if i:
                a = (int(t[i]) - int(t[i - 1])) * rate
                nxt = []
                for lo, hi, kind, v in pieces:
                    if kind == 1:
                        nxt.append([lo, hi, 1, min(cap, v + a)])
                        continue
                    cut = cap - v - a  # y0 >= cut saturates at cap
                    if cut > lo:
                        nxt.append([lo, min(hi, cut - 1), 0, v + a])
                    if cut <= hi:
                        nxt.append([max(lo, cut), hi, 1, cap])
                pieces = nxt
            nxt = []
            for lo, hi, kind, v in pieces:
                if kind == 1:
                    nxt.append([lo, hi, 1, v - cost if v >= cost else v])
                    continue
                cut = cost - v  # y0 >= cut is admitted
                if cut > lo:
                    nxt.append([lo, min(hi, cut - 1), 0, v])
                if cut <= hi:
                    nxt.append([max(lo, cut), hi, 0, v - cost])
            # merge neighbouring pieces that now agree (same kind and value):
            # paths that admitted at different times re-converge, which keeps
            # the piece count small instead of growing with the segment
            merged = []
            for pc in nxt:
                if merged and merged[-1][2] == pc[2] and merged[-1][3] == pc[3] and merged[-1][1] + 1 == pc[0]:
                    merged[-1][1] = pc[1]
                else:
                    merged.append(pc)
            pieces = merged
        return {"cap": cap, "rate": rate, "pieces": pieces}

    def apply(self, fn, prev_exit, prev_t, first_t):
        cap, rate = fn["cap"], fn["rate"]
        y0 = cap if prev_exit is None else min(cap, int(prev_exit) + (int(first_t) - int(prev_t)) * rate)
        los = [p[0] for p in fn["pieces"]]
        lo, hi, kind, v = fn["pieces"][bisect.bisect_right(los, y0) - 1]
        return y0 + v if kind == 0 else v


def _period_us(period: str | int | float) -> int:
    if isinstance(period, (int, float)):
        return int(period * 1_000_000)
    num, unit = period.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
            "day": 86400, "days": 86400}[unit]
    return int(float(num) * mult * 1_000_000)


def admit(requests: DataFrame, key: str = "tenant_id", ts: str = "ts", id_col: str = "event_id",
          capacity: int = DEFAULT_ADMISSION_LIMIT, refill: int | None = None, period="1 second",
          limits: DataFrame | None = None, limit_col: str = "ingest_rate_per_second",
          num_partitions: int | None = None) -> DataFrame:
    """Add ``admitted`` and ``tokens_units`` to every request row.

    ``limits`` (A11) is a per-key override table (``key``, ``limit_col``):
    capacity = refill = the override when present, else the defaults.
    """
    refill = capacity if refill is None else refill
    p_us = _period_us(period)
    df = requests
    cap = F.lit(capacity).cast("bigint")
    rate = F.lit(refill).cast("bigint")
    if limits is not None:
        lim = limits.select(F.col(key), F.col(limit_col).cast("bigint").alias("_limit"))
        df = df.join(broadcast_if_small(lim), key, "left")
        cap = F.coalesce(F.col("_limit"), cap)
        rate = F.coalesce(F.col("_limit"), rate)
    df = df.select(*requests.columns,
                   F.unix_micros(F.col(ts)).alias("_t"),
                   (cap * F.lit(p_us)).alias("_cap"), rate.alias("_rate"), F.lit(p_us).cast("bigint").alias("_cost"))
    out = ordered_scan(df, key, "_t", id_col, TokenBucketKernel("_t"), num_partitions)
    return out.drop("_t", "_cap", "_rate", "_cost")


def admit_reference(rows, capacity, refill, period_us):
    """Plain sequential token bucket over (key, t_us) pairs, for tests."""
    cap, cost = capacity * period_us, period_us
    state, out = {}, []
    for k, t in rows:
        if k not in state:
            y = cap
        else:
            s, pt = state[k]
            y = min(cap, s + (t - pt) * refill)
        if y >= cost:
            s, ok = y - cost, True
        else:
            s, ok = y, False
        state[k] = (s, t)
        out.append(ok)
    return out
