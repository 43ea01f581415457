"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024
#: Estimate of inputs whose size the optimizer does not know, and rows that they may have to be broadcast.
UNKNOWN_BYTES, MAX_BROADCAST_ROWS = 1 << 62, 20_000


def estimated_size_bytes(df: DataFrame) -> int | None:
    """Optimizer's size estimate of ``df`` (None when unavailable)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # pragma: no cover - non-classic sessions
        return None


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimated size is within ``max_bytes``.

    Otherwise the plan is left to the planner and AQE, which fall back to a
    shuffled join (and re-plan to broadcast at runtime if the side turns out
    small), so a side that grows with the data is never forced into memory.
    """
    size = estimated_size_bytes(df)
    if size is None or size >= UNKNOWN_BYTES:  # rows made on the driver, say: a bounded count decides
        return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df
    if size <= max_bytes:
        return F.broadcast(df)
    return df
