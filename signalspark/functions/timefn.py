"""Time helpers: whole-second epochs, month partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_utc_timestamp_ntz(c) -> Column:
    """Read a ``TIMESTAMP_NTZ`` column as a UTC instant (session zone is UTC)."""
    return _c(c).cast("timestamp")


def epoch_seconds(c) -> Column:
    """Whole seconds since the epoch (``toUnixTimestamp``), BIGINT."""
    return F.unix_seconds(_c(c)).cast("bigint")


def epoch_micros(c) -> Column:
    return F.unix_micros(_c(c)).cast("bigint")


def yyyymm(c) -> Column:
    """Month partition key (``toYYYYMM``) as INT, from a timestamp."""
    return (F.year(_c(c)) * 100 + F.month(_c(c))).cast("int")
