"""Column-level building blocks (JVM-side expressions, no Python UDFs)."""

from .text import utrim, normalize_level, level_rank, contains_ci  # noqa: F401
from .vectors import dot, l2_norm, cosine, l2_normalize  # noqa: F401
from .timefn import epoch_seconds, epoch_micros, yyyymm, to_utc_timestamp_ntz  # noqa: F401
