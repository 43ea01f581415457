"""String functions with the reference's exact semantics, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_LEVEL, LEVEL_SPELLINGS, LEVELS, WS_CHARS

WS = f"[{WS_CHARS}]"
_TRIM_RE = f"^{WS}+|{WS}+\\z"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c) -> Column:
    """Trim Unicode white space at both ends (Spark's ``trim`` strips spaces only)."""
    return F.regexp_replace(_c(c), _TRIM_RE, "")


def normalize_level(c) -> Column:
    """Map a loose level spelling to one of the six canonical levels; else INFO."""
    u = F.upper(utrim(_c(c)))
    expr = None
    for level, spellings in LEVEL_SPELLINGS.items():
        cond = u.isin(*spellings)
        expr = F.when(cond, F.lit(level)) if expr is None else expr.when(cond, F.lit(level))
    return expr.otherwise(F.lit(DEFAULT_LEVEL))


def level_rank(c) -> Column:
    """0-based severity rank of a canonical level (TRACE=0 … FATAL=5), NULL if unknown."""
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), _c(c)).cast("int") - 1


def contains_ci(c, needle: str) -> Column:
    """Case-insensitive substring test (``positionCaseInsensitive(s, q) > 0``).

    ASCII letters are folded, as in the reference store; other characters
    compare exactly.
    """
    upper_ascii = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower_ascii = upper_ascii.lower()
    folded = F.translate(_c(c), upper_ascii, lower_ascii)
    return F.contains(folded, F.lit(needle.translate(str.maketrans(upper_ascii, lower_ascii))))
