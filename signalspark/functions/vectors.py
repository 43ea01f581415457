"""Vector math as higher-order SQL functions (stay inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Dot product of two equal-length numeric arrays, in double precision."""
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a) -> Column:
    """Unit-length copy of ``a`` as ``array<double>``; a zero vector stays zero.

    The norm is computed once per row outside any lambda (``array_repeat``)
    so the cost stays O(d), not O(d²).
    """
    n = l2_norm(a)
    return F.zip_with(_c(a), F.array_repeat(n, F.size(_c(a))),
                      lambda x, m: F.when(m > 0, x.cast("double") / m).otherwise(F.lit(0.0)))


def cosine(a, b) -> Column:
    """Cosine similarity; NULL when either vector has zero length."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, dot(a, b) / den)
