"""Prometheus text exposition → (name, labels, value) samples.

Blank and ``#`` lines are skipped; a line splits on single spaces into at
most three parts (the third, a timestamp, is ignored); the value must be a
float literal; labels split on ',' then the first '='. Malformed lines are
dropped, never raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import utrim

FLOAT_RE = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


def _labels(lpart: Column) -> Column:
    pairs = F.filter(F.transform(F.split(lpart, ","), lambda p: utrim(p)), lambda p: F.locate("=", p) > 0)
    entries = F.transform(pairs, lambda p: F.struct(
        utrim(F.substring_index(p, "=", 1)).alias("key"),
        F.trim(utrim(F.substring(p, F.locate("=", p) + 1, 1 << 30)), F.lit('"')).alias("value")))
    return F.map_from_entries(entries)


def parse_exposition(df: DataFrame, col: str = "exposition") -> DataFrame:
    """Explode ``col`` into one row per valid sample: ``sample_no, name, labels, value``."""
    lines = F.split(F.col(col), "\n")
    x = df.select("*", F.posexplode(lines).alias("sample_no", "_l"))
    line = utrim(F.col("_l"))
    x = x.withColumn("_l", line).filter((F.col("_l") != "") & ~F.col("_l").startswith("#"))
    parts = F.split(F.col("_l"), " ", 3)
    x = x.withColumn("_p", parts)
    nl = F.col("_p")[0]
    vs = F.element_at(F.col("_p"), 2)
    brace = F.locate("{", nl)  # 1-based, 0 when absent
    n_len = F.length(nl)
    valid = (F.size("_p") >= 2) & vs.rlike(FLOAT_RE) & ((brace == 0) | (brace < n_len))
    name = F.when(brace == 0, nl).otherwise(F.substring(nl, 1, brace - 1))
    lpart = F.substring(nl, brace + 1, n_len - 1 - brace)
    labels = F.when(brace == 0, F.create_map().cast("map<string,string>")).otherwise(_labels(lpart))
    out = x.filter(valid).select(
        *[c for c in df.columns], "sample_no",
        name.alias("name"), labels.alias("labels"),
        F.expr("if(lower(element_at(_p, 2)) in ('+nan', '-nan'), double('NaN'), try_cast(element_at(_p, 2) as double))").alias("value"))
    return out
