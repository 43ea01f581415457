"""Side-by-side check of a registered query against its DuckDB statement.

Mirrors the driver's gate: same row count, same column names, and the same
multiset of rows after rounding floats. Used by the tests and as a CLI:
``python -m signalspark.plans.check /root/testdata/sf0.01 [name ...]``.
"""

from __future__ import annotations

import math
import sys

import pandas as pd

from ..sources.tables import TABLES


def duckdb_run(sql: str, base: str) -> pd.DataFrame:
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet')")
    return con.execute(sql).df()


def _norm_value(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm_value(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and not isinstance(v, str)):
        return tuple(_norm_value(x) for x in (v.tolist() if hasattr(v, "tolist") else v))
    return v


def normalize(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm_value(x) for x in rec))
    rows.sort(key=lambda r: tuple("" if x is None else str(x) for x in r))
    return rows


def compare(spark, name: str, base: str) -> dict:
    from .oracle import ORACLE
    from .registry import QUERIES
    sdf = QUERIES[name](spark, base).toPandas()
    ddf = duckdb_run(ORACLE[name], base)
    res = {"name": name, "spark_rows": len(sdf), "oracle_rows": len(ddf),
           "columns_match": sorted(sdf.columns) == sorted(ddf.columns)}
    if not res["columns_match"]:
        res["spark_cols"], res["oracle_cols"] = sorted(sdf.columns), sorted(ddf.columns)
        res["match"] = False
        return res
    a, b = normalize(sdf), normalize(ddf)
    res["match"] = a == b
    if not res["match"]:
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        res["only_spark"], res["only_oracle"] = diff_a, diff_b
    return res


def main(argv: list[str]) -> int:
    from ..session import get_spark
    from .oracle import ORACLE
    base = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(ORACLE)
    spark = get_spark(shuffle_partitions=8)
    bad = 0
    for n in names:
        import time
        t0 = time.time()
        try:
            r = compare(spark, n, base)
        except Exception as e:  # report and continue
            r = {"name": n, "match": False, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += not r["match"]
        r["sec"] = round(time.time() - t0, 1)
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
