"""Exact, parallel ordered fold per key (token buckets, cooldowns).

Some operators depend on every earlier decision of the same key, so no window
function expresses them. A plain ``groupBy(key).applyInPandas`` would put a
hot key (a third of all rows) into one task. Instead:

1. ``repartitionByRange(n, key, order…)`` splits the key/time space into
   balanced partitions (sampled bounds), so a hot key spans many partitions;
   the result is checkpointed to the shared checkpoint folder, which fixes
   partition membership and cuts lineage.
2. Each partition summarises itself (``mapInPandas``): for its *first* key
   segment a compact transfer function entry-state → exit-state, and for its
   last segment the exit state from a fresh start. One row per partition.
3. The summaries (≤ n rows, a proven bound) are composed in partition order
   in one small group, giving each partition the true entry state of its first
   segment.
4. The entry table is broadcast (≤ n rows) onto the checkpointed data, whose
   range partitioning and order are preserved, and every partition folds its
   rows in parallel from the right entry state.

A kernel supplies ``fresh / fold / summarise_first / apply_fn``; see
``operators.admission`` and ``operators.alerting`` for the two kernels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir

SUMMARY_DDL = ("_blk INT, first_key STRING, first_t BIGINT, first_last_t BIGINT, fn STRING, "
               "single BOOLEAN, last_key STRING, last_t BIGINT, last_exit STRING")
ENTRY_DDL = "_blk INT, _entry STRING"


class Kernel:
    """Interface of a sequential per-key fold over rows sorted by time."""

    out_ddl: str = ""

    def fold(self, rows: pd.DataFrame, entry) -> tuple[dict, object]:
        """Fold one key segment from ``entry`` (None = key starts here).
        Returns (output columns as arrays, exit state)."""
        raise NotImplementedError

    def transfer(self, rows: pd.DataFrame):
        """Compact function of the entry state for a segment whose key may
        continue from an earlier partition (JSON-serialisable)."""
        raise NotImplementedError

    def apply(self, fn, prev_exit, prev_t: int, first_t: int):
        """Exit state of a segment given its transfer function and the
        previous exit state/time of the same key."""
        raise NotImplementedError

    def entry_from(self, prev_exit, prev_t: int):
        """Entry state handed to ``fold`` for a continuing key."""
        return {"exit": prev_exit, "t": prev_t}


def _segments(keys: pd.Series):
    """(start, end) index ranges of equal consecutive keys."""
    if len(keys) == 0:
        return []
    codes, _ = pd.factorize(keys)  # all nulls are one key
    starts = [0, *((codes[1:] != codes[:-1]).nonzero()[0] + 1).tolist()]
    ends = starts[1:] + [len(keys)]
    return list(zip(starts, ends))


def _name(key) -> str:
    """A key as text, null apart from any other."""
    return "null" if pd.isna(key) else f"={key}"


def ordered_scan(df: DataFrame, key: str, time_col: str, tiebreak: str, kernel: Kernel,
                 num_partitions: int | None = None) -> DataFrame:
    """Run ``kernel`` over ``df`` ordered by (``time_col``, ``tiebreak``) within ``key``.

    ``time_col`` must be integral (e.g. epoch microseconds). Returns every
    input column plus the kernel's output columns. Rows of a null key follow one another as those
    of any key.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(num_partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    x = (df.repartitionByRange(n, key, time_col, tiebreak)
           .sortWithinPartitions(key, time_col, tiebreak)
           .withColumn("_blk", F.spark_partition_id()))
    x = x.checkpoint(eager=True)
    in_schema = x.schema

    def summarise(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in it if len(b)]
        if not parts:
            return
        p = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        segs = _segments(p[key])
        s0, e0 = segs[0]
        first = p.iloc[s0:e0]
        fn = kernel.transfer(first)
        ls, le = segs[-1]
        last = p.iloc[ls:le]
        if len(segs) > 1:
            _, last_exit = kernel.fold(last, None)
        else:
            last_exit = None
        yield pd.DataFrame({
            "_blk": [int(p["_blk"].iloc[0])], "first_key": [_name(p[key].iloc[0])],
            "first_t": [int(first[time_col].iloc[0])], "first_last_t": [int(first[time_col].iloc[-1])],
            "fn": [json.dumps(fn)], "single": [len(segs) == 1], "last_key": [_name(p[key].iloc[-1])],
            "last_t": [int(last[time_col].iloc[-1])], "last_exit": [json.dumps(last_exit)]})

    summaries = x.mapInPandas(summarise, SUMMARY_DDL)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        carry_key, carry_exit, carry_t = None, None, None
        out_blk, out_entry = [], []
        for r in pdf.to_dict("records"):
            fn = json.loads(r["fn"])
            if carry_key is not None and r["first_key"] == carry_key:
                entry = kernel.entry_from(carry_exit, carry_t)
                first_exit = kernel.apply(fn, carry_exit, carry_t, r["first_t"])
                out_blk.append(r["_blk"])
                out_entry.append(json.dumps(entry))
            else:
                first_exit = kernel.apply(fn, None, None, r["first_t"])
            if r["single"]:
                carry_key, carry_exit, carry_t = r["first_key"], first_exit, r["first_last_t"]
            else:
                carry_key, carry_exit, carry_t = r["last_key"], json.loads(r["last_exit"]), r["last_t"]
        return pd.DataFrame({"_blk": pd.Series(out_blk, dtype="int32"),
                             "_entry": pd.Series(out_entry, dtype="object")})

    # one group of at most n summary rows (one per partition)
    entries = summaries.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(compose, ENTRY_DDL)

    # at most one row per partition: a broadcast whose size is bounded by n
    joined = x.join(F.broadcast(entries), "_blk", "left")
    out_schema = StructType(list(in_schema.fields) + list(StructType.fromDDL(kernel.out_ddl).fields))
    out_cols = [f.name for f in out_schema.fields]

    def apply_part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in it if len(b)]
        if not parts:
            return
        p = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        entry0 = p["_entry"].iloc[0]
        entry0 = json.loads(entry0) if isinstance(entry0, str) else None
        cols = {}
        for i, (s, e) in enumerate(_segments(p[key])):
            res, _ = kernel.fold(p.iloc[s:e], entry0 if i == 0 else None)
            for k, v in res.items():
                cols.setdefault(k, []).append(pd.Series(v))
        out = p.drop(columns=["_entry"]).copy()
        for k, v in cols.items():
            out[k] = pd.concat(v, ignore_index=True).to_numpy()
        yield out[out_cols]

    return joined.mapInPandas(apply_part, out_schema).drop("_blk")
