"""Connected components of an edge table, as rounds of Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import stored
from signalspark.session import checkpoint_dir, ship_package

#: Edges that a task merges at a time.
MERGE_EDGES = 1_000_000
#: Edges (16 bytes each) for which a round takes one more task.
TASK_EDGES = 250_000


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, part by part, as stars around the least id that the part's edges reach."""
    held: list[pa.RecordBatch] = []

    def star() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b, root = place[:len(u)], place[len(u):], np.arange(len(ids))
        while (root[a] != root[b]).any():
            least = np.minimum(root[a], root[b])
            for end in (root[a], root[b]):
                np.minimum.at(root, end, least)
            while (root[root] != root).any():
                root = root[root]
        held.clear()
        far = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], ["u", "v"])
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= MERGE_EDGES:
            yield star()
    if held:
        yield star()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of the edges (a, b): root is the component's least id.

    Tasks first merge the edges that they hold, as they come and again in as few tasks as their
    number asks for; then alternating large and small stars (Kiveris et al., 2014): every round
    links neighbours to the least one they know, until all edges point at roots. Rounds grow with
    the logarithm of the diameter. Each round is checkpointed into the shared folder; only a
    count and a checksum reach the driver. Null ends and loops are dropped."""
    checkpoint_dir(edges.sparkSession)
    e = (edges.where("a is not null and b is not null and a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    few = lambda e, state: e.coalesce(state[0] // TASK_EDGES + 1)
    if dict(e.dtypes) == {"u": "bigint", "v": "bigint"}:
        ship_package(e.sparkSession)
        merge = lambda e: e.mapInArrow(_merged, "u long, v long").distinct()
        e = stored(merge(e))
        e = merge(few(e, _state(e))).checkpoint()
    else:
        e = e.distinct().checkpoint()
    state = _state(e)
    while state[0]:
        # no unions: what fits one task stays there, without a shuffle
        both = few(e, state).select(F.expr("inline(array(named_struct('u', u, 'v', v), named_struct('u', v, 'v', u)))"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # the least neighbour of u is bound to u, all others to the least one
        e = (large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
             .distinct().checkpoint())
        state, before = _state(e), state
        if state == before:
            break
    e = few(e, state)
    roots = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v"), F.col("v")).distinct())
