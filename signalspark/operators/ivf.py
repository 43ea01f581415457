"""An inverted-file vector index — unit vectors stored by cell, few cells read a search.

Cells are the regions of spherical k-means centroids, fitted on a bounded sample; every row is
stored in the cell of its nearest centroid, a folder that a search opens only if it probes it.
Candidates are ranked by their exact cosine, so a search of all cells is exact. How many cells a
search probes by default is measured when the index is built: as few as reach the asked recall.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import SEARCH_LIMIT
from ..functions.vectors import dot, l2_normalize
from ..session import ship_package
from .query import clamp_limit
from .vectors import semantic_search_batch

#: Rows a cell that the centroids are fitted on, cells at most, rounds of k-means.
SAMPLE_PER_CELL, MAX_CELLS, ROUNDS = 64, 4096, 12
#: Stored rows that recall is measured with, neighbours asked for, and the recall to reach.
PROBE_QUERIES, PROBE_K, RECALL = 128, 10, 0.95


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from evenly drawn rows; a cell that loses all rows keeps its centroid."""
    at = sample[:: max(1, len(sample) // cells)][:cells].copy()
    for _ in range(ROUNDS):
        near = (sample @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        some = np.linalg.norm(sums, axis=1) > 0
        at[some] = _unit(sums[some])
    return at


def _least_hashes(vectors: DataFrame, n: int) -> list:
    return vectors.orderBy(F.xxhash64("id"), "id").limit(n).select("id", "unit").collect()


class IvfIndex:
    """An index in a folder: ``rows/cell=<cell>`` and ``about`` (centroids and the default probes)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        told = json.loads(spark.read.text(f"{self.path}/about").first().value)
        self.centroids, self.probes, self.recall = np.array(told["centroids"]), told["probes"], told["recall"]

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def nearest_cells(self, qvec) -> list[int]:
        q = np.asarray(qvec, dtype=float)
        return np.argsort(-(self.centroids @ q), kind="stable").tolist()

    def search(self, qvec, k: int | None = None, tenant_id: str | None = None, probes: int | None = None) -> DataFrame:
        """Top-k by cosine among the rows of the ``probes`` nearest cells (ties by id)."""
        k = clamp_limit(k, *SEARCH_LIMIT)
        cells = self.nearest_cells(qvec)[:probes or self.probes]
        q = np.asarray(qvec, dtype=float)
        q = q / max(float(np.linalg.norm(q)), 1e-300)
        found = self.rows.where(F.col("cell").isin(cells))
        if tenant_id is not None:
            found = found.where(F.col("tenant_id") == tenant_id)
        score = dot("unit", F.array(*[F.lit(float(x)) for x in q]))
        return found.withColumn("score", score).drop("unit", "cell").orderBy(F.col("score").desc(), "id").limit(k)


def build_ivf(vectors: DataFrame, path: str, cells: int | None = None, vector_col: str = "vector", recall: float = RECALL) -> IvfIndex:
    """Index ``vectors`` (id, tenant_id, …, ``vector_col``) under ``path``, replacing what is there.

    ``cells`` defaults to the square root of the rows, MAX_CELLS at most. Rows without a vector are
    left out; a zero vector has cosine 0 with all."""
    spark = vectors.sparkSession
    ship_package(spark)
    path = path.rstrip("/")
    units = vectors.where(F.col(vector_col).isNotNull()).withColumn("unit", l2_normalize(vector_col)).drop(vector_col)
    n = units.count()
    cells = max(1, min(cells or int(n ** 0.5), MAX_CELLS, n))
    sample = np.array([r.unit for r in _least_hashes(units, cells * SAMPLE_PER_CELL)]).reshape(min(n, cells * SAMPLE_PER_CELL), -1)
    at = _centroids(sample, cells) if n else np.zeros((1, 1))
    place = units.columns.index("unit")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(place).to_pylist(), dtype=float).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((x @ at.T).argmax(1).astype(np.int32))], [*b.schema.names, "cell"])

    schema = T.StructType([*units.schema.fields, T.StructField("cell", T.IntegerType())])
    dealt = units.mapInArrow(assign, schema)
    # a hot cell spreads over tasks: rows go by cell and hash, a cell's files stay few
    spread = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 100_000)))
    dealt.repartition(spread, "cell", F.pmod(F.xxhash64("id"), F.lit(spread))).sortWithinPartitions("cell", "tenant_id", "id") \
        .write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    probes, reached = _probes(spark.read.parquet(f"{path}/rows"), at, recall) if n else (1, 1.0)
    told = json.dumps({"centroids": at.tolist(), "probes": probes, "recall": reached})
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return IvfIndex(spark, path)


def _probes(rows: DataFrame, at: np.ndarray, recall: float) -> tuple[int, float]:
    """Cells to probe for ``recall`` of the true neighbours in the query's tenant, whose rows lie
    farther apart than all rows do. Queries are stored rows and, as queries need not be like
    rows, midpoints of pairs of them; the worse kind decides."""
    spark = rows.sparkSession
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(PROBE_QUERIES).select("id", "tenant_id", "unit").collect()
    middle = [(a.unit, b.unit) for a, b in zip(drawn, drawn[1:])]
    asked = {f"r{n}": (r.tenant_id, r.unit) for n, r in enumerate(drawn)}
    asked |= {f"m{n}": (r.tenant_id, [x + y for x, y in zip(*pair)]) for n, (r, pair) in enumerate(zip(drawn, middle))}
    queries = spark.createDataFrame([(q, t, [float(x) for x in v]) for q, (t, v) in asked.items()], "query_id string, tenant_id string, qvector array<double>")
    true = semantic_search_batch(rows.select("id", "tenant_id", F.col("unit").alias("vector")), queries, k=PROBE_K)
    found = true.join(rows.select("id", "cell"), "id").select("query_id", "cell").collect()
    order = {q: np.argsort(np.argsort(-(at @ np.array(v)), kind="stable")) for q, (_, v) in asked.items()}
    need = 1
    ranks = {kind: np.sort([int(order[r.query_id][r.cell]) for r in found if r.query_id[0] == kind]) for kind in "rm"}
    for some in ranks.values():
        if len(some):
            need = max(need, int(some[int(np.ceil(recall * len(some))) - 1]) + 1)
    return need, float(min((some < need).mean() if len(some) else 1.0 for some in ranks.values()))
