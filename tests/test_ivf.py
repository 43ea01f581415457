"""Recall at the default probes, exactness of all cells; C7 in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.operators import vectors as VC
from signalspark.operators.ivf import build_ivf
from signalspark.plans import registry as R
from conftest import SF01


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(25, 16))
    rows = [(f"{i:05d}", f"t{i % 3}", [float(x) for x in centres[i % 25] + 0.35 * rng.normal(size=16)]) for i in range(4000)]
    rows += [("zero", "t0", [0.0] * 16), ("same1", "t0", rows[0][2]), ("same0", "t0", rows[0][2]), ("none", "t0", None)]
    return spark.createDataFrame(rows, "id string, tenant_id string, vector array<double>").repartition(4).cache()


def test_recall_and_exactness(spark, clustered, tmp_path):
    index = build_ivf(clustered, str(tmp_path))
    cells = len(index.centroids)
    assert cells == int(4003 ** 0.5) and index.recall >= 0.95 and index.probes < cells / 2
    assert index.rows.count() == 4003
    rng = np.random.default_rng(9)
    hit = total = 0
    for n in range(20):
        q = [float(x) for x in rng.normal(size=16)] if n % 2 else list(clustered.where(F.col("id") == f"{n:05d}").first().vector)
        true = [(r.id, round(r.score, 9)) for r in VC.semantic_search(clustered.where("vector is not null"), q, "t0", 10).collect()]
        assert [(r.id, round(r.score, 9)) for r in index.search(q, 10, "t0", probes=cells).collect()] == true
        got = {r.id for r in index.search(q, 10, "t0").collect()}
        hit, total = hit + len(got & {i for i, _ in true}), total + len(true)
    assert hit / total >= 0.9
    plan = index.search(q, 10, "t0")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell), ", "")


def test_recall_on_embeddings(spark, tmp_path):
    vecs = R.embedding_vectors(spark, SF01).drop("label")
    index = build_ivf(vecs, str(tmp_path))
    hit = total = 0
    for r in vecs.orderBy("id").limit(12).collect():
        true = {x.id for x in VC.semantic_search(vecs, r.vector, r.tenant_id, 10).collect()}
        hit, total = hit + len(true & {x.id for x in index.search(r.vector, 10, r.tenant_id).collect()}), total + len(true)
    assert hit / total >= 0.9


def test_index_of_few_rows(spark, tmp_path):
    ddl = "id string, tenant_id string, vector array<double>"
    one = build_ivf(spark.createDataFrame([("a", "t", [1.0, 0.0])], ddl), str(tmp_path / "one"))
    assert [r.id for r in one.search([1.0, 1.0], 5).collect()] == ["a"]


def test_batch_search_in_blocks(spark, clustered):
    queries = clustered.where("vector is not null").orderBy("id").limit(60).select(F.col("id").alias("query_id"), "tenant_id", F.col("vector").alias("qvector"))
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    vecs = clustered.where("vector is not null")
    whole = rows(VC.semantic_search_batch(vecs, queries, k=4))
    assert len(whole) == 240 and rows(VC.semantic_search_batch(vecs, queries, k=4, max_query_bytes=2000)) == whole
