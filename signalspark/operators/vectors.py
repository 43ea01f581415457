"""Embeddings, keyed vector upserts, exact and approximate search.

The default encoder is signed feature hashing of whitespace tokens (MD5
bucket and sign), L2-normalised: no model download is possible here, it is
deterministic across machines, and it can be restated in SQL. A real model
plugs in as another iterator pandas UDF with the same signature.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..constants import SEARCH_LIMIT
from ..functions.vectors import dot, l2_norm, l2_normalize
from ..plans.joins import estimated_size_bytes
from ..session import checkpoint_dir
from .query import clamp_limit

EMBED_DIM = 384
_TOKEN = re.compile(r"[^ \t\n\r]+")
#: Tokens whose slots a task keeps, and texts of one piece of its output.
CACHED_TOKENS, PIECE = 100_000, 1024
#: Points (some 2 KB each) that a task of an upsert sorts.
POINTS_OF_TASK = 50_000


def _token_slots(tok: str, dim: int) -> tuple[int, float]:
    h = hashlib.md5(tok.encode("utf-8")).hexdigest()
    return int(h[:8], 16) % dim, (1.0 if int(h[8], 16) < 8 else -1.0)


def hash_embed(text: str | None, dim: int = EMBED_DIM, cache: dict | None = None) -> np.ndarray:
    """Signed hashing vector of the lower-cased whitespace tokens, unit length.

    ``cache`` (token → slot) may be shared across texts, so a batch hashes
    each distinct token once.
    """
    v = np.zeros(dim, dtype=np.float64)
    if text:
        cache = {} if cache is None else cache
        for found in _TOKEN.finditer(text.lower()):
            tok = found.group()
            slot = cache.get(tok)
            if slot is None:
                if len(cache) >= CACHED_TOKENS:
                    cache.clear()
                slot = cache[tok] = _token_slots(tok, dim)
            v[slot[0]] += slot[1]
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def hashing_encoder(dim: int = EMBED_DIM):
    """Iterator pandas UDF text → array<float>; the token-slot cache lives for
    the whole task (bounded: emptied at CACHED_TOKENS distinct tokens, also inside a text)."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        for texts in batches:
            for at in range(0, len(texts), PIECE):
                yield pd.Series([hash_embed(t, dim, cache).astype(np.float32) for t in texts[at:at + PIECE]])
    return enc


def embed(df: DataFrame, col: str, out: str = "vector", encoder=None) -> DataFrame:
    """Add an embedding column computed from ``col`` (whole text)."""
    enc = encoder or hashing_encoder()
    return df.withColumn(out, enc(F.col(col)))


def vector_points(events: DataFrame, encoder=None) -> DataFrame:
    """Log events → vector points (id = event id; payload columns)."""
    logs = events.filter(F.col("payload.type") == "log")
    pts = logs.select(F.col("id"), "tenant_id", F.col("source.service").alias("service"),
                      F.col("source.environment").alias("environment"), F.col("payload.log.level").alias("level"),
                      F.col("payload.log.message").alias("message"),
                      F.unix_seconds("timestamp").cast("bigint").alias("timestamp"))
    return embed(pts, "message", encoder=encoder)


def upsert_vectors(existing: DataFrame | None, points: DataFrame, version_col: str = "timestamp") -> DataFrame:
    """Keyed upsert — a point replaces the stored one of its id, whatever their times.

    Of points of one id in ``points`` the newest counts, then the greatest in its other columns.
    Points are counted first (without their vectors, where these are computed) and dealt by id to
    tasks of some POINTS_OF_TASK: vectors of few tokens shrink so much in a shuffle that its
    bytes don't tell what a task sorts. Stored points meet the ids alone, unsorted."""
    rest = [c for c in points.columns if c not in ("id", version_col)]
    n = points.count()
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // POINTS_OF_TASK))
    dealt = points.repartition(tasks, "id") if n > POINTS_OF_TASK else points
    new = dealt.groupBy("id").agg(F.max(F.struct(version_col, *rest)).alias("p")).select("id", "p.*").select(*points.columns)
    if existing is None:
        return new
    ids = new.select("id")
    ids = F.broadcast(ids) if n <= POINTS_OF_TASK else ids.hint("shuffle_hash")
    return existing.join(ids, "id", "left_anti").select(*points.columns).unionByName(new)


def semantic_search(vectors: DataFrame, qvec, tenant_id: str, limit: int | None = None,
                    vector_col: str = "vector") -> DataFrame:
    """Cosine top-k of one query vector inside one tenant.

    ``qvec`` is a list of floats (already embedded). The scan is filtered by
    tenant first; ``orderBy.limit`` is a per-partition top-k plus one merge.
    """
    k = clamp_limit(limit, *SEARCH_LIMIT)
    q = np.asarray(qvec, dtype=float)
    qn = float(np.linalg.norm(q))
    q = q / qn if qn > 0 else q
    qcol = F.array(*[F.lit(float(x)) for x in q])
    v = vectors.filter(F.col("tenant_id") == tenant_id)
    nv = l2_norm(vector_col)
    score = F.when(nv > 0, dot(vector_col, qcol) / nv).otherwise(F.lit(0.0))
    cols = [c for c in v.columns if c != vector_col]
    return v.select(*cols, score.alias("score")).orderBy(F.col("score").desc(), F.col("id")).limit(k)


def semantic_search_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, vector_col: str = "vector",
                          query_vector_col: str = "qvector", max_query_bytes: int = 256 * 1024 * 1024) -> DataFrame:
    """Top-k per query vector, restricted to the query's tenant.

    The query matrix is broadcast after a size check; each partition scores
    its vectors against the queries of the same tenant, a matrix product for each
    Arrow batch, of which only the top-k per query go on to the final
    ``row_number() <= k``. Ties go by id. No (vector, query) pair rows
    are ever materialised. A query set beyond ``max_query_bytes`` is cut by the hash of the query
    into blocks below it; each is searched in a pass of its own over all vectors and its result
    written to the checkpoint folder before the next one is broadcast.
    """
    qsize = estimated_size_bytes(queries)
    if qsize is None or qsize >= 1 << 62 or qsize > max_query_bytes:  # no estimate, or too large a one: measure
        qsize = queries.select(F.sum(F.size(query_vector_col)) * 8).first()[0] or 0
    if qsize <= max_query_bytes:
        return _search_block(vectors, queries, k, vector_col, query_vector_col)[0]
    checkpoint_dir(vectors.sparkSession)
    blocks, out = -(-2 * qsize // max_query_bytes), None
    for n in range(blocks):
        found, sent = _search_block(vectors, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n), k, vector_col, query_vector_col)
        found = found.checkpoint()
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(vectors: DataFrame, queries: DataFrame, k: int, vector_col: str, query_vector_col: str):
    """Top-k of a bounded set of queries, and the broadcast that holds them."""
    spark = vectors.sparkSession
    qb = queries.select("query_id", "tenant_id", query_vector_col).toPandas()  # bounded by the check above
    by_tenant = {}
    for t, g in qb.groupby("tenant_id"):
        m = np.stack([np.asarray(x, dtype=float) for x in g[query_vector_col]])
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        by_tenant[t] = (g["query_id"].tolist(), m)
    bq = spark.sparkContext.broadcast(by_tenant)

    def topk(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tab = bq.value
        for pdf in it:
            outs = []
            for t, g in pdf.groupby("tenant_id"):
                if t not in tab:
                    continue
                qids, qm = tab[t]
                vm = np.stack([np.asarray(x, dtype=float) for x in g[vector_col]])
                vm = vm / np.maximum(np.linalg.norm(vm, axis=1, keepdims=True), 1e-300)
                s = np.round(vm @ qm.T, 12)  # rows: vectors, cols: queries; equal vectors score the same
                ids = g["id"].to_numpy()
                kk = min(k, len(ids))
                for j, qid in enumerate(qids):
                    col = s[:, j]
                    idx = np.flatnonzero(col >= np.partition(col, -kk)[-kk])  # with all ties of the k-th score
                    best = pd.DataFrame({"query_id": qid, "tenant_id": t, "id": ids[idx], "score": col[idx]})
                    outs.append(best.sort_values(["score", "id"], ascending=[False, True]).head(kk))
            if outs:
                yield pd.concat(outs, ignore_index=True)

    schema = "query_id STRING, tenant_id STRING, id STRING, score DOUBLE"
    part = vectors.select("id", "tenant_id", vector_col).mapInPandas(topk, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), bq


def ann_index(vectors: DataFrame, vector_col: str = "vector", bucket_length: float = 0.5, tables: int = 8,
              seed: int = 7):
    """Random-projection LSH index over unit vectors (MLlib).

    Euclidean distance between unit vectors is monotone in cosine similarity,
    so the LSH candidates are re-ranked exactly by cosine.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    unit = vectors.withColumn("_features", array_to_vector(l2_normalize(vector_col)))
    lsh = BucketedRandomProjectionLSH(inputCol="_features", outputCol="_hashes", bucketLength=bucket_length,
                                      numHashTables=tables, seed=seed)
    model = lsh.fit(unit)
    return model, model.transform(unit)


def ann_search(index, qvec, k: int = 10, tenant_id: str | None = None) -> DataFrame:
    """Approximate top-k by LSH candidates, exact cosine re-rank."""
    from pyspark.ml.linalg import Vectors
    model, table = index
    q = np.asarray(qvec, dtype=float)
    q = q / max(np.linalg.norm(q), 1e-300)
    t = table if tenant_id is None else table.filter(F.col("tenant_id") == tenant_id)
    cand = model.approxNearestNeighbors(t, Vectors.dense(q), k, distCol="_dist")
    # unit vectors: cosine = 1 − d²/2
    return (cand.withColumn("score", 1.0 - F.col("_dist") * F.col("_dist") / 2.0)
                .drop("_features", "_hashes", "_dist").orderBy(F.col("score").desc(), "id"))
