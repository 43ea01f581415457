"""Corpus pipeline: toxicity, line dedup, near duplicates, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each
result is written as Parquet into the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from signalspark.session import checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't predict to be toxic; null and empty texts
    score as texts without terms, and an empty table stays empty."""
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def delete_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; a text that loses all its words goes. Null, empty
    and blank texts lose nothing and stay, repeated rows fare alike, other columns keep their names."""
    counts = tuple(next(c for c in (f"n_{what}{'_' * k}" for k in range(len(docs.columns) + 1)) if c not in docs.columns) for what in ("lines", "deleted"))
    out = line_dedup.line_dedup(docs, counts)
    left = (F.col(counts[1]) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(left).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links at 80 percent over 5-word shingles: the one of the
    least id, of repeated rows one. Texts without words link with nothing and all stay."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item; null and empty texts stay."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: number, digest of the ids, digest of the text they decode to. One row
    per row; a null text counts as empty."""
    coded = bpe.bpe_encode(docs)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", delete_lines), ("ngram_jaccard_join", drop_near_copies),
          ("benchmark_decontamination", drop_leaks), ("bpe", encode)]

#: SQL can express neither the learned model of the first stage nor the tokens of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
