"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their beginnings, hashed. The machine gives each kept term a
weight and a vector; the products of vectors score pairs of terms that occur together, such as
an insult and the mention of a group, which linear weights alone miss.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.llm.common import ALNUM_WORDS, U64, Words, chunks, text_bytes
from signalspark.session import ship_package

#: Labelled documents of each class that training takes at most (least hashes of the id first).
TRAIN_ROWS = 10_000
#: Hash buckets of terms; terms that the machine keeps at most by their own association with the
#: label; least |z| of such a term.
BUCKETS, TERMS, LEAST_Z = 1 << 20, 4096, 2.5
#: Terms kept for their frequency alone, whatever their association: a term may matter only in pairs.
#: Those of more than so large a share of the texts are in every pair and tell nothing.
FREQUENT, USUAL = 256, 0.95
#: Bytes of a word whose beginnings are terms too.
STEMS = (4, 5, 6)
RANK, EPOCHS, RATE, DECAY = 8, 20, 0.1, 1e-4


def doc_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct hashed terms of each text."""
    data, offsets = text_bytes(column)
    words = Words(data, offsets, ALNUM_WORDS)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    size = words.ends - words.starts
    terms, rows = [words.hashes], [owner]
    for n in STEMS:
        longer = size > n
        terms.append(Words._hash(data, words.starts[longer], words.starts[longer] + n) ^ U64(n))
        rows.append(owner[longer])
    key = np.unique(np.concatenate(rows).astype(U64) * U64(BUCKETS) + np.concatenate(terms) % U64(BUCKETS))
    return (key // U64(BUCKETS)).astype(np.int64), (key % U64(BUCKETS)).astype(np.int64)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int32)
    for part in chunks(batches, "text"):
        y = part.column("y").to_numpy()
        rows, terms = doc_terms(part.column("text"))
        for c in (0, 1):
            counts[c] += np.bincount(terms[y[rows] == c], minlength=BUCKETS).astype(np.int32)
    some = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c[some].astype(np.int64)) for c in counts)], ["term", "n0", "n1"])


def _kept_terms(batches: Iterator[pa.RecordBatch], index: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        rows, terms = doc_terms(part.column("text"))
        place = index[terms]
        rows, place = rows[place >= 0], place[place >= 0]
        offsets = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([part.column("y"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32)))], ["y", "terms"])


class FactorizationMachine:
    """Second-order machine for binary inputs: w0 + sum w_i + sum of <v_i, v_j> over pairs."""

    def __init__(self, size: int, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0 = 0.0
        self.w = np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.01, (size, rank)).astype(np.float32)

    def logits(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from (row, term) pairs that are sorted by row."""
        out = np.full(n, self.w0)
        out += np.bincount(rows, self.w[terms], n)
        for f in range(self.v.shape[1]):
            x = self.v[terms, f].astype(float)
            out += 0.5 * (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n))
        return out

    def fit(self, y: np.ndarray, terms: list[np.ndarray], epochs: int = EPOCHS, seed: int = 11) -> None:
        """AdaGrad on the logistic loss, both classes of equal weight, in batches of 256 texts."""
        share = float(y.mean())
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        rng = np.random.default_rng(seed)
        g0, gw, gv = 1e-6, np.full(self.w.shape, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), 256):
                pick = order[at:at + 256]
                x = np.zeros((len(pick), len(self.w)), np.float32)
                for r, i in enumerate(pick):
                    x[r, terms[i]] = 1
                s = x @ self.v
                z = self.w0 + x @ self.w + 0.5 * ((s * s).sum(1) - (x @ (self.v * self.v).sum(1)))
                d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                dw = x.T @ d
                dv = x.T @ (d[:, None] * s) - dw[:, None] * self.v
                used = x.any(0)
                d0 = float(d.sum())
                g0 += d0 * d0
                self.w0 -= RATE * d0 / g0 ** 0.5
                dw += DECAY * self.w * used
                dv += DECAY * self.v * used[:, None]
                gw += dw * dw
                gv += dv * dv
                self.w -= RATE * dw / np.sqrt(gw)
                self.v -= 0.2 * RATE * dv / np.sqrt(gv)


class Model:
    """Index of the kept terms (bucket to place, or -1) and the machine."""

    def __init__(self, index: np.ndarray, machine: FactorizationMachine):
        self.index, self.machine = index, machine

    def scores(self, column: pa.Array) -> np.ndarray:
        rows, terms = doc_terms(column)
        place = self.index[terms]
        z = self.machine.logits(rows[place >= 0], place[place >= 0], len(column))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from docs (doc_id, text) and labels (doc_id, y: 0 or 1); None without both classes.

    Of each class at most TRAIN_ROWS labelled documents are used, those whose ids hash least."""
    ship_package(docs.sparkSession)
    one = labels.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    rates = {r.y: r["count"] for r in one.groupBy("y").count().collect()}
    if len(rates) < 2:
        return None
    w = Window.partitionBy("y").orderBy("h", "doc_id")
    some = (one.withColumn("h", F.xxhash64("doc_id")).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= TRAIN_ROWS).select(F.col("doc_id").alias("label_id"), "y"))
    rows = docs.where("text is not null").join(F.broadcast(some), F.col("doc_id") == F.col("label_id")).select("y", "text")  # at most 2 * TRAIN_ROWS
    n0, n1 = F.sum("n0"), F.sum("n1")
    counts = rows.mapInArrow(_term_counts, "term long, n0 long, n1 long").groupBy("term").agg(n0.alias("n0"), n1.alias("n1")).where("n0 + n1 >= 2")
    k0, k1 = (float(min(rates[c], TRAIN_ROWS)) for c in (0, 1))
    z = ((F.log((F.col("n1") + 0.5) / (k1 - F.col("n1") + 0.5).cast("double")) - F.log((F.col("n0") + 0.5) / (k0 - F.col("n0") + 0.5)))
         / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5)))
    share = (F.col("n0") / k0 + F.col("n1") / k1) / 2
    told = counts.select("term", F.abs(z).alias("z"), share.alias("share"))
    sure = told.orderBy(F.desc("z"), "term").limit(TERMS).where(F.col("z") >= LEAST_Z).select("term")
    often = told.where(F.col("share") <= USUAL).orderBy(F.desc("share"), "term").limit(FREQUENT).select("term")
    kept = sure.union(often).distinct().orderBy("term").collect()
    index = np.full(BUCKETS, -1, np.int32)
    index[[r.term for r in kept]] = np.arange(len(kept))
    data = rows.mapInArrow(partial(_kept_terms, index=index), "y int, terms array<int>").toArrow().combine_chunks()
    y = data.column("y").to_numpy()
    if not kept or not 0 < y.sum() < len(y):
        return None
    lists = data.column("terms").combine_chunks()
    order = sorted(range(len(y)), key=lambda i: (y[i], lists[i].as_py()))  # whatever order the tasks ended in
    terms = [lists[i].values.to_numpy() for i in order]
    machine = FactorizationMachine(len(kept))
    machine.fit(y[order].astype(np.float32), terms)
    return Model(index, machine)


def _score(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        scores = np.zeros(part.num_rows) if model is None else model.scores(part.column("text"))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), pa.array(scores)],
                                         [*(c for c in part.schema.names if c != "text"), "score"])


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, score, predicted).

    score is the probability of label 1 (0 to 1); predicted is 1 from 0.5 on. Scores depend on
    texts only. Null and empty texts have no terms and get the score of none. A null id is not
    held out and has no label; labels other than 0 and 1 are ignored; where an id has both, 1
    counts. Without both classes in the labels all scores are 0. Repeated rows are scored alike;
    other columns are ignored; an empty table gives an empty result."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    learn = labels.select(F.col("doc_id"), F.col(label_col).alias("y")).where(~held_out())
    model = train(texts, learn)
    kind = texts.schema["doc_id"].dataType.simpleString()
    scored = texts.mapInArrow(partial(_score, model=model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``toxicity`` predicts 1 for; all columns stay as they are.

    The score is computed beside the row, so no join brings it back."""
    model = train(docs.select("doc_id", F.col("text").cast("string").alias("text")),
                  labels.select("doc_id", F.col("toxic").alias("y")).where(~held_out()))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(partial(_keep_clean, model=model), ", ".join(fields))


def _keep_clean(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        yield part if model is None else part.filter(pa.array(model.scores(part.column("text")) < 0.5))
