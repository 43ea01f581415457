"""Repeated passages by sparse suffix arrays.

Only the suffixes that begin near a minimiser stay: of every WINDOW neighbouring K-grams of
words the one of the least hash, so that a passage selects the same places wherever it stands.
The suffixes are grouped by a hash of their next words, neighbours in a group (by document and
place) are compared, and matches are extended left and right to the longest common passage. This
is no order of suffixes: a group stands for all suffixes that agree in so many words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.llm.common import CHUNK_BYTES, SPACE_WORDS, U64, Words, chunks, signed, small, text_bytes
from signalspark.session import checkpoint_dir, ship_package

#: Words of a K-gram; neighbouring K-grams of which one is selected.
K, WINDOW = 8, 12
#: Document keys that may be broadcast to pick out texts (8 bytes each).
BROADCAST_IDS = 2_000_000


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) of every n neighbouring values, by doubling."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x = f(x[:len(x) - step], x[step:])
        size += step
    return x


def minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least value of some ``window`` neighbouring values."""
    least = _slide(h, window, np.minimum)
    pad = np.zeros(window - 1, U64)
    best = _slide(np.concatenate([pad, least, pad]), window, np.maximum)  # greatest window minimum over the windows around a place
    return np.flatnonzero(best >= h)


def _suffixes(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    size = min_words - WINDOW + 1  # words of a suffix that lie in any passage its minimiser was selected by
    for part in chunks(batches, "text"):
        words = Words(*text_bytes(part.column("text")), SPACE_WORDS)
        docs = part.column("doc").to_numpy()
        at, grams = words.windows(K)
        at_s, heads = words.windows(size)
        place = np.full(len(words.hashes) + 1, -1, np.int64)
        place[at_s] = np.arange(len(at_s))
        cut = np.searchsorted(at, words.first)
        keys, owners, starts = [], [], []
        for i in np.flatnonzero(np.diff(words.first) >= min_words):
            lo = words.first[i]
            p = place[lo + minimisers(grams[cut[i]:cut[i + 1]], WINDOW)]
            p = p[p >= 0]
            keys.append(heads[p])
            owners.append(np.full(len(p), docs[i]))
            starts.append((at_s[p] - lo).astype(np.int32))
        if keys:
            yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), pa.array(np.concatenate(owners)),
                                              pa.array(np.concatenate(starts))], ["key", "doc", "at"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with a body for the text: a body is the size of the text in UTF-8 (8 bytes), then the text compressed, some
    two bytes a word where word hashes take eight."""
    codec = pa.Codec("zstd")
    for part in chunks(batches, "text"):
        data, offsets = text_bytes(part.column("text"))
        raw, sizes = data.tobytes(), np.diff(offsets)
        rows = [n.tobytes() + codec.compress(raw[a:a + int(n)], asbytes=True) for a, n in zip(offsets.tolist(), sizes.astype(np.int64), strict=False)]
        rest = [c for c in part.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(part.column, rest), pa.array(rows, pa.binary())], [*rest, "body"])


def _unpacked(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[pa.RecordBatch, list[list[np.ndarray]]]]:
    """Batches in steps of some CHUNK_BYTES of text, with the word hashes of each body of ``columns``."""
    codec = pa.Codec("zstd")
    for batch in batches:
        rows = [batch.column(c).to_pylist() for c in columns]
        sizes = [[int.from_bytes(b[:8], "little") for b in r] for r in rows]
        step = np.cumsum([sum(n) for n in zip(*sizes, strict=True)]) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            out = []
            for r, n in zip(rows, sizes, strict=True):
                raw = b"".join(codec.decompress(memoryview(b)[8:], m, asbytes=True) if m else b"" for b, m in zip(r[lo:hi], n[lo:hi], strict=True))
                words = Words(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(n[lo:hi])]), SPACE_WORDS)
                out.append([words.hashes[a:b] for a, b in zip(words.first, words.first[1:], strict=False)])
            yield batch.slice(lo, hi - lo), out


def _passages(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the passages of min_words words around the suffixes that have a neighbour."""
    for batch, (bodies,) in _unpacked(batches, "body"):
        keys, owners, starts = [], [], []
        for doc, body, ats in zip(batch.column("doc").to_pylist(), bodies, batch.column("ats").to_pylist(), strict=True):
            words = object.__new__(Words)
            words.hashes = body
            words.first = np.array([0, len(words.hashes)])
            at, h = words.windows(min_words)
            near = np.unique(np.asarray(ats)[:, None] - np.arange(WINDOW))
            near = near[(near >= 0) & (near < len(at))]
            keys.append(h[near])
            starts.append(near.astype(np.int32))
            owners.append(np.full(len(near), doc, np.int64))
        if keys:
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys])))
            yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), ids, pa.array(np.concatenate(owners)),
                                              pa.array(np.concatenate(starts))], ["key", "id", "doc", "at"])


def _extend(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch, (mine, theirs) in _unpacked(batches, "mine", "theirs"):
        out: list[list[int]] = [[], [], [], [], []]
        for a, b, shift, ats, x, y in zip(*(batch.column(c).to_pylist() for c in ("doc", "other", "shift", "ats")), mine, theirs, strict=True):
            # along the diagonal, equal stretches are the longest common passages
            lo, hi = max(0, shift), min(len(x), len(y) + shift)
            same = np.concatenate([[False], x[lo:hi] == y[lo - shift:hi - shift], [False]])
            turn = np.flatnonzero(same[1:] != same[:-1])
            for s, e in zip(turn[::2] + lo, turn[1::2] + lo, strict=True):
                if e - s >= min_words and any(s <= p < e for p in ats) and (a != b or shift):
                    for col, v in zip(out, (a, b, int(s), int(s - shift), int(e - s)), strict=True):
                        col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                          *(pa.array(c, pa.int32()) for c in out[2:])], ["doc", "other", "start", "other_start", "n_words"])


def repeated_passages(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of equal passages of min_words words or more: (doc_id, start, n_words, src_doc_id,
    src_start), in words from 0; the source is the text of the lesser id (of equal ids, the
    lesser place).

    Every such passage of every text is in a pair with a copy of it, if there is one; of many
    copies, neighbours in the order of ids are paired, never all with all, so that every copy but
    the first has a row of its own that names an earlier one. Words end at ASCII white space, A-Z
    counts as a-z. A passage may repeat inside its own text. Rows that agree in id and text
    count once. Null and short texts have no passages; a null id comes first. Other columns
    are ignored; an empty table gives an empty result."""
    if min_words < K + 2 * WINDOW:
        raise ValueError(f"min_words must be at least {K + 2 * WINDOW}")
    checkpoint_dir(docs.sparkSession)
    ship_package(docs.sparkSession)
    text = F.col(text_col).cast("string")
    texts = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("doc"))
    rows = texts.select("doc", "text").mapInArrow(partial(_suffixes, min_words=min_words), "key long, doc long, at int")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def beside(x: DataFrame, *order: str) -> DataFrame:
        """Rows with the neighbours before and after them in sorted order."""
        w = Window.partitionBy("key").orderBy(*order, "doc", "at")
        return x.select("*", F.lag(F.struct("doc", "at")).over(w).alias("before"), F.lead(F.struct("doc", "at")).over(w).alias("after"))

    own = F.struct("doc", "at")
    near = (beside(rows).where((F.col("before") != own) | (F.col("after") != own))
            .groupBy("doc").agg(F.collect_set("at").alias("ats")).checkpoint())
    bodies = (texts.select("doc", F.col("doc_id").alias("id"), "text").join(small(near.select("doc"), BROADCAST_IDS), "doc", "left_semi")
              .mapInArrow(_bodies, f"doc long, id {kind}, body binary").groupBy("doc").agg(F.min("id").alias("id"), F.min("body").alias("body"))
              .join(near, "doc").checkpoint())
    whole = bodies.mapInArrow(partial(_passages, min_words=min_words), f"key long, id {kind}, doc long, at int")
    pairs = (beside(whole, "id").where(F.col("before") != own)
             .groupBy("doc", F.col("before.doc").alias("other"), (F.col("at") - F.col("before.at")).alias("shift"))
             .agg(F.collect_set("at").alias("ats")).checkpoint())
    paired = pairs.select("doc").union(pairs.select("other")).distinct()
    bodies = bodies.select("doc", "body").join(small(paired, BROADCAST_IDS), "doc", "left_semi")
    both = (pairs.join(bodies.withColumnRenamed("body", "mine"), "doc")
            .join(bodies.select(F.col("doc").alias("other"), F.col("body").alias("theirs")), "other"))
    runs = both.mapInArrow(partial(_extend, min_words=min_words), "doc long, other long, start int, other_start int, n_words int")
    names = texts.select("doc", "doc_id").distinct()
    named = (runs.join(names, "doc").join(names.select(F.col("doc").alias("other"), F.col("doc_id").alias("other_id")), "other"))
    later = F.struct("doc_id", "start") >= F.struct("other_id", "other_start")
    pick = lambda a, b: F.when(later, F.col(a)).otherwise(F.col(b))
    return named.select(pick("doc_id", "other_id").alias("doc_id"), pick("start", "other_start").alias("start"), "n_words",
                        pick("other_id", "doc_id").alias("src_doc_id"), pick("other_start", "start").alias("src_start")).distinct()
