"""Helpers shared by the corpus operators: Arrow chunks, word hashes, checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.session import checkpoint_dir

#: Texts of one vectorised step; a longer single text forms a step of its own.
CHUNK_BYTES = 2 * 1024 * 1024
#: Letters (some 50 bytes each) that are hashed at once; a longer word is taken whole.
HASH_LETTERS = 256 * 1024

U64 = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
    cased = values.copy()
    values[65:91] = values[97:123]  # A-Z count as a-z
    space = np.ones(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = False
    alnum = np.zeros(256, bool)
    alnum[48:58] = alnum[65:91] = alnum[97:123] = alnum[128:] = True
    return values, cased, space, alnum, rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


_BYTE, _CASED, SPACE_WORDS, ALNUM_WORDS, _STEP = _tables()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on unsigned 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about ``size`` bytes of ``column``."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        _, offsets = text_bytes(batch.column(column))
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of some texts: byte spans, 64-bit hashes and each text's range of words.

    Hashes ignore the case of A-Z unless ``cased``. ``first[i]:first[i + 1]`` are the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, cased: bool = False):
        n = len(data)
        inside = table[data]
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True
        follows = np.zeros(n, bool)
        follows[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~follows | begin[:n]))
        goes_on = np.zeros(n, bool)
        goes_on[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~goes_on | begin[1:])) + 1
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, offsets)
        self.hashes = self._hash(data, starts, ends, _CASED if cased else _BYTE)

    @staticmethod
    def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
        out, lengths = np.empty(len(starts), U64), ends - starts
        total = np.cumsum(lengths)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(total, total[at] - lengths[at] + HASH_LETTERS, side="right")))
            some = lengths[at:to]
            heads = np.cumsum(some) - some
            place = np.arange(int(some.sum())) - np.repeat(heads, some)
            letters = data[place + np.repeat(starts[at:to], some)]
            powers = np.multiply.accumulate(np.full(int(some.max()), 0x9E3779B97F4A7C15, U64))
            out[at:to] = mix(np.add.reduceat(values[letters] * powers[place], heads) + some.astype(U64))
            at = to
        return out

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of k words inside one text, in order."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        total = np.zeros(n, U64)
        for j in range(k):
            total += self.hashes[j:j + n] * _STEP[j % 64] ^ U64(j)
        counts = np.diff(self.first)
        owner = np.repeat(np.arange(len(counts)), counts)
        keep = np.flatnonzero(owner[:n] == owner[k - 1:])
        return keep, mix(total[keep] + U64(k))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; a text of fewer words, but
    not none, has its whole sequence as its one shingle."""
    at, hashed = words.windows(k)
    cut = np.searchsorted(at, words.first)
    out = []
    for i in range(len(words.first) - 1):
        lo, hi = words.first[i], words.first[i + 1]
        if 0 < hi - lo < k:
            few = words.hashes[lo:hi]
            out.append(mix(np.add.reduce(few * _STEP[:hi - lo], keepdims=True) + U64(hi - lo)))
        else:
            out.append(np.unique(hashed[cut[i]:cut[i + 1]]))
    return out


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as an Arrow column of Spark's long."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``rows`` (narrow) rows, counted first; beyond
    that the join shuffles, with its skew left to adaptive execution."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stored(df: DataFrame) -> DataFrame:
    """``df``, computed once: written as Parquet into the shared checkpoint folder and read again. Unlike a
    checkpoint it doesn't run the last stage twice, and what many tasks wrote in little files is read by few."""
    folder = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
