"""Cross-entropy difference of two n-gram models (Moore and Lewis, 2010).

The target model is counted over the documents labelled as good, the background model over all
documents, its counts scaled to the target's size. Both are bigram models that back off to
unigrams with the same smoothing, over one vocabulary: all words of the corpus. A document's
score is the mean, over its words, of target loss less background loss.

No table of the models is ever in one place. Every word of every text is dealt to a bucket by
its hash, with the word before it; a bucket so holds all that is counted for its words, and sums
the losses of each text there, part by part of its words; a task takes several buckets, one after
the other, and hands on one sum a text for all of them. A word of more than an eighth of an even bucket is dealt by its
pairs, and a pair of so many goes anywhere: their counts are made first, as a table that has at
most some eight rows a bucket. Losses are summed as whole numbers, so order changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import SPACE_WORDS, U64, Words, chunks, mix, small, text_bytes
from signalspark.session import checkpoint_dir, ship_package

#: Mass of the unigram model in each bigram estimate, in counts.
BACKOFF = 50.0
#: Distinct n-grams that a task sums up before it hands them on.
HELD = 1_000_000
#: Labels that may be broadcast.
BROADCAST_LABELS = 2_000_000
#: Words of an even bucket (some 10 bytes each in a task), of a part of it that is summed at a time
#: (some 100 bytes each), and bytes of text taken for one word.
BUCKET, PART, WORD_BYTES = 4_000_000, 500_000, 7
#: Buckets of a task, if there are more than cores.
BUCKETS_OF_TASK = 8
#: Bytes of text that a task deals out at once (some 25 bytes each).
DEALT_BYTES = 4 * 1024 * 1024
#: Bytes of an Arrow batch; the JVM holds a batch up to four times over for each task, and Python twice.
BATCH_BYTES = 8 * 1024 * 1024
#: Units of a summed loss in a nat.
UNIT = 2.0**30
#: Stand for the place before a text's first word, and after its last.
HEAD, TAIL = U64(0x9D8A6B1F5C3E7721), U64(0x4F1BBCDCBFA53E0B)


class _Sums:
    """Running sums by key; hands them on when they grow."""

    def __init__(self):
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)

    def add(self, keys: np.ndarray, target: np.ndarray) -> None:
        keys, place = np.unique(keys, return_inverse=True)
        n = np.stack([np.bincount(place, target, len(keys)), np.bincount(place, minlength=len(keys))]).astype(np.int64)
        both, place = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        every = np.concatenate([self.sums, n], 1)
        self.keys = both
        self.sums = np.stack([np.bincount(place, every[c], len(both)) for c in (0, 1)]).astype(np.int64)

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.keys) > least:
            yield pa.RecordBatch.from_arrays([pa.array(self.keys), *map(pa.array, self.sums)], ["key", "t", "b"])
            self.__init__()


def _words(part: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    words = Words(*text_bytes(part.column("text")), SPACE_WORDS)
    return words, np.diff(words.first)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for part in chunks(batches, "text"):
        words, n = _words(part)
        sums.add(words.hashes.view(np.int64), np.repeat(part.column("target").to_numpy(), n))
        yield from sums.flush(HELD)
    yield from sums.flush()


def _before(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word (HEAD: none), and whether a word is the last of its text."""
    first = np.zeros(len(words.hashes) + 1, bool)
    first[words.first] = True
    before = np.concatenate([[HEAD], words.hashes])[:-1].astype(U64)
    before[first[:-1]] = HEAD
    return before, first[1:]


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before + U64(0x2545F491)) + word)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table, and its place there."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def _count_pairs(batches: Iterator[pa.RecordBatch], heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of two heavy words, and of heavy words as a text's first and last."""
    sums = _Sums()
    for part in chunks(batches, "text"):
        words, n = _words(part)
        before, last = _before(words)
        here, target = _find(heavy, words.hashes)[0], np.repeat(part.column("target").to_numpy(), n)
        both, ends = here & ((before == HEAD) | _find(heavy, before)[0]), here & last
        keys = np.concatenate([_pair(before[both], words.hashes[both]), _pair(words.hashes[ends], np.full(int(ends.sum()), TAIL))])
        sums.add(keys.view(np.int64), np.concatenate([target[both], target[ends]]))
        yield from sums.flush(HELD)
    yield from sums.flush()


class Heavy:
    """Sizes of the corpus, and the counts (target, all) of heavy words and pairs.

    words, pairs: sorted hashes; counts: 2 rows each; ended: how often a heavy word ends a text."""

    def __init__(self, buckets: int, tasks: int, distinct: int, totals: tuple, words: list, pairs: list, limit: float):
        self.buckets, self.tasks, self.distinct, self.totals = buckets, tasks, distinct, np.array(totals, float)
        # matched: background counts are scaled to as many words as the target has, so that smoothing weighs alike
        self.scale = (1.0, self.totals[0] / self.totals[1] if self.totals.all() else 1.0)
        self.words, self.word_counts = self._table(words)
        keys, counts = self._table(pairs)
        there, at = _find(keys, _pair(self.words, np.full(len(self.words), TAIL)))
        self.ended = np.where(there, counts[:, at], 0) if len(keys) else np.zeros((2, len(self.words)))
        much = counts[1] > limit
        self.pairs, self.pair_counts = keys[much], counts[:, much]

    @staticmethod
    def _table(rows: list) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([r[0] for r in rows], np.int64).view(U64)
        by = np.argsort(keys)
        return keys[by], np.array([[r[1] for r in rows], [r[2] for r in rows]], float).reshape(2, -1)[:, by]


def _deal(batches: Iterator[pa.RecordBatch], heavy: Heavy) -> Iterator[pa.RecordBatch]:
    """Every word with the one before it, by bucket: texts (key; 2 * words + target), the distinct
    words met, and for each word its place there, that of the word before, and if it is the last."""
    for part in chunks(batches, "text", DEALT_BYTES):
        words, n = _words(part)
        h = words.hashes
        if not len(h):
            continue
        keys, target = part.column("key").to_numpy().view(U64), part.column("target").to_numpy().astype(np.int64)
        before, last = _before(words)
        owner, pair = np.repeat(np.arange(len(n)), n), _pair(before, h)
        by_pair = _find(heavy.words, h)[0]
        route = np.where(by_pair, pair, h)
        free = by_pair & _find(heavy.pairs, pair)[0]
        route[free] = (np.arange(len(h), dtype=U64) // U64(1024) + mix(keys[:1] + U64(len(h))))[free]
        bucket = (mix(route + U64(0x6A09)) % U64(heavy.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        every, code = np.unique(h, return_inverse=True)
        code_before = np.concatenate([[0], code[:-1]])
        code_before[before == HEAD] = len(every)
        every = np.append(every, HEAD)
        out: list[list] = [[] for _ in range(7)]
        for s in np.split(order, cuts[1:]):
            some, place = np.unique(np.concatenate([code[s], code_before[s]]), return_inverse=True)
            place = place.astype(np.uint16 if len(some) <= 65536 else np.uint32)
            begin = np.flatnonzero(np.diff(owner[s], prepend=-1))
            whose = owner[s][begin]
            sizes = np.diff(np.append(begin, len(s)))
            for column, x in zip(out, (int(bucket[s[0]]), keys[whose], 2 * sizes + target[whose], every[some],
                                       place[:len(s)], place[len(s):], last[s]), strict=True):
                column.append(x if isinstance(x, int) else x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])],
                                         ["bucket", "texts", "sizes", "words", "word", "before", "last"])


def _by_task(dealt: DataFrame, heavy: Heavy) -> DataFrame:
    """The rows of each bucket as one partition of the shuffle; a task reads as many buckets as any other,
    one after the other, so that nothing is sorted and no task holds more than the bucket at hand."""
    return dealt.repartitionById(heavy.buckets, "bucket").coalesce(heavy.tasks)


def _bucket_losses(table: pa.Table, heavy: Heavy) -> pa.Table:
    """(key, n, t, b): words of each text in a bucket, and the sums of both losses in units.

    A bucket is summed in parts by the hash of the word, each of about PART words: what is counted
    for a word is counted in its part, and only sums by text outlive it."""
    # buffers of the table itself: no word is held twice
    blobs = list(zip(*([x.as_buffer() for x in table.column(c)] for c in table.column_names if c != "bucket"), strict=True))
    parts = sum(b[-1].size for b in blobs) // PART + 1
    done = [np.zeros(0, np.int64)] * 4
    for n in range(parts):
        done = _merged(done, _part_losses(blobs, heavy, n, parts))
    return pa.table(done, ["key", "n", "t", "b"])


def _losses(batches: Iterator[pa.RecordBatch], heavy: Heavy) -> Iterator[pa.RecordBatch]:
    """Sums by text over the buckets of a task, whose rows come bucket by bucket."""
    names, done = ["key", "n", "t", "b"], [np.zeros(0, np.int64)] * 4
    runs = (b.slice(lo, hi - lo) for b in batches
            for cuts in [[*np.flatnonzero(np.diff(b.column("bucket").to_numpy(), prepend=-1)).tolist(), b.num_rows]] for lo, hi in zip(cuts, cuts[1:], strict=False))
    for _, rows in groupby(runs, lambda b: b.column("bucket")[0].as_py()):
        done = _merged(done, _bucket_losses(pa.Table.from_batches(rows), heavy).columns)
        if len(done[0]) > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in done], names)
            done = [np.zeros(0, np.int64)] * 4
    if len(done[0]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in done], names)


def _merged(done: list[np.ndarray], more: list) -> list[np.ndarray]:
    """Sums by text of two lists (texts, and for each the sums)."""
    return _by_text(*(np.concatenate(x) for x in zip(done, more, strict=True)))


def _by_text(texts: np.ndarray, *sums: np.ndarray) -> list[np.ndarray]:
    by = np.argsort(texts, kind="stable")
    begin = np.flatnonzero(np.concatenate([np.ones(min(len(by), 1), bool), texts[by][1:] != texts[by][:-1]]))
    if not len(begin):
        return [texts, *sums]
    return [texts[by][begin], *(np.add.reduceat(x[by], begin) for x in sums)]


def _part_losses(blobs: list[tuple], heavy: Heavy, part: int, parts: int) -> list[np.ndarray]:
    """Texts, and for each the words of the part and the sums of both losses."""
    w, v, last, target, texts = [], [], [], [], []
    for keys, sizes, some, mine, prior, flags in blobs:
        some, flags, sizes = np.frombuffer(some, U64), np.frombuffer(flags, bool), np.frombuffer(sizes, np.int64)
        kind = np.uint16 if mine.size == 2 * len(flags) else np.uint32
        word, owner = np.frombuffer(mine, kind), np.repeat(np.arange(len(sizes)), sizes >> 1)
        here = np.flatnonzero((mix(some + U64(0x3C6E)) % U64(parts) == U64(part))[word])
        w.append(some[word[here]])
        v.append(some[np.frombuffer(prior, kind)[here]])
        last.append(flags[here])
        target.append(sizes[owner[here]] & 1)
        texts.append(np.frombuffer(keys, np.int64)[owner[here]])
    w, v, last, target, texts = (np.concatenate(x) for x in (w, v, last, target, texts))
    if not len(w):
        return [np.zeros(0, np.int64)] * 4
    pairs, pair = np.unique(_pair(v, w), return_inverse=True)
    words, word = np.unique(w, return_inverse=True)
    head = v == HEAD
    del w, v
    much, at = _find(heavy.words, words)
    much2, at2 = _find(heavy.pairs, pairs)
    sums = []
    for c, weight in enumerate((target, None)):
        count = lambda code, n: np.bincount(code, weight, n).astype(float)  # noqa: B023, E731
        single, joint = count(word, len(words)), count(pair, len(pairs))
        ended = np.bincount(word[last], None if weight is None else weight[last], len(words)).astype(float)
        if len(heavy.words):
            single = np.where(much, heavy.word_counts[c][at], single)
            ended = np.where(much, heavy.ended[c][at], ended)
        if len(heavy.pairs):
            joint = np.where(much2, heavy.pair_counts[c][at2], joint)
        p = (single * heavy.scale[c] + 1) / (heavy.totals[c] * heavy.scale[c] + heavy.distinct)
        after = np.log((single - ended) * heavy.scale[c] + BACKOFF)  # the part of the next word's loss that is this word's
        loss = np.where(head, -np.log(p)[word], -np.log(joint[pair] * heavy.scale[c] + BACKOFF * p[word])) + np.where(last, 0, after[word])
        sums.append(np.rint(loss * UNIT).astype(np.int64))
    return _by_text(texts, np.ones(len(texts), np.int64), *sums)


def lm_heavy(rows: DataFrame) -> Heavy:
    """From rows (text, target: 1 or 0). All texts are counted, in Spark; only totals and the
    counts of n-grams of more than an eighth of an even bucket reach the driver."""
    size = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / WORD_BYTES
    # more buckets than the cores ask for would cut texts and shared words into more rows than they need
    buckets, cores = int(size / BUCKET) + 1, rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-buckets // BUCKETS_OF_TASK), cores)
    buckets = tasks * -(-buckets // tasks)
    limit = size / (8 * buckets)
    summed = lambda x: x.groupBy("key").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    words = summed(rows.mapInArrow(_count_words, "key long, t long, b long"))
    total = words.agg(F.count("*").alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"),
                      F.collect_list(F.when(F.col("b") > limit, F.struct("key", "t", "b"))).alias("heavy")).first()
    pairs = []
    if total.heavy:
        known = np.sort(np.array([r.key for r in total.heavy], np.int64).view(U64))
        counted = summed(rows.mapInArrow(partial(_count_pairs, heavy=known), "key long, t long, b long"))
        ends = _pair(known, np.full(len(known), TAIL)).view(np.int64).tolist()
        marks = rows.sparkSession.createDataFrame([(x,) for x in ends], "key long").withColumn("end", F.lit(True))
        pairs = counted.join(F.broadcast(marks), "key", "left").where((F.col("b") > limit) | F.col("end")).select("key", "t", "b").collect()
    return Heavy(buckets, tasks, total.n, (total.t, total.b), total.heavy, pairs, limit)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(_words(part)[1].astype(np.int64))], ["doc_id", "key", "n_words"])


def lm_score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, target_loss, background_loss, score), the
    losses in nats per word; the lower the score, the more a text reads like the target.

    The target are the documents with label 1 (an id with several labels counts if one is 1),
    the background all documents. Null, empty and blank texts have no words and score 0; null
    ids have no label. Without a label 1 the target model is even, so scores are still defined.
    Repeated rows each count and are scored alike; other columns are ignored; an empty table
    gives an empty result."""
    checkpoint_dir(docs.sparkSession)
    ship_package(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    good = labels.where(F.col(label_col) == 1).select(F.col("doc_id").alias("good_id")).where("good_id is not null").distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    rows = texts.join(small(good, BROADCAST_LABELS), F.col("doc_id") == F.col("good_id"), "left").select(
        "key", "text", F.col("good_id").isNotNull().cast("int").alias("target"))
    heavy = lm_heavy(rows)
    dealt = rows.mapInArrow(partial(_deal, heavy=heavy), "bucket int, texts binary, sizes binary, words binary, word binary, before binary, last binary")


    # copies of a text have one key: their sums are divided by the words of all of them
    sums = (_by_task(dealt, heavy).mapInArrow(partial(_losses, heavy=heavy), "key long, n long, t long, b long")
            .groupBy("key").agg(*[F.sum(c).alias(c) for c in "ntb"]))
    kind = texts.schema["doc_id"].dataType.simpleString()
    out = texts.mapInArrow(_sizes, f"doc_id {kind}, key long, n_words long").join(sums, "key", "left")
    mean = lambda x: F.coalesce(x / F.lit(UNIT) / F.col("n"), F.lit(0.0))
    return out.select("doc_id", "n_words", mean(F.col("t")).alias("target_loss"), mean(F.col("b")).alias("background_loss"),
                      mean(F.col("t") - F.col("b")).alias("score"))
