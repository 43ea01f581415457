"""Line dedup by winnowing over line hashes.

The lines of a text that hold a word are hashed. Fingerprints are pairs of neighbouring lines:
of every two neighbouring pairs, the one of the lesser hash is kept (winnowing, window 2), so
each run of three lines holds a fingerprint, the same one wherever the run stands. A line of
many words is a fingerprint of its own, and so is a pair of many words. Each fingerprint is joined
with its earliest position; matches are extended both ways, and the later run is deleted. As that
earliest position may hold less of a run than a later one, the pairs across the ends of all that
is matched are joined with their own earliest positions in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import small
from signalspark.session import checkpoint_dir, ship_package

#: Words from which a line, or a pair of lines together, is a fingerprint whatever its hash.
LONG_LINE = 30

#: Keys of pairs that may be broadcast (8 bytes each).
BROADCAST_KEYS = 2_000_000

_WORDS = r"[^\\x20\\x09-\\x0D]+"  # within a SQL string


def _blank(line: str) -> str:
    """SQL for a line without its white space."""
    return f"translate({line}, ' \\t\\n\\r' || chr(11) || chr(12), '')"


def _lines() -> str:
    """SQL for the lines of ``text`` that hold a word: (h: hash, some, words)."""
    return ("filter(transform(split(text, '\\n', -1), l -> named_struct('h', xxhash64(l), "
            f"'some', {_blank('l')} <> '', 'words', regexp_count(l, '{_WORDS}'))), "
            "x -> x.some)")


def _fingerprints() -> tuple[str, str]:
    """SQL for the pairs of neighbours in the array ``lines``, and for the selected (p: index
    among the lines, key) given those pairs."""
    pairs = ("if(size(lines) < 2, array(), transform(sequence(0, size(lines) - 2), "
             "i -> named_struct('p', i, 'key', xxhash64(2, lines[i].h, lines[i + 1].h), "
             f"'wide', greatest(lines[i].words, lines[i + 1].words) < {LONG_LINE} and lines[i].words + lines[i + 1].words >= {LONG_LINE})))")
    picked = ("transform(filter({p}, (x, i) -> x.wide or size({p}) = 1 or (i > 0 and x.key <= {p}[i - 1].key) "
              "or (i < size({p}) - 1 and x.key <= {p}[i + 1].key)), "
              "x -> named_struct('p', x.p, 'key', x.key))").format(p="pairs")
    alone = ("transform(filter(transform(lines, (x, i) -> named_struct('p', i, 'key', xxhash64(1, x.h), 'words', x.words)), "
             f"x -> x.words >= {LONG_LINE}), x -> named_struct('p', x.p, 'key', x.key))")
    return pairs, f"concat({picked}, {alone})"


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of a text with an earlier one along one diagonal, extended both ways."""
    for batch in batches:
        ids, starts, sizes = [], [], []
        for own, shift, ps, mine, other in zip(
                batch.column("doc"), batch.column("shift").to_pylist(), batch.column("ps").to_pylist(),
                batch.column("mine").to_pylist(), batch.column("other").to_pylist(), strict=True):
            reach = -1
            for p in sorted(ps):
                if p < reach:
                    continue  # inside the last match
                lo = hi = p
                while lo > 0 and lo - 1 - shift >= 0 and mine[lo - 1] == other[lo - 1 - shift]:
                    lo -= 1
                while hi < len(mine) and hi - shift < len(other) and mine[hi] == other[hi - shift]:
                    hi += 1
                reach = hi
                ids.append(own.as_py())
                starts.append(lo)
                sizes.append(hi - lo)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()),
                                          pa.array(sizes, pa.int32())], ["doc", "start", "lines"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (p: index of the first line) across the ends of what the runs of a text cover."""
    for batch in batches:
        ids, ps = [], []
        for own, n, runs in zip(batch.column("doc").to_pylist(), batch.column("n").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            spans: list[list[int]] = []
            for lo, hi in sorted((x["start"], x["start"] + x["lines"]) for x in runs):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
            mine = {p for lo, hi in spans for p in (lo - 1, hi - 1) if 0 <= p < n - 1}
            ids += [own] * len(mine)
            ps += sorted(mine)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ps, pa.int32())], ["doc", "p"])


def _matches(seeds: DataFrame, first: DataFrame, arrays: DataFrame) -> DataFrame:
    """(doc, start, lines): seeds (doc, p, key) joined with the first position (key, src, q) of
    their key, if that is another one, and extended."""
    later = (seeds.join(first, "key").where("src <> doc or q < p")
             .groupBy("doc", "src", (F.col("p") - F.col("q")).alias("shift")).agg(F.collect_set("p").alias("ps")))
    matched = (later.join(arrays.select("doc", F.col("hs").alias("mine")), "doc")
               .join(arrays.select(F.col("doc").alias("src"), F.col("hs").alias("other")), "src")
               .select("doc", "shift", "ps", "mine", "other"))
    return matched.mapInArrow(_extend, "doc long, start int, lines int").distinct()


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, lines): runs of lines, by index among the lines that hold a
    word, that repeat an earlier run. Earlier is a lesser (doc_id, text hash), then a lesser
    position; a null doc_id comes first. docs: doc_id, text.

    Each fingerprint meets its earliest position only, never all pairs of a group; positions
    that lie on one diagonal of two texts are extended at once."""
    checkpoint_dir(docs.sparkSession)
    ship_package(docs.sparkSession)
    pairs, picked = _fingerprints()
    base = (docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
            .select("doc_id", F.xxhash64("text").alias("text_hash"), F.expr(_lines()).alias("lines"))
            .where("size(lines) > 0")
            .select("doc_id", "text_hash", "lines", F.expr(pairs).alias("pairs"))
            .select("doc_id", "text_hash", F.expr("transform(lines, x -> x.h)").alias("hs"), F.expr(picked).alias("prints"))
            .withColumn("doc", F.xxhash64("doc_id", "text_hash")))
    base = base.checkpoint()  # some 8 bytes a line; texts are read once for it
    seeds = base.select("doc_id", "text_hash", "doc", F.inline("prints"))
    order = F.struct(F.col("doc_id"), F.col("text_hash"), F.col("p"), F.col("doc"))
    first = seeds.groupBy("key").agg(F.min(order).alias("one"), F.count("*").alias("n")).where("n > 1").select(
        "key", F.col("one.doc").alias("src"), F.col("one.p").alias("q"))
    arrays = base.groupBy("doc").agg(F.min("hs").alias("hs"))
    runs = _matches(seeds, first, arrays).checkpoint()
    # the earliest position of a fingerprint may hold less of a run than a later one does: the pairs across the ends
    sized = runs.groupBy("doc").agg(F.collect_list(F.struct("start", "lines")).alias("runs")).join(
        base.select("doc", F.size("hs").alias("n")).distinct(), "doc")
    ends = (sized.mapInArrow(_ends, "doc long, p int").join(arrays, "doc")
            .select("doc", "p", F.expr("xxhash64(2, hs[p], hs[p + 1])").alias("key")).checkpoint())
    every = base.where("size(hs) > 1").select("doc_id", "text_hash", "doc", F.expr(
        "inline(transform(sequence(0, size(hs) - 2), i -> named_struct('p', i, 'key', xxhash64(2, hs[i], hs[i + 1]))))"))
    asked = every.join(small(ends.select("key").distinct(), BROADCAST_KEYS), "key").groupBy("key").agg(F.min(order).alias("one")).select(
        "key", F.col("one.doc").alias("src"), F.col("one.p").alias("q"))
    runs = runs.union(_matches(ends, asked, arrays)).distinct()
    who = base.select("doc", "doc_id", "text_hash").distinct()
    return runs.join(who, "doc").select("doc_id", "text_hash", "start", "lines")


def line_dedup(docs: DataFrame, counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted, plus two ``counts``, of its lines and of those deleted.

    Lines are parted by \\n; a line of white space only is never matched, is skipped by runs,
    and stays unless it stands inside a deleted run (between two of its lines). A run matches
    line by line. Guaranteed: a run of three lines or more that stands earlier too, a line of
    LONG_LINE words or more that does, and two neighbouring lines of so many words together that
    do, are found whole; lines of a found run go, the earliest copy of every line stays. Shorter
    runs go only where a fingerprint, or a pair at the end of a match, meets its earliest copy.

    A null text stays null; empty and blank texts stay as they are. Repeated rows (same id and
    text) count as one text and fare alike, so a caller that wants one of them drops the rest.
    A text whose lines all go becomes empty. n_chars, if there, follows the text; other columns
    stay as they are, whatever their names, but for any named as the ``counts``, which are replaced.
    An empty table gives an empty result."""
    runs = repeated_runs(docs.select("doc_id", "text"))
    gone = (runs.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "lines")).alias("runs"))
            .select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "runs"))
    names = [c for c in docs.columns if c not in counts]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"), F.col("doc_id").alias("id"), F.col("text").cast("string").alias("body"))
    joined = own.join(gone, own["id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64("body") == gone["gone_hash"]), "left")
    lines = (joined.withColumn("every", F.split(F.col("body"), "\n", -1))
             .withColumn("at", F.expr(f"filter(sequence(0, size(every) - 1), i -> {_blank('every[i]')} <> '')")))
    # the runs as spans of line numbers, from the first to the last line of each
    cut = lines.withColumn("cut", F.expr(
        "array_distinct(flatten(transform(runs, r -> sequence(at[r.start], at[r.start + r.lines - 1]))))"))
    kept = cut.withColumn("left", F.when(F.col("cut").isNotNull(), F.expr(
        "array_join(transform(array_except(sequence(0, size(every) - 1), cut), i -> every[i]), '\n')"))
        .otherwise(F.col("body")))
    kinds = dict(docs.dtypes)
    out = [(F.col("left") if c == "text" else
            F.when(F.col("cut").isNotNull(), F.length("left")).otherwise(F.col("row")[c]).cast(kinds[c]) if c == "n_chars" else F.col("row")[c]).alias(c)
           for c in names]
    # one struct through a generator: a later filter on the result can't copy the line logic below it
    made = F.struct(*out, *[F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(c) for c, lines in zip(counts, ("at", "cut"))])
    return kept.select(F.inline(F.array(made)))
