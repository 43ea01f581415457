"""Benchmark decontamination, in DataFrame expressions only.

The windows of the benchmark's items form a hash set that is broadcast behind a count; training
texts are scanned in windows of words, hits are verified by the words themselves (the join
compares hash and text), and the documents or the hit words are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct benchmark windows that may be broadcast; each is some 100 bytes.
BROADCAST_WINDOWS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words once A-Z are lower-cased: all of ASCII but digits and a-z.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(_WORD), F.lit(0))


def _windows(words: str, length: str) -> str:
    """SQL for the array of (pos, len, gram) of all windows of ``length`` words."""
    return (f"transform(if(size({words}) >= {length}, sequence(1, size({words}) - {length} + 1), array()), "
            f"i -> named_struct('pos', i, 'len', {length}, 'gram', array_join(slice({words}, i, {length}), ' ')))")


def benchmark_windows(benchmark: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(gram, len, item_ids): distinct windows, with the items that have them. An item of fewer
    words than ``window``, but not none, is one window; null items and texts have none."""
    words = (benchmark.select(F.col(item_col).alias("item"), normal_words(F.col(text_col)).alias("words"))
             .where("size(words) > 0 and item is not null"))
    rows = words.select("item", F.expr("explode(" + _windows("words", f"least({window}, size(words))") + ")").alias("w"))
    return rows.groupBy("w.gram", "w.len").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("item_ids"))


def _covered() -> Column:
    """Words that lie in any of the hit windows: length of the union of [pos, pos + len)."""
    return F.aggregate(
        F.array_sort(F.transform("hits", lambda h: F.struct(h["pos"], h["len"]))),
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, h: F.struct(
            F.greatest(a["to"], h["pos"] + h["len"]).alias("to"),
            (a["n"] + F.greatest(F.lit(0), h["pos"] + h["len"] - F.greatest(a["to"], h["pos"]))).alias("n")),
        lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, item_ids, spans
    (word positions from 1, half-open), contaminated.

    A word is hit if it lies in any occurrence of a benchmark window. Null and blank texts have
    no words. Repeated rows are scanned apart and come back as often as they came. An empty
    benchmark hits nothing; empty documents give an empty result. Other columns are ignored.
    Every task scans whole texts and hands on one row per document and one per hit."""
    grams = benchmark_windows(benchmark, window)
    lengths = [r.len for r in grams.select("len").distinct().collect()]  # at most `window` numbers
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
                        normal_words(F.col(text_col)).alias("words"))
    none = "array(named_struct('pos', 0, 'len', 0, 'gram', cast(null as string)))"
    every = f"concat({', '.join([none, *(_windows('words', str(n)) for n in sorted(lengths))])})"
    rows = texts.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.expr(f"inline({every})"))
    known = grams.select(F.col("gram").alias("g"), "item_ids")
    if known.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    met = rows.join(known, F.col("gram") == F.col("g"), "left").where("pos = 0 or g is not null")
    per = met.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.sum((F.col("pos") == 0).cast("int")).alias("copies"),
        F.collect_set(F.when(F.col("pos") > 0, F.struct("pos", "len", "item_ids"))).alias("hits"))
    return per.select(
        "doc_id", "text_hash", "n_words", _covered().alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["item_ids"])))).alias("item_ids"),
        F.array_sort(F.transform("hits", lambda h: F.struct(h["pos"].alias("start"), (h["pos"] + h["len"]).alias("end")))).alias("spans"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
    ).drop("_copy").withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents that hold any benchmark window; all columns stay as they
    are. A row is known by its doc_id and text, nulls included, so equal rows fare alike."""
    bad = (contamination(docs, benchmark, window).where("contaminated")
           .select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) &
                     (F.xxhash64(docs["text"].cast("string")) == bad["bad_hash"]), "left_anti")
