"""Quality rules by host.

Every document is held against fixed rules. The failures are summed by host (``source``), each
rule's rates are shrunk towards those of all hosts by an empirical beta prior, and the host's
verdict is joined back: on a host that is worse by a rule than the corpus, documents that fail
that rule go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import SPACE_WORDS, Words, chunks, signed, small, text_bytes
from signalspark.session import checkpoint_dir, ship_package

#: Rules beside the base ones; each is a condition on a document's counts that marks a failure.
RULES = {
    "symbols": "n_words > 0 and 100 * n_symbols > 30 * n_words",
    "lines": "n_lines > 0 and 100 * n_dup_lines > 50 * n_lines",
    "word_size": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
}
#: A host is bad by a rule if its shrunk rate exceeds the corpus rate by so many standard
#: deviations of its posterior (one-sided 95 %).
HOST_EXCESS = 1.645
#: Hosts whose verdicts may be broadcast (some 40 bytes each).
BROADCAST_HOSTS = 500_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        data, offsets = text_bytes(part.column("text"))
        words = Words(data, offsets, SPACE_WORDS, cased=True)
        n = len(offsets) - 1
        sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
        n_words = np.diff(words.first)
        owner = np.repeat(np.arange(n), n_words)
        at, hashed = words.windows(8)
        order = np.lexsort((hashed, owner[at]))  # by text, then by window
        h, o = hashed[order], owner[at][order]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = (h[1:] == h[:-1]) & (o[1:] == o[:-1]) if len(h) else False
        twice = at[order[same[:-1] | same[1:]]]
        step = np.zeros(len(owner) + 1, np.int64)
        np.add.at(step, twice, 1)
        np.add.at(step, twice + 8, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)])
        lines, dups = np.zeros(n, np.int64), np.zeros(n, np.int64)
        whole = data.tobytes()
        for i in range(n):
            full = [x for x in whole[offsets[i]:offsets[i + 1]].split(b"\n") if x.strip()]
            lines[i], dups[i] = len(full), len(full) - len(set(full))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("host"), *map(pa.array, (
                n_words, sums(SPACE_WORDS[data] & ((data & 0xC0) != 0x80)), sums(_SYMBOL[data]), lines, dups,
                np.diff(covered[words.first])))],
            ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"])


def host_rates(checked: DataFrame) -> DataFrame:
    """(host, rule, failed, n, rate, excess): each host's rate of failures by each rule, shrunk by a
    beta prior whose mean and weight are those of all hosts' rates (method of moments), and how many
    standard deviations of its posterior it lies above the corpus rate."""
    by_host = checked.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in RULES])
    rows = by_host.select("host", "n", F.expr("stack({}, {}) as (rule, failed)".format(
        len(RULES), ", ".join(f"'{r}', {r}" for r in RULES))))
    # mean m of all rows; between-host variance v of the rates beyond binomial noise; weight a + b = m (1 - m) / v - 1
    prior = rows.groupBy("rule").agg(
        (F.sum("failed") / F.sum("n")).alias("m"), F.var_pop(F.col("failed") / F.col("n")).alias("v0"),
        F.avg(1 / F.col("n")).alias("noise"))
    prior = prior.withColumn("v", F.greatest(F.lit(1e-6), F.col("v0") - F.col("m") * (1 - F.col("m")) * F.col("noise")))
    prior = prior.select("rule", "m", F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)).alias("weight"))
    rate = (F.col("failed") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight"))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("weight") + 1))
    told = rows.join(F.broadcast(prior), "rule").withColumn("rate", rate)  # one row per rule
    return told.select("host", "rule", "failed", "n", "rate", F.when(spread > 0, (F.col("rate") - F.col("m")) / spread).otherwise(0.0).alias("excess"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, host, n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, base_failed, host_bad, kept.

    base_failed: fewer than 20 words, or over 30 % of the words in 8-word windows that the text
    holds twice, case counting. kept is false if base_failed, or if the document fails a rule by which its host
    is bad (``RULES``, ``HOST_EXCESS``); a document that fails no rule is always kept, and so are all
    but the base failures where hosts don't differ. Null and
    empty texts have no words, so they fail; a null host is a host of its own. Repeated rows
    each count. An empty table gives an empty result; other columns are ignored."""
    checkpoint_dir(docs.sparkSession)
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    rows = texts.mapInArrow(_counts, f"doc_id {kind}, host string, " + ", ".join(f"{c} long" for c in names))
    rows = rows.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    rows = rows.select("*", *[F.expr(c).alias(f"fails_{r}") for r, c in RULES.items()]).checkpoint()
    bad = (host_rates(rows).groupBy("host")
           .agg(F.collect_set(F.when(F.col("excess") > HOST_EXCESS, F.col("rule"))).alias("bad_by")).where("size(bad_by) > 0")
           .withColumnRenamed("host", "bad_host"))
    out = rows.join(small(bad, BROADCAST_HOSTS), F.col("host").eqNullSafe(F.col("bad_host")), "left")
    fails = F.array(*[F.when(F.col(f"fails_{r}"), F.lit(r)) for r in RULES])
    against = F.coalesce(F.arrays_overlap(F.array_compact(fails), F.col("bad_by")), F.lit(False))
    return out.select("doc_id", "host", *names, "base_failed", F.col("bad_by").isNotNull().alias("host_bad"),
                      (~F.col("base_failed") & ~against).alias("kept"))
