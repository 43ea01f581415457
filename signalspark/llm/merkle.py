"""Merkle dataset manifest: hash trees by cogrouped exchange of subtrees.

Rows are numbered within their group by a range sort, so a superblock is a bounded run of
neighbouring nodes whoever owns them. Upwards, every superblock folds to one node; downwards,
each one is cogrouped with the outer nodes that its proofs need, and one call finishes the
local reduction, joins the proofs and folds the claimed leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.llm.common import small
from signalspark.session import checkpoint_dir, ship_package

#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of one superblock, which holds at most RUN ** LEVELS nodes.
RUN, LEVELS = 2, 12
#: Rows of a task of the exchange, and narrow rows that a numbering join broadcasts at most.
TASK_ROWS, BROADCAST_ROWS = 1_000_000, 1_000_000

NODE = "grp string, pos long, n long, h string"
OUTER = "grp string, block long, path string, subroot string, root string"


def digest(parts: Iterable[str]) -> str:
    """Lowercase hex SHA-256 of the parts in a row."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: Iterable[Column]) -> Column:
    """Leaf digest: each value as its UTF-8 byte count, a colon and the value; null as a dash."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told), 256)


def reduce_levels(nodes: list[str], n: int, run: int = RUN, levels: int = LEVELS) -> list[list[str]]:
    """All levels over the nodes of one superblock, of a tree that has ``n`` nodes at this height.

    A tree that fits one superblock is reduced to its root, a larger one by exactly ``levels``:
    its last superblock goes on alone, since the whole level still has several nodes."""
    out = [nodes]
    while len(out) <= levels and (n > run ** levels or len(out[-1]) > 1):
        below = out[-1]
        out.append([digest(below[i:i + run]) for i in range(0, len(below), run)])
    return out


def siblings(levels: list[list[str]], at: int, run: int = RUN) -> list[tuple[str, str]]:
    """Digests left and right of node ``at`` in its run, level by level upwards."""
    out = []
    for level in levels[:-1]:
        first = at - at % run
        out.append(("".join(level[first:at]), "".join(level[at + 1:first + run])))
        at //= run
    return out


def fold(node: str, path: Iterable[tuple[str, str]]) -> str:
    """The root that a node and its siblings lead to."""
    for left, right in path:
        node = digest((left, node, right))
    return node


def _pack(path: Iterable[tuple[str, str]]) -> str:
    return "".join(f"{left},{right};" for left, right in path)


def _unpack(path: str) -> list[tuple[str, str]]:
    return [tuple(step.split(",")) for step in path.split(";")[:-1]]


def _numbered(df: DataFrame, group: str, order: list[str], ties: list[str]) -> DataFrame:
    """``df`` with pos (from 0) and n (size) within its group, ordered by ``order`` and ``ties``.

    A range sort deals a group over many tasks; only row counts by task and group meet."""
    checkpoint_dir(df.sparkSession)
    spread = (df.repartitionByRange(group, *order).sortWithinPartitions(group, *order, *ties)
              .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).checkpoint())
    counts = spread.groupBy(group, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    upto = F.sum("_rows").over(Window.partitionBy(group).orderBy("_part"))
    heads = counts.select(group, "_part", (upto - F.col("_rows") - F.col("_first")).alias("_shift"),
                          F.sum("_rows").over(Window.partitionBy(group)).alias("n"))
    return (spread.join(small(heads, BROADCAST_ROWS), [group, "_part"])
            .withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"))


def _dealt(df: DataFrame, tasks: int) -> DataFrame:
    """One hash partitioning by superblock, the same for both sides of an exchange."""
    return df.repartition(tasks, "grp", "block")


def _tasks(nodes: DataFrame, size: int) -> tuple[int, int]:
    """Tasks that deal a round's superblocks, and the nodes of its largest tree."""
    rows, most = nodes.agg(F.count("*"), F.max("n")).first()
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(spread, -(-rows // size)), -(-rows // TASK_ROWS)), most or 0


def _reduce(pdf: pd.DataFrame, run: int, levels: int) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    n = int(pdf["n"].iloc[0])
    top = reduce_levels(pdf["h"].tolist(), n, run, levels)[-1][0]
    return pd.DataFrame({"grp": pdf["grp"].iloc[:1], "pos": pdf["block"].iloc[:1], "n": [-(-n // run ** levels)], "h": [top]})


def _climb(nodes: DataFrame, run: int, levels: int) -> list[tuple[DataFrame, int]]:
    """The nodes and, round by round, the roots of their superblocks, up to one node a group; with
    the number of tasks that deals each."""
    size = run ** levels
    block = F.expr(f"pos div {size}")
    nodes = nodes.withColumn("block", block)
    tasks, most = _tasks(nodes, size)
    rounds = [(nodes, tasks)]
    while most > 1:
        up = (_dealt(nodes.select("grp", "block", "pos", "n", "h"), tasks).groupBy("grp", "block")
              .applyInPandas(lambda nodes: _reduce(nodes, run, levels), NODE).checkpoint())
        nodes = up.withColumn("block", block)
        tasks, most = _tasks(nodes, size)
        rounds.append((nodes, tasks))
    return rounds


def _share(nodes: pd.DataFrame, outer: pd.DataFrame, run: int, levels: int) -> pd.DataFrame:
    """Paths of a superblock's nodes, which are the outer paths of the superblocks below."""
    nodes, above = nodes.sort_values("pos"), outer.iloc[0]
    tree = reduce_levels(nodes["h"].tolist(), int(nodes["n"].iloc[0]), run, levels)
    return pd.DataFrame({"grp": nodes["grp"], "block": nodes["pos"], "subroot": above["subroot"], "root": above["root"],
                         "path": [_pack(siblings(tree, i, run)) + above["path"] for i in range(len(nodes))]})[["grp", "block", "path", "subroot", "root"]]


def _finish(leaves: pd.DataFrame, outer: pd.DataFrame, run: int, levels: int, proofs: bool) -> pd.DataFrame:
    """Local reduction, proof joining and folding of one superblock of leaves."""
    leaves, above = leaves.sort_values("pos"), outer.iloc[0]
    hashes, claims = leaves["h"].tolist(), leaves["claim"].tolist()
    tree, beyond = reduce_levels(hashes, int(leaves["n"].iloc[0]), run, levels), _unpack(above["path"])
    tail = [a + b for a, b in beyond]
    paths = [siblings(tree, i, run) for i in range(len(hashes))]
    folded = [fold(fold(h if c is None else c, p), beyond) for h, c, p in zip(hashes, claims, paths)]
    out = leaves[["key", "grp"]].copy()
    out["pos"], out["leaf"], out["subroot"], out["root"] = leaves["pos"], hashes, above["subroot"], above["root"]
    out["proof_sha256"] = [digest([a + b for a, b in p] + tail) for p in paths]
    out["folded_root"], out["verified"] = folded, [f == above["root"] for f in folded]
    if proofs:
        out["proof"] = [[a + b for a, b in [*p, *beyond]] for p in paths]
    return out


def _outer_nodes(rounds: list[tuple[DataFrame, int]], outer: DataFrame, run: int, levels: int) -> DataFrame:
    """Outer nodes of every superblock of rounds[0], handed down round by round from those of the last but one."""
    for nodes, tasks in reversed(rounds[1:-1]):
        outer = (_dealt(nodes.select("grp", "block", "pos", "n", "h"), tasks).groupBy("grp", "block").cogroup(_dealt(outer, tasks).groupBy("grp", "block"))
                 .applyInPandas(lambda own, above: _share(own, above, run, levels), OUTER).checkpoint())
    return outer


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id",
                    claimed: dict[str, Column] | None = None, proofs: bool = False, run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """The hash tree of all rows and, per row, its leaf, proof and the root its claim folds to.

    Leaves stand in their group by ``order`` (nulls first), then by digest, so rows that are
    equal in every column are interchangeable; every ``run`` neighbours become the digest of
    their digests, one left over too, until one node is left: the group's subroot. Subroots in
    group order (null first, bytes of UTF-8) make the root in the same way. ``claimed`` names
    columns whose value differs in the copy to verify; its leaf is folded with the original
    siblings, and ``verified`` says whether that gives the root.

    Returns ``order``, ``group``, pos (place in the group), leaf, subroot, root, proof_sha256
    (of all siblings upwards), folded_root, verified, with ``proofs`` also proof (siblings by
    level, joined left to right). Other columns of ``docs`` are not read, so no name clashes.
    Nulls are leaves like any value, a null ``order`` and empty texts too; texts are hashed whole
    in the JVM. An empty table gives an empty result. No task holds more than a superblock,
    ``run ** levels`` nodes of 64 hex digits."""
    ship_package(docs.sparkSession)
    types = dict(docs.dtypes)
    claim = leaf((claimed or {}).get(c, F.col(c)) for c in columns)
    own = leaf(F.col(c) for c in columns)
    marked = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    rows = docs.select(F.col(order).alias("key"), marked.alias("grp"), own.alias("h"),
                       (F.nullif(claim, own) if claimed else F.lit(None).cast("string")).alias("claim"))
    rows = _numbered(rows, "grp", ["key"], ["h"])
    rounds = _climb(rows, run, levels)
    tops = _numbered(rounds[-1][0].select(F.lit("").alias("all"), F.col("grp").alias("key"), "h"), "all", ["key"], [])
    heads = _climb(tops.select(F.col("all").alias("grp"), "key", "pos", "n", "h"), run, levels)
    above = heads[-1][0].select("grp", "block", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("h").alias("root"))
    paths = _outer_nodes([heads[0], *heads], above, run, levels)
    outer = (heads[0][0].select("pos", "key", "h").join(paths.select(F.col("block").alias("pos"), "path", "root"), "pos")
             .select(F.col("key").alias("grp"), F.lit(0).cast("long").alias("block"), "path", F.col("h").alias("subroot"), "root"))
    outer = _outer_nodes(rounds, outer, run, levels)
    leaves, tasks = rounds[0]
    schema = (f"key {types[order]}, grp string, pos long, leaf string, subroot string, root string, proof_sha256 string, "
              f"folded_root string, verified boolean" + (", proof array<string>" if proofs else ""))
    made = (_dealt(leaves.select("key", "grp", "block", "pos", "n", "h", "claim"), tasks).groupBy("grp", "block")
            .cogroup(_dealt(outer, tasks).groupBy("grp", "block"))
            .applyInPandas(lambda own, above: _finish(own, above, run, levels, proofs), schema))
    named = F.when(F.col("grp") == "0", F.lit(None)).otherwise(F.substring("grp", 2, 2**31 - 1)).cast(types[group])
    return made.select(F.col("key").alias(order), named.alias(group), *[c for c in made.columns if c not in ("key", "grp")])
