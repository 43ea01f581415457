"""The manifest against a plain loop over whole levels, on nulls, ties, repeats and odd sizes."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from signalspark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos long, grp string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, more=0):
    n = None if r[3] is None else r[3] + more
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], n, r[4])))


def _tree(nodes, run):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i:i + run]) for i in range(0, len(levels[-1]), run)])
    return levels


def _path(levels, at, run):
    out = []
    for level in levels[:-1]:
        first = at // run * run
        out.append((level[first:at], level[at + 1:first + run]))
        at //= run
    return out


def _brute(rows, run, changed):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for g in langs}
    trees = {g: _tree([_leaf(r) for r in members[g]], run) for g in langs}
    top = _tree([trees[g][-1][0] for g in langs], run)
    out = []
    for i, g in enumerate(langs):
        for at, r in enumerate(members[g]):
            path = _path(trees[g], at, run) + _path(top, i, run)
            node = _leaf(r, 1 if changed(r) else 0)
            for left, right in path:
                node = _h(*left, node, *right)
            out.append((r[0], g, at, _leaf(r), trees[g][-1][0], top[-1][0], _h(*(x for a, b in path for x in a + b)), node, node == top[-1][0]))
    return out


def _rows(n):
    rows = [(i * 3 - 5, f"s{i % 4}", ["en", "de", "é", "", None][min(i % 9, 4)], None if i % 11 == 0 else i, "x" * (i % 5) + "ü\n", 9, "g") for i in range(n)]
    return [*rows, *rows[:3], (None, None, "en", 3, None, 9, "g"), (None, "a", "en", 3, "", 9, "g"), (None, "a", "en", 3, "", 9, "g"),
            (10**6, "s", "zz", 1, "w " * 200_000, 9, "g")]


@pytest.mark.parametrize(("n", "run", "levels"), [(70, 2, 2), (40, 3, 1), (200, 2, 12), (0, 2, 3)])
def test_manifest_equals_brute_force(spark, n, run, levels):
    rows = _rows(n)
    changed = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), claimed={"n_chars": claim}, run=run, levels=levels, proofs=True)
    told = got.drop("proof").collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in told), key=key) == sorted(_brute(rows, run, changed), key=key)
    for r in got.collect():
        assert _h(*r.proof) == r.proof_sha256


def test_manifest_of_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.merkle_manifest(empty).count() == 0
    one = merkle.merkle_manifest(empty.union(spark.createDataFrame(_rows(1)[:1], SCHEMA))).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == _h()
