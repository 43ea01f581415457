"""Stages of the pipeline and their operators on nulls, repeats, empty tables and columns of clashing names."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalspark.llm import components, jaccard_join, line_dedup

SF = "/root/testdata/sf0.001"
NAMES = ["_key", "_id", "n_lines", "_th", "_runs", "row", "at", "runs", "id", "body", "left", "gone_id", "cut", "every", "th"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in NAMES)


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *range(len(NAMES))) for i, t in rows], SCHEMA)


def _rows():
    rng = random.Random(1)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    long = line(40)
    base = line(60)
    return [(1, f"{line(5)}\n{long}\n{line(6)}"), (2, f"{line(7)}\n{long}\n{line(9)}"), (3, base), (4, base), (4, base), (5, base + " more"), (6, None), (7, ""), (8, " \n"),
            (None, line(30)), (None, line(30)), (None, None), (9, line(3000))]


def test_lines_keep_columns_of_any_name(spark):
    docs = _docs(spark, _rows())
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_deleted"] and out.count() == docs.count()
    for r in out.collect():
        assert [r[n] for n in NAMES if n != "n_lines"] == [i for i, n in enumerate(NAMES) if n != "n_lines"]
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert {r.doc_id: r.n_deleted for r in out.where("doc_id in (1, 2)").collect()} == {1: 0, 2: 1}
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (3, 4, 5)").count() == 1


def test_filter_copies_no_line_logic(spark):
    docs = _docs(spark, _rows())
    stage = corpus_pipeline.delete_lines(spark, docs, SF)
    plan = stage._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = _docs(spark, _rows())
    out = stage(spark, docs, SF)
    if name != "bpe":
        assert out.columns == docs.columns
        assert all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in out.collect())
        left = {(r.doc_id, r.text) for r in out.collect()}
        assert (6, None) in left and (7, "") in left and any(i == 9 for i, _ in left)
    else:
        assert out.count() == docs.count()
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_components_of_merged_parts(spark, monkeypatch):
    monkeypatch.setattr(components, "MERGE_EDGES", 50)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300) if i % 30] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(None, 4), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in root)
    text = components.connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string"))
    assert {tuple(r) for r in text.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_texts_of_one_template_are_not_all_compared(spark, monkeypatch):
    """Texts that share half of their words with all others, but link with none, are told apart by
    the regions that they share; before, they formed one group in which all pairs were compared."""
    from signalspark.llm import jaccard_join
    dealt = []
    plain, sided = jaccard_join._tiled, getattr(jaccard_join, "_tiled_pairs", None)
    monkeypatch.setattr(jaccard_join, "_tiled", lambda texts, k, percent, groups, sets, count: (dealt.append(groups.count()), plain(texts, k, percent, groups, sets, count))[1])
    if sided:
        monkeypatch.setattr(jaccard_join, "_tiled_pairs", lambda texts, k, percent, sides, sets: (dealt.append(sides.count()), sided(texts, k, percent, sides, sets))[1])
    common = " ".join(f"c{i}" for i in range(200))
    rows = [(i, common + " " + " ".join(f"w{i}.{j}" for j in range(100 + i % 7))) for i in range(80)]
    rows += [(100 + i, " ".join(f"n{j}" if j != 40 * i else "x" for j in range(300))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs, 5, 80, links=False).collect()}
    assert got == {i: 100 if i >= 100 else i for i, _ in rows}
    assert sum(dealt) < 40


@pytest.fixture
def tasks_of(spark):
    """Counts the tasks of a call with 32 shuffle partitions that stay apart."""
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    def count(name, call):
        spark.sparkContext.setJobGroup(name, name)
        out, track = call(), spark.sparkContext.statusTracker()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        stages = {s for j in track.getJobIdsForGroup(name) for s in track.getJobInfo(j).stageIds}
        return out, sum(i.numCompletedTasks for i in map(track.getStageInfo, stages) if i)
    yield count
    for c, value in before.items():
        spark.conf.set(c, value)


def test_components_take_few_tasks(spark, tasks_of):
    chain = spark.createDataFrame([(i, i + 1) for i in range(400) if i % 100 != 99], "a long, b long").repartition(32)
    got, tasks = tasks_of("components", lambda: components.connected_components(chain).collect())
    assert {r.id: r.root for r in got} == {i: i // 100 * 100 for i in range(400)}
    assert tasks < 300  # 32 for each step of a round otherwise


def test_large_components_take_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_EDGES", 20)
    chain = spark.createDataFrame([(i, i + 1) for i in range(400) if i % 100 != 99] * 2 + [(500, 500), (None, 3)], "a long, b long").repartition(9)
    assert {r.id: r.root for r in components.connected_components(chain).collect()} == {i: i // 100 * 100 for i in range(400)}


def test_join_takes_few_tasks(spark, tasks_of):
    rng = random.Random(3)
    line = lambda n: " ".join(f"w{rng.randint(0, 500)}" for _ in range(n))
    base = [line(80) for _ in range(30)]
    docs = spark.createDataFrame([(i, base[i % 30] + (f" x{i}" if i % 4 else "")) for i in range(120)], "doc_id long, text string").repartition(4)
    got, tasks = tasks_of("join", lambda: jaccard_join.jaccard_join(docs, 4, 85).collect())
    assert {r.doc_id: r.component_id for r in got} == {i: i % 30 for i in range(120)}
    assert tasks < 1800  # 1,100 as written; every table read in 32 tasks and every last stage run twice otherwise


def test_tiles_are_compared_in_blocks():
    """1,500 near copies link with each other; neither the matrices nor the pairs are held whole (74 MB before)."""
    rng = np.random.default_rng(1)
    core = rng.integers(0, 2**60, 90, dtype=np.uint64)
    sets = [np.unique(np.append(core, rng.integers(0, 2**60, 2, dtype=np.uint64))) for _ in range(1500)]

    class Seen:
        n = 0

        def append(self, pair):
            self.n += len(pair[0])
    seen = Seen()
    tracemalloc.start()
    jaccard_join._meet(sets, np.arange(1500), np.zeros(0, np.int64), 85, seen)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen.n == 1500 * 1499 // 2 and peak < 45e6


def test_groups_get_each_body_once(spark):
    """Copies lie in all tasks; a body goes to its group once, not once for each task."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, text if i % 2 else text + " x") for i in range(40)], "doc_id long, text string").repartition(8)
    rows = jaccard_join.described(docs, 4)
    wanted = rows.groupBy("set_id").agg(F.min("th").alias("th"))
    got = jaccard_join._bodies(jaccard_join._texts(docs, "doc_id", "text"), 4, wanted).collect()
    assert sorted(len(r.body) for r in got) == [8 * 27, 8 * 28]
