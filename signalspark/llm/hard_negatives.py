"""Hard-negative mining by cover trees over norm-augmented candidates.

A candidate x gets one more component, sqrt(M^2 - |x|^2) for the greatest norm M, so all lie on
one sphere and near ones are those of great inner product. A node's covering radius r bounds the
inner products of anchor q with all below its centre c: q.c - |q| r to q.c + |q| r. The upper
level, cells around pivots, is shared by all tasks; below it every block of a cell is a tree.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.session import checkpoint_dir, ship_package

#: Rows (least hashes first) that the pivots are chosen from, and pivots at most.
SAMPLE, PIVOTS = 2048, 256
#: Rows of a block, whose tree is built and searched in one task; anchors of one slice of a search.
BLOCK_ROWS, SLICE = 4096, 4096
#: Rows of a leaf, and centres that a node picks at most (farthest first, until half its radius covers).
LEAF, FANOUT = 128, 16
#: Cells that an anchor's first search visits; they give the bound for the rest.
FIRST_CELLS = 2

_LONG = np.iinfo(np.int64)


def _matrix(rows: list) -> np.ndarray:
    """Integer vectors as a matrix of doubles; a shorter one is filled up with zeros."""
    wide = max(map(len, rows), default=0)
    if min(map(len, rows), default=0) == wide:
        return np.array([np.asarray(r, np.float64) for r in rows]).reshape(len(rows), wide)
    return np.array([np.pad(np.asarray(r, np.float64), (0, wide - len(r))) for r in rows]).reshape(len(rows), wide)


def _widen(x: np.ndarray, wide: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, wide - x.shape[1]))) if x.shape[1] < wide else x


def _augment(x: np.ndarray, norm2: float) -> np.ndarray:
    rest = np.maximum(norm2 - (x * x).sum(1), 0)
    return np.column_stack([np.sqrt(rest), x])


def _from(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(1))


def spread_out(points: np.ndarray, most: int, within: float = 0.0) -> tuple[list[int], np.ndarray]:
    """Centres farthest first, until all points lie ``within`` of one; and the nearest centre of each point."""
    centres, owner = [0], np.zeros(len(points), np.int64)
    least = _from(points, points[0])
    while len(centres) < most and least.max() > within:
        centres.append(int(least.argmax()))
        d = _from(points, points[centres[-1]])
        nearer = d < least
        owner[nearer], least = len(centres) - 1, np.minimum(least, d)
    return centres, owner


class CoverTree:
    """Nested covers of some points: per node a centre, the radius that covers all below, and its
    children (or, in a leaf, its rows). Children follow their parent, rows of a leaf lie together."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, norm2: float):
        full, order = _augment(points, norm2), []
        parent, centres, radii, heads = [-1], [0], [], []
        todo = [np.arange(len(points))]
        for node, rows in enumerate(todo):  # the list grows on the way
            middle = centres[node]
            far = _from(full[rows], full[middle])
            radii.append(float(far.max(initial=0.0)))
            heads.append((len(order), len(rows)))
            if len(rows) <= LEAF or radii[-1] == 0.0:
                order.extend(rows[np.argsort(ids[rows], kind="stable")])
                continue
            heads[-1] = (-1, 0)
            rows = np.concatenate([[middle], rows[rows != middle]])
            picked, owner = spread_out(full[rows], min(FANOUT, max(2, -(-len(rows) // LEAF))), radii[-1] / 2)
            for k, c in enumerate(picked):
                parent.append(node)
                centres.append(int(rows[c]))
                todo.append(rows[owner == k])
        self.parent, self.radius, self.heads = np.array(parent), np.array(radii), np.array(heads).reshape(-1, 2)
        self.centre = points[centres]
        self.ids, self.labels, self.points = ids[order], labels[order], points[order]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that the radii allow, per anchor and node."""
        middle = q @ self.centre.T
        reach = np.sqrt((q * q).sum(1))[:, None] * self.radius
        slack = 1 + 1e-9 * (np.abs(middle) + reach)
        return middle - reach - slack, middle + reach + slack

    def leaves(self, alive: np.ndarray, upper: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(anchors, leaf, their bounds) best first, in rounds: every anchor's best leaf, its next two, its
        next four and so on, so that anchors which need a leaf in one round share its product.

        ``alive`` says which nodes an anchor may need; nodes under one that it doesn't are skipped."""
        for node in range(1, len(self.parent)):
            alive[:, node] &= alive[:, self.parent[node]]
        who, leaf = np.nonzero(alive & (self.heads[:, 0] >= 0))
        turn = np.lexsort((-upper[who, leaf], who))
        who, leaf = who[turn], leaf[turn]
        turn = np.log2(1 + np.arange(len(who)) - np.searchsorted(who, who)).astype(np.int64)
        group = np.lexsort((who, leaf, turn))
        who, leaf, turn = who[group], leaf[group], turn[group]
        heads = np.flatnonzero(np.diff(leaf, prepend=-1) | np.diff(turn, prepend=-1))
        for at, to in zip(heads, [*heads[1:], len(who)]):
            yield who[at:to], int(leaf[at]), upper[who[at:to], leaf[at]]

    def scores(self, q: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo, n = self.heads[leaf]
        return q @ self.points[lo:lo + n].T, self.ids[lo:lo + n], self.labels[lo:lo + n]


class _Best:
    """The k best (score, id) of each slot: greater scores first, then smaller ids."""

    def __init__(self, slots: int, k: int, kind: type):
        self.score, self.id = np.full((slots, k), -np.inf, kind), np.full((slots, k), _LONG.max)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` has a row a slot and a column an id (ascending), -inf where an id doesn't count."""
        some = np.flatnonzero(score.max(1, initial=-np.inf) >= np.maximum(self.worst()[slots], np.finfo(np.float64).min))
        slots, score, each = slots[some], score[some], np.arange(len(some))
        s, i = [self.score[slots]], [self.id[slots]]
        for _ in range(min(self.score.shape[1], score.shape[1]) if len(slots) else 0):
            top = score.argmax(1)  # the first of equal ones, so the smallest id
            s.append(score[each, top][:, None])
            i.append(np.where(np.isfinite(s[-1]), ids[top][:, None], _LONG.max))
            score[each, top] = -np.inf
        if len(slots):
            s, i = np.concatenate(s, 1), np.concatenate(i, 1)
            best = np.lexsort((i, -s), axis=1)[:, :self.score.shape[1]]
            self.score[slots], self.id[slots] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def _told(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; one beyond the range of a long is its end."""
    return np.array([min(max(int(s), _LONG.min), _LONG.max) for s in scores], np.int64)


def search_same(tree: CoverTree, q: np.ndarray, label: np.ndarray, least: np.ndarray, k: int) -> _Best:
    """Per anchor the k best rows of its label that score ``least`` or more."""
    best = _Best(len(q), k, q.dtype.type)
    _, upper = tree.bounds(q.astype(np.float64))
    for some, leaf, bound in tree.leaves(upper >= least[:, None], upper):
        some = some[bound >= best.worst()[some]]
        if len(some):
            score, ids, labels = tree.scores(q[some], leaf)
            best.add(some, np.where(labels == label[some][:, None], score, -np.inf), ids)
    return best


def search_windows(tree: CoverTree, q: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> _Best:
    """Per anchor and window (low to high, both in; none where low > high) the k best rows of another label."""
    n, wide = low.shape
    best = _Best(n * wide, k, q.dtype.type)
    lower, upper = tree.bounds(q.astype(np.float64))
    alive = np.zeros(upper.shape, bool)
    for w in range(wide):
        alive |= (upper >= low[:, w, None]) & (lower <= high[:, w, None]) & (low[:, w] <= high[:, w])[:, None]
    for some, leaf, bound in tree.leaves(alive, upper):
        slots = some[:, None] * wide + np.arange(wide)
        open_ = (np.minimum(bound[:, None], high[some]) >= np.maximum(low[some], best.worst()[slots])) & (low[some] <= high[some])
        some = some[open_.any(1)]
        if len(some):
            score, ids, labels = tree.scores(q[some], leaf)
            other = labels != label[some][:, None]
            for w in range(wide):
                fits = other & (score >= low[some, w, None]) & (score <= high[some, w, None])
                best.add(some * wide + w, np.where(fits, score, -np.inf), ids)
    return best


def _points(df: DataFrame, anchors: Column, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows that take part, once each: id, label, integer vector v, whether it is an anchor, and q,
    the digest of label and v."""
    x = F.col("x")
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                      F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(sound)
            .select("id", "label", "anchor", F.transform(x, lambda c: F.floor(c * scale)).alias("v")))
    rows = rows.withColumn("q", F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")), 256))
    return rows.groupBy("q", "id").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.bool_or("anchor").alias("anchor"))


def _cells(points: DataFrame, pivots: np.ndarray, norm2: float) -> DataFrame:
    """``points`` with the cell of the nearest pivot and the distance to it."""
    full = _augment(pivots, norm2)
    half = (full * full).sum(1) / 2

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _augment(_widen(_matrix(b.column("v").to_pylist()), pivots.shape[1]), norm2)
                cell = (half - x @ full.T).argmin(1)
                far = np.sqrt(((x - full[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "cell", "far"])
    return points.mapInArrow(nearest, "q string, id long, label long, v array<long>, cell long, far double")


def _kind(norm2: float) -> type:
    """Doubles hold all inner products below 2^53 exactly, long doubles those of a long."""
    return np.float64 if norm2 < 2**53 else np.longdouble


class _Index:
    """Trees of all blocks as a table, and the bounded upper level: pivots, radii, blocks of each cell."""

    def __init__(self, points: DataFrame, kept: int):
        rows, norm2, wide = points.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)),
                                       F.max(F.size("v"))).first()
        self.norm2, self.wide = float(norm2 or 0.0) * (1 + 1e-12), int(wide or 0)
        sample = points.orderBy(F.xxhash64("q", "id"), "q", "id").limit(SAMPLE).select("v").collect()
        drawn = _widen(_matrix([r.v for r in sample]), self.wide)
        picked = spread_out(_augment(drawn, self.norm2), min(PIVOTS, -(-rows // BLOCK_ROWS)))[0] if rows else []
        self.pivots = drawn[picked]
        # rows of one label and vector score alike: more than the k least ids of them never count
        first = Window.partitionBy("q").orderBy("id")
        some = points.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= kept).drop("_n")
        dealt = _cells(some, self.pivots, self.norm2).checkpoint() if rows else None
        self.cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect() if rows else []
        self.radius, self.splits = np.full(len(picked), -1.0), np.zeros(len(picked), np.int64)
        for c in self.cells:
            self.radius[c.cell], self.splits[c.cell] = c.far, -(-c.n // BLOCK_ROWS)
        if rows:
            parts = F.element_at(F.array(*[F.lit(int(max(s, 1))) for s in self.splits]), (F.col("cell") + 1).cast("int"))
            norm, wide = self.norm2, self.wide

            def build(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values(["id", "q"])
                tree = CoverTree(pdf["id"].to_numpy(), pdf["label"].to_numpy(), _widen(_matrix(pdf["v"].tolist()), wide), norm)
                return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "part": pdf["part"].iloc[:1], "tree": [pickle.dumps(tree)]})
            blocks = max(1, int(sum(self.splits)))
            self.trees = (dealt.withColumn("part", F.pmod(F.xxhash64("id", "q"), parts)).repartition(blocks, "cell", "part")
                          .groupBy("cell", "part").applyInPandas(build, "cell long, part long, tree binary").checkpoint())

    def search(self, asked: DataFrame, choose, find, schema: str) -> DataFrame:
        """``find`` over the trees of the cells that ``choose`` names for each row of ``asked``.

        Both sides meet by (cell, block, slice): a tree is copied once for every SLICE anchors."""
        slices = max(1, -(-asked.count() // SLICE))
        pivots, radius, splits, wide = self.pivots, self.radius, self.splits, self.wide
        fields = asked.schema.names

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                q = _widen(_matrix(b.column("v").to_pylist()), wide)
                middle, reach = q @ pivots.T, np.sqrt((q * q).sum(1))[:, None] * radius
                slack = 1 + 1e-9 * (np.abs(middle) + reach)
                want = choose(b.to_pandas(), middle - reach - slack, middle + reach + slack) & (splits > 0)
                who, cell = np.nonzero(want)
                copies = splits[cell]
                who, part, cell = np.repeat(who, copies), np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies), np.repeat(cell, copies)
                for at in range(0, len(who), 4096):
                    s = slice(at, at + 4096)
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(who[s])).columns, pa.array(cell[s]), pa.array(part[s])], [*fields, "cell", "part"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
        keys = ["cell", "part", "slice"]
        routed = asked.mapInArrow(route, kinds + ", cell long, part long").withColumn("slice", F.pmod(F.xxhash64("q"), F.lit(slices)))
        copies = self.trees.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))
        tasks = max(1, int(self.splits.sum()) * slices)

        def run(trees: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
            if not len(trees) or not len(anchors):
                return find(None, anchors, wide)
            return find(pickle.loads(trees["tree"].iloc[0]), anchors, wide)
        return (copies.repartition(tasks, *keys).groupBy(*keys).cogroup(routed.repartition(tasks, *keys).groupBy(*keys))
                .applyInPandas(run, schema))


def hard_negatives(df: DataFrame, anchors: Column | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """Per anchor and positive the first ``negatives`` rows of another label whose score lies
    between ``low`` and ``high`` percent of the positive's; anchors are the rows where ``anchors``
    holds (all, if None), positives an anchor's first ``positives`` other rows of its label.

    Components become floor(scale * x); scores are exact integer inner products, greater ones
    first, ties by smaller id. Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Rows with a null id, label or vector, or a null or non-finite component take
    no part; rows equal in id, label and vector count once, and a row of an anchor's own id is
    none of its positives. A shorter vector counts as filled up with zeros; a score beyond a long
    is its end. No anchors, no rows or one label give an empty result. Other columns aren't read.

    Pivots are chosen from at most SAMPLE rows; every row is indexed, and the search is exact:
    cells and nodes are left out only where their radius bounds rule them out. Equal vectors of
    one label are searched once; of them only the ids that can be returned are indexed."""
    spark = df.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    points = _points(df, F.lit(True) if anchors is None else anchors, id_col, label_col, vector_col, scale).checkpoint()
    # rows of the anchor's own id may be among its best: mostly one
    more = positives + (points.groupBy("id", "label").count().agg(F.max("count")).first()[0] or 0)
    index = _Index(points.drop("anchor"), max(more, negatives))
    asked = points.where("anchor")
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not index.cells:
        return spark.createDataFrame([], result)
    distinct = asked.groupBy("q").agg(F.first("label").alias("label"), F.first("v").alias("v")).checkpoint()
    kind = _kind(index.norm2)

    def same(tree, rows: pd.DataFrame, wide: int) -> pd.DataFrame:
        if tree is None:
            return pd.DataFrame({"q": np.empty(0, object), **{c: np.empty(0, np.int64) for c in ("id", "score")}})
        x = _widen(_matrix(rows["v"].tolist()), wide).astype(kind)
        best = search_same(_as(tree, kind), x, rows["label"].to_numpy(), rows["least"].fillna(-np.inf).to_numpy(), more)
        who, place = np.nonzero(np.isfinite(best.score))
        return pd.DataFrame({"q": rows["q"].to_numpy()[who], "id": best.id[who, place], "score": _told(best.score[who, place])})

    def nearest_cells(rows, lower, upper):
        order = np.argsort(-upper, axis=1, kind="stable")[:, :FIRST_CELLS]
        want = np.zeros(upper.shape, bool)
        np.put_along_axis(want, order, True, 1)
        return want

    def other_cells(rows, lower, upper):
        return ~nearest_cells(rows, lower, upper) & (upper >= rows["least"].fillna(-np.inf).to_numpy()[:, None])

    found = "q string, id long, score long"
    top = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    first = index.search(distinct.withColumn("least", F.lit(None).cast("double")), nearest_cells, same, found)
    first = first.withColumn("n", F.row_number().over(top)).where(F.col("n") <= more).checkpoint()
    bound = first.where(F.col("n") == more).select("q", F.col("score").cast("double").alias("least"))
    rest = index.search(distinct.join(bound, "q", "left"), other_cells, same, found)
    best = (first.drop("n").union(rest).withColumn("n", F.row_number().over(top)).where(F.col("n") <= more)
            .groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("best"))).checkpoint()

    # every score once: windows of equal positives are the same
    windows = distinct.join(best, "q").select("q", "label", "v", F.array_distinct(F.transform("best", lambda b: b["score"])).alias("scores"))

    def band(rows):
        wide = max(map(len, rows["scores"]), default=0)
        lo, hi = np.full((len(rows), wide), 1.0, kind), np.full((len(rows), wide), 0.0, kind)
        for i, scores in enumerate(rows["scores"]):
            for w, s in enumerate(map(int, scores)):
                lo[i, w], hi[i, w] = -(-s * low // 100), s * high // 100
        return lo, hi

    def crossed_cells(rows, lower, upper):
        lo, hi = band(rows)
        return ((upper[:, None, :] >= lo[:, :, None]) & (lower[:, None, :] <= hi[:, :, None]) & (lo <= hi)[:, :, None]).any(1)

    def windowed(tree, rows: pd.DataFrame, wide: int) -> pd.DataFrame:
        if tree is None:
            return pd.DataFrame({"q": np.empty(0, object), **{c: np.empty(0, np.int64) for c in ("positive_score", "id", "score")}})
        lo, hi = band(rows)
        x = _widen(_matrix(rows["v"].tolist()), wide).astype(kind)
        best = search_windows(_as(tree, kind), x, rows["label"].to_numpy(), lo, hi, negatives)
        slot, place = np.nonzero(np.isfinite(best.score))
        who, w = slot // max(lo.shape[1], 1), slot % max(lo.shape[1], 1)
        of = [int(rows["scores"].iloc[i][j]) for i, j in zip(who, w)]
        return pd.DataFrame({"q": rows["q"].to_numpy()[who], "positive_score": np.array(of, np.int64), "id": best.id[slot, place], "score": _told(best.score[slot, place])})

    hits = index.search(windows, crossed_cells, windowed, "q string, positive_score long, id long, score long")
    third = Window.partitionBy("q", "positive_score").orderBy(F.col("score").desc(), "id")
    hits = (hits.withColumn("rank", F.row_number().over(third)).where(F.col("rank") <= negatives)
            .select("q", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("anchor_id")), 1, positives)
    pairs = (asked.select("q", F.col("id").alias("anchor_id")).join(best, "q").select("q", "anchor_id", F.explode(others).alias("p"))
             .select("q", "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score")))
    return pairs.join(hits, ["q", "positive_score"]).select(*[c.split()[0] for c in result.split(", ")])


def _as(tree: CoverTree, kind: type) -> CoverTree:
    """The tree with its points in the kind of number that scores need."""
    tree.points = tree.points.astype(kind)
    return tree
