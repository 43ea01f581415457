"""N-gram Jaccard join in metric space (exact).

1 - Jaccard similarity is a metric on shingle sets, so pivots, Voronoi regions and
triangle-inequality windows can cut the join. Document pivots alone cut nothing in raw text:
unrelated texts all lie at distance 1 of every pivot. So the regions are laid in three steps.

1. The empty set is the first pivot: by the symmetric difference, a set lies at the distance of
   its size. Rings of sizes are its regions; a set near the upper rim, within the window that
   the triangle inequality leaves to a partner in a higher ring, is replicated there.
2. In a ring, pivots spaced evenly on the hash line cut every set into its Voronoi parts. Linked
   sets differ in at most D elements, so of D + need + spare parts at least ``need`` + spare are
   equal, and ``need`` that aren't empty if one of the two has ``spare`` empty ones at most. A region
   holds the sets with one and the same part, and linked sets share ``need`` regions or more.
   The least set of a region is its pivot. Sets that share so many regions with one pivot form a
   group; pairs that never meet in a group are found by counting the common regions of groups,
   and those groups then join as one.
3. Groups join recursively (``_meet``): document pivots, whose distances do tell near copies
   apart, make Voronoi regions, windows of twice the radius replicate boundary sets into other
   regions, and each region joins by itself, down to small ones that compare all pairs at once.

Links give components; inside each component the same recursion counts every set's links.
Copies with equal sets are one point throughout. Nothing is capped: a group that is too large
for a task is cut into tiles, and every pair of tiles is a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.llm.common import SPACE_WORDS, U64, Words, chunks, mix, shingle_sets, signed, small, stored, text_bytes
from signalspark.llm.components import connected_components
from signalspark.session import checkpoint_dir, ship_package

#: Members up to which a region lists its pairs; pairs of larger ones must share two of them.
CROWDED = 200
#: Shingles (8 bytes each) of a tile; a task holds two tiles.
TILE = 400_000
#: Members from which a region is cut by pivots, and the pivots.
LEAF, PIVOTS = 96, 6
#: Sets of a side that are compared at once (a matrix of 2 * BLOCK rows and 4,096 elements), and links that are held before they count.
BLOCK, HELD_LINKS = 512, 1_000_000
#: Rounds that take out what no stray pair can hold, and that merge units (each exact; more only save work).
PEELS, MERGES = 2, 2
#: Arrow batches to and from Python, as in ``lm_score``; a batch has a copy or two on both sides.
BATCH_BYTES = 8 * 1024 * 1024
#: Set ids that may be broadcast to pick out sets (8 bytes each).
BROADCAST_IDS = 2_000_000
#: More than the rings of sizes; a region's row bears size * RINGS + ring.
RINGS = 128


def rings(percent: int) -> list[tuple[int, int, int, int]]:
    """(low, high, parts, spare) of each ring of set sizes, up to sizes no text reaches."""
    out, high = [], 0
    while high < 2**40:
        low, high = high + 1, max(high + 3, high * 3 // 2)
        differ = 2 * high * (100 - percent) // (100 + percent)
        spare = differ // 6
        out.append((low, high, differ + 1 + 2 * spare, spare))  # need is 1 + spare; as many empty parts as spare may be left out
    return out


def _of_ring(percent: int, ring: Column, value) -> Column:
    return F.element_at(F.array(*[F.lit(value(*r)) for r in rings(percent)]), ring.cast("int") + 1)


def _least_need(percent: int, ring: Column) -> Column:
    """Regions that any two linked sets of a ring share at least."""
    return _of_ring(percent, ring, lambda low, high, parts, spare: 1 + spare)


def _pair_need(percent: int, ring: Column, a: Column, b: Column) -> Column:
    """Regions of a ring that linked sets of at most a and b elements share at least: they differ in
    at most (a + b) (100 - percent) / (100 + percent) elements, and so many parts at most are unequal."""
    return (_of_ring(percent, ring, lambda low, high, parts, spare: parts - spare)
            - F.floor((a + b) * (100 - percent) / F.lit(100 + percent)))


def _own_need(percent: int, ring: Column, size: Column) -> Column:
    """Regions of a ring that a set of at most ``size`` elements shares at least with any set it links with."""
    most = F.least(_of_ring(percent, ring, lambda low, high, parts, spare: high), F.floor(size * 100 / F.lit(percent)))
    return _pair_need(percent, ring, size, most)


def _alike(percent: int, low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Whether sizes of the two ranges allow a link."""
    return (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)


def set_id(s: np.ndarray) -> np.uint64:
    """Id of a sorted set of hashes: equal for equal sets, 0 for the empty one."""
    return U64(0) if not len(s) else mix(np.add.reduce(mix(s ^ U64(0xA5A5)), keepdims=True) + U64(len(s)))[0]


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in chunks(batches, "text"):
        yield part, shingle_sets(Words(*text_bytes(part.column("text")), SPACE_WORDS), k)


def _describe(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for part, sets in _sets(batches, k):
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
            signed(np.array([set_id(s) for s in sets], U64)), part.column("th")], ["doc_id", "n", "set_id", "th"])


def _contents(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(set_id, body) of every distinct set, once per task, so that copies cost little."""
    done: set = set()
    for _, sets in _sets(batches, k):
        new = {}
        for s in sets:
            if len(s) and (own := set_id(s)) not in done:
                done.add(own)
                new[own] = s.tobytes()
        if len(done) > 1_000_000:
            done.clear()
        yield pa.RecordBatch.from_arrays([signed(np.array(list(new), U64)), pa.array(list(new.values()), pa.binary())], ["set_id", "body"])


def _parts(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Region keys of every distinct set: one row for each of its parts in its ring, and in each
    higher ring that a partner may lie in. A set is emitted once per task, so that copies cost little."""
    bands, done = rings(percent), set()
    highs = np.array([b[1] for b in bands])
    cuts: dict[int, np.ndarray] = {}
    for _, sets in _sets(batches, k):
        keys, ids, needs, codes = [], [], [], []
        for s in sets:
            own = set_id(s)
            if not len(s) or own in done:
                continue
            done.add(own)
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(s + U64(0x51ED)))])
            ring = int(np.searchsorted(highs, len(s)))
            for r in range(ring, len(bands)):
                low, _, n, spare = bands[r]
                if r > ring and 100 * len(s) < percent * low:
                    break
                if n == 1:
                    continue
                if n not in cuts:
                    if len(cuts) > 64:
                        cuts.clear()
                    cuts[n] = np.array([(c << 64) // n for c in range(1, n)], U64)
                edge = np.concatenate([[0], np.searchsorted(s, cuts[n]), [len(s)]])
                part = mix(sums[edge[1:]] - sums[edge[:-1]] + mix(np.arange(n, dtype=U64) + U64(r << 40)))
                full = edge[1:] > edge[:-1]
                # up to spare empty parts are left out: linked sets have 1 + 2 * spare equal parts, so 1 + spare full ones
                if n - int(full.sum()) <= spare:
                    part = part[full]
                keys.append(part)
                ids.append(np.full(len(part), own, U64))
                needs.append(np.full(len(part), 1 + spare, np.int32))
                codes.append(np.full(len(part), len(s) * RINGS + r, np.int64))
        if len(done) > 1_000_000:
            done.clear()
        if keys:
            yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), signed(np.concatenate(ids)),
                                              pa.array(np.concatenate(needs)), pa.array(np.concatenate(codes))], ["region", "set_id", "need", "code"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def described(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, set_id, th) of every row of ``docs``; th is a hash of the text."""
    ship_package(docs.sparkSession)
    t = _texts(docs, id_col, text_col)
    kind = t.schema["doc_id"].dataType.simpleString()
    return t.mapInArrow(partial(_describe, k=k), f"doc_id {kind}, n long, set_id long, th long")


def _bodies(texts: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (set_id, th, ...) with the body of their set. Only texts of a wanted hash are read
    into sets, and of copies one, so that a group gets each body once however many tasks hold a copy."""
    held = texts.join(small(wanted.select("th").distinct(), BROADCAST_IDS), "th", "left_semi").select("th", "text").distinct()
    every = held.mapInArrow(partial(_contents, k=k), "set_id long, body binary")
    return every.join(small(wanted.drop("th"), BROADCAST_IDS), "set_id")


def _regions(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(region, ring, set_id, size, pivot, pivot_size, second) of every member but the pivot, the least
    one, of each region; second marks the least of them.

    The window streams a sorted region: it looks one row back and at the first, never at all."""
    rows = texts.select("doc_id", "text").mapInArrow(partial(_parts, k=k, percent=percent), "region long, set_id long, need int, code long").drop("need")
    w = Window.partitionBy("region").orderBy("set_id")
    rows = (rows.withColumn("before", F.lag("set_id").over(w)).withColumn("pivot", F.first("set_id").over(w)).withColumn("lead", F.first("code").over(w))
            .where("set_id <> pivot and set_id <> before"))
    size = lambda c: F.floor(F.col(c) / RINGS)
    return stored(rows.select("region", (F.col("code") % RINGS).cast("int").alias("ring"), "set_id", size("code").alias("size"), "pivot",
                              size("lead").alias("pivot_size"), (F.col("before") == F.col("pivot")).alias("second")))


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs: a product of membership matrices, in blocks of elements."""
    out = np.zeros((len(x), len(y)), np.float32)
    if not len(x) or not len(y):
        return out
    sizes = np.array([len(s) for s in (*x, *y)])
    values, code, n = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    some = n[code] > 1  # others are in one set only
    code, row = (np.cumsum(n > 1) - 1)[code[some]], row[some]
    by = np.argsort(code, kind="stable")
    code, row = code[by], row[by]
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        lo, hi = np.searchsorted(code, (at, at + 4096))
        m = np.zeros((len(sizes), 4096), np.float32)
        m[row[lo:hi], code[lo:hi] - at] = 1
        out += m[:len(x)] @ m[len(x):].T
    return out


class _Links:
    """Links of one pair of tiles, taken as they are found: as counts for each set or as what they tie together."""

    def __init__(self, copies: np.ndarray | None, n: int):
        self.copies, self.links, self.root = copies, np.zeros(n, np.int64), np.arange(n)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def append(self, pair: tuple[np.ndarray, np.ndarray]) -> None:
        self.held.append(pair)
        if sum(len(x) for x, _ in self.held) >= HELD_LINKS:
            self.take()

    def take(self) -> None:
        if not self.held:
            return
        i, j = (np.concatenate([h[c] for h in self.held]) for c in (0, 1))
        self.held.clear()
        if self.copies is not None:
            np.add.at(self.links, i, self.copies[j])
            np.add.at(self.links, j, self.copies[i])
            return
        root = self.root
        while (root[i] != root[j]).any():
            least = np.minimum(root[i], root[j])
            for end in (root[i], root[j]):
                np.minimum.at(root, end, least)
            while (root[root] != root).any():
                root[:] = root[root]


def _compare(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, found: _Links | list, once: bool = False) -> None:
    """Links of ``left`` with ``right``, block by block; ``once``: right begins with left, and a pair counts once."""
    sizes = np.array([len(s) for s in sets])
    for at in range(0, len(left), BLOCK):
        for to in range(at if once else 0, len(right), BLOCK):
            a, b = left[at:at + BLOCK], right[to:to + BLOCK]
            c = _common([sets[i] for i in a], [sets[j] for j in b])
            linked = 100 * c >= percent * (sizes[a][:, None] + sizes[b][None, :] - c) - 1e-3
            i, j = np.nonzero(np.triu(linked, 1) if once and at == to else linked)
            found.append((a[i], b[j]))


def _meet(sets: list[np.ndarray], home: np.ndarray, guest: np.ndarray, percent: int, found: _Links | list) -> None:
    """Links among ``home``, and between home and ``guest``, by recursive Voronoi regions.

    A pair is met once: in the region that both are at home in, or in the lesser of their two
    homes, where the other one is a guest if the window lets it in. found gets (i, j) arrays."""
    every = np.concatenate([home, guest])
    if len(home) > LEAF:
        pivots = home[:: len(home) // PIVOTS][:PIVOTS]
        d = np.empty((len(every), len(pivots)))
        for at in range(0, len(every), BLOCK):
            some = every[at:at + BLOCK]
            c = _common([sets[i] for i in some], [sets[i] for i in pivots])
            d[at:at + BLOCK] = 1 - c / (np.array([len(sets[i]) for i in some])[:, None] + np.array([len(sets[i]) for i in pivots])[None, :] - c)
        near, cell = d.min(1), d.argmin(1)[:len(home)]
        if np.bincount(cell).max() < 0.8 * len(home):
            window = d <= near[:, None] + 2 * (1 - percent / 100) + 1e-6
            for r in range(len(pivots)):
                if (cell == r).any():
                    visits = home[(cell > r) & window[:len(home), r]]
                    _meet(sets, home[cell == r], np.concatenate([visits, guest[window[len(home):, r]]]), percent, found)
            return
    _compare(sets, home, every, percent, found, once=True)


def _tile(rows: pa.Table, percent: int, count: bool) -> pa.Table:
    """Links of one pair of tiles: as counts for each set, or as edges that span what is linked."""
    ids, first = np.unique(rows.column("set_id").to_numpy(), return_index=True)
    rows = rows.take(pa.array(first))
    body, cuts = text_bytes(rows.column("body").combine_chunks())
    sets = [body[cuts[i]:cuts[i + 1]].view(U64) for i in range(len(ids))]
    side = rows.column("side").to_numpy()
    found = _Links(rows.column("copies").to_numpy() if count else None, len(ids))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(right) and len(left):  # pairs of a tile with itself are met elsewhere
        _compare(sets, left, right, percent, found)
    elif rows.column("alone")[0].as_py():
        _meet(sets, np.arange(len(sets)), np.zeros(0, np.int64), percent, found)
    found.take()
    if count:
        return pa.table({"set_id": ids, "links": found.links})
    tied = found.root != np.arange(len(ids))
    return pa.table({"a": ids[found.root[tied]], "b": ids[tied]})


def _tiled(texts: DataFrame, k: int, percent: int, groups: DataFrame, sets: DataFrame, count: bool) -> DataFrame:
    """Runs ``_tile`` on groups (gid, set_id): as edges (a, b), or as counts (set_id, links).

    sets: (set_id, n, copies, th). A group of more shingles than a tile holds is cut by hash into
    tiles; each pair of tiles, and each tile with itself, is one task."""
    rows = groups.join(sets, "set_id")
    cut = rows.groupBy("gid").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"))
    rows = rows.join(cut, "gid").withColumn("tile", F.pmod(F.xxhash64("set_id"), "tiles").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("set_id", "th", "copies", "gid", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
                       (F.col("tile") > F.col("other")).cast("int").alias("side"), (F.col("tile") == F.col("other")).alias("alone"))
    dealt = _bodies(texts, k, stored(rows)).groupBy("gid", "i", "j")
    return dealt.applyInArrow(lambda rows: _tile(rows, percent, count), "set_id long, links long" if count else "a long, b long")


def _tiled_pairs(texts: DataFrame, k: int, percent: int, sides: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between the two sides of groups (gid, side: 0 or 1, set_id), tiles of one with tiles of the other."""
    rows = sides.join(sets, "set_id")
    cut = rows.groupBy("gid").agg(*[F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("side") == x, F.col("n"))) / TILE)).cast("int").alias(f"tiles_{x}") for x in (0, 1)])
    rows = rows.join(cut, "gid").withColumn("own", F.pmod(F.xxhash64("set_id"), F.when(F.col("side") == 0, F.col("tiles_0")).otherwise(F.col("tiles_1"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("tiles_1")).otherwise(F.col("tiles_0")) - 1)))
    left = F.col("side") == 0
    rows = rows.select("set_id", "th", "copies", "gid", F.when(left, F.col("own")).otherwise(F.col("other")).alias("i"),
                       F.when(left, F.col("other")).otherwise(F.col("own")).alias("j"), "side", F.lit(False).alias("alone"))
    dealt = _bodies(texts, k, stored(rows)).groupBy("gid", "i", "j")
    return dealt.applyInArrow(lambda rows: _tile(rows, percent, False), "a long, b long")


def _open_rows(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (region, ring, unit, weak, high, ...) without the units that no stray pair can hold: its
    units share regions of several units with a weak one each, as many as their greatest set needs.
    Exact at every round."""
    for _ in range(PEELS):
        several = rows.groupBy("region").agg(F.max("weak").alias("any"), (F.min("unit") < F.max("unit")).alias("several"))
        rows = rows.join(several.where("any and several").select("region"), "region", "left_semi")
        enough = rows.groupBy("unit", "ring").agg(F.countDistinct("region").alias("n"), F.max("high").alias("high"))
        enough = enough.where(F.col("n") >= _own_need(percent, F.col("ring"), F.col("high")))
        rows = stored(rows.join(enough.select("unit", "ring"), ["unit", "ring"], "left_semi"))
    return rows


def _merge_units(units: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(units, edges): each unit that shares enough regions with a unit that leads them becomes
    one with it; edges (a, b) tell which. Each row meets its region's leader only, never all."""
    degree = units.groupBy("unit").agg(F.count("*").alias("d"))
    lead = units.join(degree, "unit").groupBy("region").agg(F.max(F.struct("d", "unit", "weak", "low", "high")).alias("lead"))
    near = stored(units.join(lead, "region").where("unit <> lead.unit and (weak or lead.weak)")
            .groupBy("unit", "ring", F.col("lead.unit").alias("leader"))
            .agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("lead.low").alias("lead_low"), F.max("lead.high").alias("lead_high"))
            .where(_possible(percent, "low", "high", "lead_low", "lead_high", F.col("n")))
            .groupBy("unit").agg(F.max(F.struct("n", "leader")).alias("m")).select("unit", "m.leader"))
    units = (units.join(near, "unit", "left").withColumn("unit", F.coalesce("leader", "unit"))
             .groupBy("region", "ring", "unit").agg(F.max("weak").alias("weak"), F.min("low").alias("low"), F.max("high").alias("high")))
    return units, near.select(F.col("unit").alias("a"), F.col("leader").alias("b"))


def _possible(percent: int, low_a: str, high_a: str, low_b: str, high_b: str, n: Column) -> Column:
    """Whether units with sets of such sizes may link if they share n regions of ``ring``."""
    ends = [F.col(c) for c in (low_a, high_a, low_b, high_b)]
    return _alike(percent, *ends) & (n >= _pair_need(percent, F.col("ring"), ends[1], ends[3]))


def _met_in(rows: DataFrame, key: str) -> DataFrame:
    """Pairs of units of one key, with the other columns of both sides."""
    sides = [rows.select(key, *[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != key]) for x in "ab"]
    return sides[0].join(sides[1], key).where("unit_a < unit_b")


def _stray_groups(regions: DataFrame, met: DataFrame, roots: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sets that may link though they share no group yet: groups (gid, set_id) whose sets may all
    link, and groups (gid, side, set_id) of which those of one side may link with those of the other.

    In each region that such a pair shares, one of the two isn't in the group of the pivot, and
    the pair shares as many such regions as its sizes ask for. Sets of one main group have met, so
    main groups are the units here; what two sets share, their units share. Units that share enough
    with the leader of their regions become one (``_merge_units``), so that a large group of near
    copies is few units, and only then are pairs of units listed, each to be met by itself. Where
    regions are still crowded, pairs are listed by two crowded regions at once; a pair that is met in
    others and in no two crowded ones may have one crowded region more."""
    weak = met.where("not strong").select("pivot", "set_id", "ring", F.lit(True).alias("weak"))
    rows = regions.join(weak, ["pivot", "set_id", "ring"], "left").withColumn("weak", F.coalesce("weak", F.lit(False)))
    open_ = rows.groupBy("region").agg(F.max("weak").alias("any")).where("any")
    # each region's pivot is a member too: it comes with the second one
    rows = stored(rows.join(open_, "region", "left_semi").select("region", "ring", F.expr(
        "inline(if(second, array(named_struct('set_id', set_id, 'size', size, 'weak', weak), named_struct('set_id', pivot, 'size', pivot_size, 'weak', false)), "
        "array(named_struct('set_id', set_id, 'size', size, 'weak', weak))))")))
    strong = met.where("strong")
    main = (strong.select("set_id", "pivot", "n").union(strong.select("pivot", "pivot", "n")).groupBy("set_id", "pivot").agg(F.sum("n").alias("n"))
            .groupBy("set_id").agg(F.max(F.struct("n", "pivot")).alias("m")).select("set_id", F.col("m.pivot").alias("main")))
    # first by sets: those of one root, or of too few open regions, are in no such pair
    rows = rows.join(roots.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("unit", F.col("set_id"))
    several = rows.groupBy("region").agg((F.min(F.coalesce("root", "set_id")) < F.max(F.coalesce("root", "set_id"))).alias("several"))
    rows = rows.join(several.where("several").select("region"), "region", "left_semi").drop("root")
    rows = _open_rows(rows.withColumn("low", F.col("size")).withColumnRenamed("size", "high"), percent)
    rows = stored(rows.join(main, "set_id", "left").withColumn("main", F.coalesce("main", "set_id")))
    ranges = F.max("weak").alias("weak"), F.min("low").alias("low"), F.max("high").alias("high")
    units, edges = rows.groupBy("region", "ring", F.col("main").alias("unit")).agg(*ranges), []
    for _ in range(MERGES):
        units, merged = _merge_units(_open_rows(units, percent), percent)
        edges.append(merged)
    units = _open_rows(units, percent)
    units = units.join(units.groupBy("region").agg(F.count("*").alias("members")), "region")
    units = stored(units.withColumn("crowded", (F.col("members") > CROWDED) & (_least_need(percent, F.col("ring")) > 1)))
    crowds = units.where("crowded").groupBy("unit", "ring").agg(F.count("*").alias("crowds"))
    few = units.where("not crowded").join(crowds, ["unit", "ring"], "left").withColumn("crowds", F.coalesce("crowds", F.lit(0)))
    ends = [F.col("unit_a").alias("a"), F.col("unit_b").alias("b"), F.col("ring_a").alias("ring")]
    spans = [f(f"{c}_{x}").alias(f"{c}_{x}") for x in "ab" for c, f in (("low", F.min), ("high", F.max))]
    alike = _alike(percent, *[F.col(c) for c in ("low_a", "high_a", "low_b", "high_b")])
    pairs = (_met_in(few.select("region", "ring", "unit", "weak", "low", "high", "crowds"), "region").where("weak_a or weak_b").where(alike)
             .groupBy(*ends).agg(F.count("*").alias("n"), F.max(F.least("crowds_a", "crowds_b", F.lit(1))).alias("more"), *spans))
    own = units.where("crowded").groupBy("unit", "ring").agg(F.sort_array(F.collect_set("region")).alias("rs"), *ranges[1:])
    twice = own.select("unit", "ring", "low", "high", F.expr(
        "explode(flatten(transform(rs, (x, i) -> transform(slice(rs, i + 2, size(rs)), y -> xxhash64(x, y)))))").alias("both"))
    # k common crowded regions are met k (k - 1) / 2 times
    again = (_met_in(twice, "both").where(alike).groupBy(*ends).agg(F.count("*").alias("met"), *spans)
             .select("a", "b", "ring", F.lit(0).alias("n"), F.round((1 + F.sqrt(1 + 8 * F.col("met"))) / 2).alias("more"), "low_a", "high_a", "low_b", "high_b"))
    pairs = (pairs.unionByName(again).groupBy("a", "b", "ring").agg(F.sum("n").alias("n"), F.max("more").alias("more"), *spans)
             .where(_possible(percent, "low_a", "high_a", "low_b", "high_b", F.col("n") + F.col("more"))).select("a", "b").distinct())
    members = rows.select("set_id", F.col("main").alias("unit")).distinct()
    joined = reduce(DataFrame.union, edges)
    within = members.join(connected_components(joined), F.col("unit") == F.col("id")).select(F.col("root").alias("gid"), "set_id").distinct()
    for merged in edges:
        members = members.join(merged, F.col("unit") == F.col("a"), "left").select("set_id", F.coalesce("b", "unit").alias("unit"))
    members, pairs = stored(members.distinct()), stored(pairs)
    left = pairs.select(F.col("a").alias("gid"), F.col("a").alias("unit"), F.lit(0).alias("side")).distinct()
    right = pairs.select(F.col("a").alias("gid"), F.col("b").alias("unit"), F.lit(1).alias("side"))
    return stored(within), stored(left.union(right).join(members, "unit").select("gid", "side", "set_id"))


def join_sets(docs: DataFrame, k: int, percent: int, sets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, root) of all sets that link with another, by distinct set ids. sets: (set_id, n, copies, th)."""
    checkpoint_dir(docs.sparkSession)
    ship_package(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    regions = _regions(texts, k, percent)
    met = regions.groupBy("pivot", "set_id", "ring", "size", "pivot_size").agg(F.count("*").alias("n"))
    met = stored(met.withColumn("strong", _possible(percent, "size", "size", "pivot_size", "pivot_size", F.col("n"))))
    strong = met.where("strong").select(F.col("pivot").alias("gid"), "set_id")
    strong = strong.union(strong.select("gid", F.col("gid"))).distinct()
    edges = stored(_tiled(texts, k, percent, strong, sets, count=False))
    roots = stored(connected_components(edges))
    within, between = _stray_groups(regions, met, roots, percent)
    # stored, so that no task runs a Python worker for tiles and another one for components behind it
    more = [stored(_tiled(texts, k, percent, within, sets, count=False))] * (not within.isEmpty())
    more += [stored(_tiled_pairs(texts, k, percent, between, sets))] * (not between.isEmpty())
    return stored(connected_components(reduce(DataFrame.union, more, edges))) if more else roots


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                 text_col: str = "text", links: bool = True) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, set_id[, n_links]).

    Two rows link if 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles
    (words end at ASCII white space; A-Z is lower-cased). component_id is the least id that
    links reach, n_links the number of other rows that the row links with.

    Null, empty and blank texts have an empty set, link with nothing and are their own
    component. A null id takes part, but names a component only if all ids in it are null.
    Repeated rows stay rows of their own. Other columns are ignored. An empty table gives an
    empty result."""
    percent = int(percent)
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    checkpoint_dir(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = described(docs, k, id_col, text_col).checkpoint()
    full = rows.where("n > 0")
    sets = stored(full.groupBy("set_id").agg(F.max("n").alias("n"), F.count("*").alias("copies"), F.min("th").alias("th")))
    roots = join_sets(docs, k, percent, sets, id_col, text_col)
    named = roots.withColumnRenamed("id", "set_id")
    per_set = sets.join(named, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    if links:
        linked = _tiled(_texts(docs, id_col, text_col), k, percent, named.withColumnRenamed("root", "gid"), sets, count=True)
        per_set = per_set.join(linked.groupBy("set_id").agg(F.sum("links").alias("links")), "set_id", "left")
        per_set = per_set.withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    least = full.join(per_set, "set_id").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    about = per_set.join(least, "root").select("set_id", "component_id", *["n_links"] * links)
    out = full.join(about, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "set_id", *["n_links"] * links)
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                      "set_id", *[F.lit(0).cast("long").alias("n_links")] * links)
    return out.unionByName(none)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near duplicates: of each component one row stays, that of the least
    doc_id (null counts as greatest), then of the least hash of the text. Rows with empty sets
    all stay. Needs the columns doc_id and text; keeps all others as they are."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    held = jaccard_join(docs.select(key.alias("doc_id"), "text"), k, percent, links=False).where("n_shingles > 0").checkpoint()
    gone = held.where("doc_id <> component_id").select("doc_id.*").distinct()
    match = docs["doc_id"].eqNullSafe(gone["id"]) & (F.xxhash64(docs["text"]) == gone["th"])
    left = docs.join(gone, match, "left_anti")
    again = held.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id.*")
    if again.isEmpty():
        return left
    # rows that repeat a kept row, id and text alike
    twice = left["doc_id"].eqNullSafe(again["id"]) & (F.xxhash64(left["text"]) == again["th"])
    return left.join(again, twice, "left_anti").unionByName(
        left.join(again, twice, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"))
        .groupBy("row.doc_id", F.xxhash64("row.text").alias("th")).agg(F.first("row").alias("row")).select("row.*"))
