"""Hard negatives by bounds along spanning trees of anchors.

Anchors are dealt into trees: minimum spanning trees by the distance of their vectors. In a tile (some trees and a
block of candidates) scores run down a tree. What a parent scores with a candidate, plus or minus the length of the
edge times the candidate's norm, bounds what the child scores with it; only candidates whose bounds overlap the
child's window are scored anew. Other candidates pass their bounds on. The same walk finds positives, whose window
is all above the k-th best so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.shared import small_batches, written
from notewright.llm.vector_search import without_surplus

#: Most bytes of a block of candidates and of a block of anchors as 32-bit integers; anchors of a tree; candidates of a slice.
CANDIDATE_BYTES, ANCHOR_BYTES, TREE, ROWS_AT_ONCE = 16 << 20, 4 << 20, 512, 2048
#: Smaller tables are cut into blocks of a megabyte, up to as many blocks as this, for parallel tiles.
FEW_BLOCKS, LEAST_BYTES = 16, 1 << 20
#: Components are held in these bounds, so that a score of up to 16,384 of them fits a long.
MOST = 1 << 24


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * component) of each component, as integers."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(MOST)), F.lit(-MOST)).cast("int"))


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's parent (the root: -1) and the distance to it, in a minimum spanning tree rooted at the first row."""
    n = len(x)
    parent, edge = np.full(n, -1), np.zeros(n)
    near, by = np.full(n, np.inf), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        left[at] = False
        far = np.sqrt(((x - x[at]) ** 2).sum(1))
        closer = left & (far < near)
        near[closer], by[closer] = far[closer], at
        at = int(np.argmin(np.where(left, near, np.inf)))
        parent[at], edge[at] = by[at], near[at]
    return parent, edge


def levels(parent: np.ndarray) -> list[np.ndarray]:
    """Rows of a tree by their depth."""
    out, depth = [], np.full(len(parent), -1)
    depth[parent < 0] = 0
    at = np.flatnonzero(parent < 0)
    while len(at):
        out.append(at)
        at = np.flatnonzero((depth < 0) & (parent >= 0) & (depth[np.maximum(parent, 0)] == len(out) - 1))
        depth[at] = len(out)
    return out


@dataclass
class Tree:
    """Vectors of anchors, whole numbers held as doubles, and the tree they form."""

    x: np.ndarray
    parent: np.ndarray
    edge: np.ndarray


def exact_scores(anchor: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products as longs. Doubles are exact below 2**53 and come faster."""
    if np.abs(anchor).max(initial=0) * np.abs(candidates).max(initial=0) * float(len(anchor)) < 2**53:
        return (candidates @ anchor).astype(np.int64)
    return (candidates.astype(np.int64) * anchor.astype(np.int64)).sum(1)


def walk(tree: Tree, candidates: np.ndarray, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray], take: Callable[[int, np.ndarray, np.ndarray], None]) -> int:
    """Walks a tree with a slice of candidates. ``wanted(anchor, low, high)`` says which bounds overlap the anchor's window,
    ``take(anchor, rows, scores)`` gets their scores. Returns how many were scored."""
    norm = np.sqrt((candidates * candidates).sum(1))
    low, high = np.empty((len(tree.x), len(candidates))), np.empty((len(tree.x), len(candidates)))
    scored = 0
    for level in levels(tree.parent):
        for a in level:
            up = tree.parent[a]
            if up < 0:
                low[a], high[a] = -np.inf, np.inf
                rows = np.arange(len(candidates))  # the root has no bounds and scores all
            else:
                # The last terms cover what rounding to doubles loses.
                reach = tree.edge[a] * norm * (1 + 1e-9) + 1e-9 * np.maximum(np.abs(low[up]), np.abs(high[up]))
                low[a], high[a] = low[up] - reach, high[up] + reach
                rows = np.flatnonzero(wanted(a, low[a], high[a]))
            score = exact_scores(tree.x[a], candidates[rows])
            low[a, rows] = high[a, rows] = score
            scored += len(rows)
            take(a, rows, score)
    return scored


def best_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > k:  # all that reach the k-th score
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[-k])
        return near[np.lexsort((ids[near], -scores[near]))][:k]
    return np.lexsort((ids, -scores))


class Positives:
    """The ``k`` best candidates of an anchor's own label but itself."""

    def __init__(self, anchors: int, k: int) -> None:
        self.k = k
        self.floor = np.full(anchors, -np.inf)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * anchors

    def add(self, a: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.best[a][0], ids)), np.concatenate((self.best[a][1], scores))
        top = best_rows(ids, scores, self.k)
        self.best[a] = ids[top], scores[top]
        if len(top) == self.k:
            self.floor[a] = scores[top[-1]]


class Negatives:
    """For each window (an anchor's positive) the ``k`` best candidates with a score in it."""

    def __init__(self, windows: list[list[tuple[int, int]]], low: int, high: int, k: int) -> None:
        self.k, self.low, self.high = k, low, high
        self.windows = windows
        self.best = [[(np.empty(0, np.int64), np.empty(0, np.int64))] * len(w) for w in windows]
        #: An anchor's windows together: from the lowest end that still takes candidates to the highest.
        self.floor = np.array([min((s * low / 100 for _, s in w), default=np.inf) for w in windows])
        self.top = np.array([max((s * high / 100 for _, s in w), default=-np.inf) for w in windows])

    def add(self, a: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ends = []
        for i, (_, positive) in enumerate(self.windows[a]):
            inside = np.flatnonzero((100 * scores >= self.low * positive) & (100 * scores <= self.high * positive))
            got, had = np.concatenate((self.best[a][i][0], ids[inside])), np.concatenate((self.best[a][i][1], scores[inside]))
            top = best_rows(got, had, self.k)
            self.best[a][i] = got[top], had[top]
            ends.append(float(had[top[-1]]) if len(top) == self.k else positive * self.low / 100)
        self.floor[a] = min(ends, default=np.inf)


def _vectors(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return data.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _slices(table: pa.Table, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of a tile's candidates, in slices. Of equal vectors of one label those of the smallest ids are enough."""
    ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
    x = _vectors(table.column("x"), len(ids))
    rows = without_surplus(ids, np.column_stack((x.astype(np.int64), labels)), k)
    for at in range(0, len(rows), ROWS_AT_ONCE):
        own = rows[at : at + ROWS_AT_ONCE]
        yield ids[own], labels[own], x[own].astype(np.float64)


def _trees(table: pa.Table) -> Iterator[tuple[Tree, np.ndarray, np.ndarray, np.ndarray]]:
    """The trees of a tile, with the anchors' ids, labels and rows."""
    tree, place = table.column("tree").to_numpy(), table.column("place").to_numpy()
    ids, labels, parent, edge = (table.column(c).to_numpy() for c in ("id", "label", "parent", "edge"))
    x = _vectors(table.column("x"), len(ids))
    order = np.lexsort((place, tree, labels))
    for rows in np.split(order, np.flatnonzero(np.diff(tree[order]) | np.diff(labels[order])) + 1) if len(order) else []:
        yield Tree(x[rows].astype(np.float64), parent[rows], edge[rows]), ids[rows], labels[rows], rows


def _halves(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    asks = table.column("asks")
    return table.filter(asks), table.filter(pa.compute.invert(asks))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    Components are rounded down to whole multiples of 1 / ``scale``; scores are inner products of those integers. Anchors are the ids
    divisible by ``every``. An anchor's positives are the ``positives`` best other rows of its label; a positive's negatives
    the ``negatives`` best rows of other labels that score between ``low`` and ``high`` percent of it. Higher scores come
    first, ties by the smaller id. The result is exact: bounds leave out only what cannot be among these.

    Rows with a null id or label, and vectors that are null, empty or hold null or non-finite components, take no part; vectors of
    another length than the anchor's do not meet it. Components are held within 2**24 multiples. Of a repeated
    anchor id the row of the smallest label and vector asks; repeated candidates are found each by itself, but a positive repeated with
    one score is asked for once. A positive without negatives, and an anchor without positives, give no row. Other columns are not read.

    Blocks of candidates and anchors are bounded in bytes, trees in anchors, and a tile passes on a bounded number of rows for each anchor
    and positive, however many vectors are equal.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    x = F.col(vector_col)
    whole = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(x) > 0), F.lit(False))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & whole)
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantised(x, scale).alias("x"), F.size(x).alias("dim"))
    asking = usable.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "dim", "x")).alias("v")).select("id", "v.*")
    asking = written(asking, "anchors")

    def cuts(keys: list[str]) -> DataFrame:
        """Blocks and trees of each length (and label), from counts."""
        size = lambda n: F.col(n) * F.col("dim") * 4
        all_ = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        asks = asking.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a"))
        both = all_.join(asks, keys)  # lengths and labels without anchors meet nobody
        blocks = F.greatest(F.ceil(size("n") / CANDIDATE_BYTES), F.least(F.ceil(size("n") / LEAST_BYTES), F.lit(FEW_BLOCKS))).cast("int")
        return written(both.select(*keys, blocks.alias("cs"), F.ceil(size("n_a") / ANCHOR_BYTES).cast("int").alias("qs"), F.ceil(F.col("n_a") / TREE).cast("int").alias("ts")), "cuts")

    by_label, by_dim = cuts(["dim", "label"]), cuts(["dim"])
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tree_schema = "dim int, label long, tree long, id long, place int, parent int, edge double, x array<int>"

    def plant(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        parent, edge = spanning_tree(_vectors(table.column("x"), len(table)).astype(np.float64))
        table = table.append_column("place", pa.array(np.arange(len(table)), pa.int32())).append_column("parent", pa.array(parent, pa.int32())).append_column("edge", pa.array(edge))
        return table.select(["dim", "label", "tree", "id", "place", "parent", "edge", "x"])

    # Anchors of one label lie near one another, so trees do not mix labels.
    dealt = asking.join(by_label, ["dim", "label"]).select("dim", "label", F.pmod(F.xxhash64("id"), F.col("ts")).alias("tree"), "id", "x")
    planted = written(dealt.groupBy("dim", "label", "tree").applyInArrow(plant, tree_schema), "trees")

    no_tree = [F.lit(None).cast("long").alias("tree"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("parent"), F.lit(None).cast("double").alias("edge")]
    in_tree = ["tree", "place", "parent", "edge"]

    def tiles(keys: list[str], cut: DataFrame, anchors: DataFrame, extra: str, empty: Column) -> DataFrame:
        """Each block of candidates once for each block of anchors of its keys, and the anchors' blocks once for each of its."""
        c = usable.join(cut, keys).select("dim", F.pmod(F.xxhash64("id", "x"), F.col("cs")).cast("int").alias("c"), F.explode(upto("qs")).alias("q"), F.lit(False).alias("asks"), "id", "label", "x", *no_tree, empty.alias(extra))
        a = anchors.join(cut, keys).select("dim", F.explode(upto("cs")).alias("c"), F.pmod("tree", F.col("qs")).cast("int").alias("q"), F.lit(True).alias("asks"), "id", "label", "x", *in_tree, extra)
        return c.union(a)

    def find_positives(table: pa.Table) -> pa.Table:
        asks, given = _halves(table)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        trees = [(t, ids, Positives(len(ids), positives)) for t, ids, _, _ in _trees(asks)]
        for own, _, x in _slices(given, positives + 1) if trees else ():
            for tree, ids, found in trees:

                def take(a: int, at: np.ndarray, score: np.ndarray, ids: np.ndarray = ids, found: Positives = found, own: np.ndarray = own) -> None:
                    other = own[at] != ids[a]
                    found.add(a, own[at][other], score[other])

                walk(tree, x, lambda a, lo, hi, found=found: hi >= found.floor[a], take)
        for _, ids, found in trees:
            out += [(np.full(len(b[0]), i), *b) for i, b in zip(ids, found.best, strict=True)]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("anchor_id", "id", "score"), columns, strict=True)))

    met = tiles(["dim", "label"], by_label, planted.withColumn("windows", F.lit(None).cast("int")), "windows", F.lit(None).cast("int"))
    near = met.groupBy("dim", "label", "q", "c").applyInArrow(find_positives, "anchor_id long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    chosen = near.withColumn("n", place).where(F.col("n") <= positives)
    windows = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_set(F.struct("id", "score"))).alias("windows"))
    armed = written(planted.join(windows, F.col("id") == F.col("anchor_id"), "left").drop("anchor_id"), "windows")

    def find_negatives(table: pa.Table) -> pa.Table:
        asks, given = _halves(table)
        wanted = asks.column("windows").to_pylist()
        out: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
        trees = []
        for t, ids, labels, rows in _trees(asks):
            trees.append((t, ids, labels, Negatives([[(w["id"], w["score"]) for w in wanted[r] or ()] for r in rows], low, high, negatives)))
        for own, kinds, x in _slices(given, negatives) if trees else ():
            for tree, _, labels, found in trees:

                def take(a: int, at: np.ndarray, score: np.ndarray, labels: np.ndarray = labels, found: Negatives = found, own: np.ndarray = own, kinds: np.ndarray = kinds) -> None:
                    other = kinds[at] != labels[a]
                    found.add(a, own[at][other], score[other])

                walk(tree, x, lambda a, lo, hi, labels=labels, found=found, kinds=kinds: (hi >= found.floor[a]) & (lo <= found.top[a]) & (kinds != labels[a]), take)
        for _, ids, _, found in trees:
            out += [(i, *w, *b) for i, ws, best in zip(ids, found.windows, found.best, strict=True) for w, b in zip(ws, best, strict=True)]
        n = np.array([len(r[3]) for r in out], np.int64)
        fixed = [np.repeat(np.array([r[k] for r in out], np.int64), n) for k in range(3)]
        found_ = [np.concatenate([r[k] for r in out] or [np.empty(0, np.int64)]) for k in (3, 4)]
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), fixed + found_, strict=True)))

    kind = armed.schema["windows"].dataType
    met = tiles(["dim"], by_dim, armed, "windows", F.lit(None).cast(kind))
    found = met.groupBy("dim", "q", "c").applyInArrow(find_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
