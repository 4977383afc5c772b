"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are rounded to int8; only these, their scales and what rounding lost travel. Queries and candidates are dealt into blocks;
each pair of blocks is one tile. In a tile products of the rounded vectors bound every inner product from both sides, and a
pair survives if its upper bound reaches the k-th best lower bound. A tile is met in slices. Heaps merge what the tiles
leave of a query, and the pairs that survive there as well fetch their vectors by id and are computed anew in double
precision. Every candidate is weighed, so the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.shared import small_batches, written

#: Most bytes of int8 values in a block of candidates and in a block of queries.
CANDIDATE_BYTES, QUERY_BYTES = 16 << 20, 8 << 20
#: Candidates and queries of a slice, which holds a few arrays of their product.
ROWS_AT_ONCE, QUERIES_AT_ONCE = 4096, 512
#: Smaller tables are cut into blocks of a megabyte, up to as many blocks as this, for parallel tiles.
FEW_BLOCKS, LEAST_BYTES = 16, 1 << 20
#: Pairs of a query that the merge holds before it drops those below the k-th best.
HELD = 4


class Rounded(NamedTuple):
    """Ids, hashes of the vectors, int8 values, scales, and norms of the vectors and of what rounding lost."""

    ids: np.ndarray
    v: np.ndarray
    q: np.ndarray
    scale: np.ndarray
    norm: np.ndarray
    lost: np.ndarray

    def rows(self, at: np.ndarray | slice) -> Rounded:
        return Rounded(*(x[at] for x in self))


def _norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v))


def rounded(vectors: DataFrame, x: str) -> DataFrame:
    """Rows with the columns v, q, scale, norm and lost made of the vector ``x`` of doubles, which is left behind."""
    scaled = vectors.withColumn("scale", F.greatest(F.array_max(F.transform(x, F.abs)), F.lit(1e-300)) / 127)
    whole = scaled.withColumns({"v": F.xxhash64(x), "norm": _norm(F.col(x)), "q": F.transform(x, lambda v: F.rint(v / F.col("scale")).cast("tinyint"))})
    return whole.withColumn("lost", _norm(F.zip_with(x, "q", lambda v, q: v - q * F.col("scale")))).drop(x)


def without_surplus(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among some query's ``k`` best: of equal vectors those of the ``k`` + 1 smallest ids (one may be the
    query's own), and of one id ``k`` rows at most. The others come behind them in every tie."""
    keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, vector = np.unique(keys, return_inverse=True)
    order = np.lexsort((ids, vector))
    v, i = vector[order], ids[order]
    new_vector = np.concatenate(([True], v[1:] != v[:-1]))[: len(v)]
    new_id = new_vector | np.concatenate(([True], i[1:] != i[:-1]))[: len(v)]
    at = np.arange(len(v))
    nth_row = at - np.maximum.accumulate(np.where(new_id, at, 0))
    nth_id = np.cumsum(new_id)
    nth_id -= np.maximum.accumulate(np.where(new_vector, nth_id, 0))
    return np.sort(order[(nth_row < k) & (nth_id <= k)])


def tile(queries: Rounded, given: Rounded, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, its vector's hash, lowest and highest score) of the pairs of a tile that may be among a query's ``k`` best."""
    given = given.rows(without_surplus(given.ids, given.v[:, None], k))
    found = [_slice_of_queries(queries.rows(slice(at, at + QUERIES_AT_ONCE)), given, k) for at in range(0, len(queries.ids), QUERIES_AT_ONCE)]
    i = np.concatenate([x[0] + at * QUERIES_AT_ONCE for at, x in enumerate(found)] or [np.empty(0, np.int64)])
    j, low, high = (np.concatenate([x[n] for x in found] or [np.empty(0, np.int64)]) for n in (1, 2, 3))
    return i, given.ids[j], given.v[j], low, high


def _slice_of_queries(queries: Rounded, given: Rounded, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    left = queries.q.astype(np.float32 if queries.q.shape[1] <= 1000 else np.float64)  # sums of int8 products stay exact
    best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)  # query row, candidate row, bounds
    floor = np.full(len(left), -np.inf)
    for at in range(0, len(given.ids), ROWS_AT_ONCE):
        own = given.rows(slice(at, at + ROWS_AT_ONCE))
        near = (left @ own.q.astype(left.dtype).T).astype(np.float64)
        near *= queries.scale[:, None]
        near *= own.scale
        slack = queries.lost[:, None] * own.norm
        slack += (queries.norm + queries.lost)[:, None] * own.lost
        slack += (1e-9 * queries.norm)[:, None] * own.norm
        near[queries.ids[:, None] == own.ids] = -np.inf  # a query's own row
        if near.shape[1] > k:
            floor = np.maximum(floor, np.partition(near - slack, near.shape[1] - k, axis=1)[:, -k])
        i, j = np.nonzero((near + slack >= floor[:, None]) & (near > -np.inf))
        i, j, low, high = (np.concatenate(x) for x in zip(best, (i, j + at, near[i, j] - slack[i, j], near[i, j] + slack[i, j]), strict=True))
        order = np.lexsort((-low, i))
        i, j, low, high = i[order], j[order], low[order], high[order]
        nth = np.arange(len(i)) - np.searchsorted(i, np.arange(len(left)))[i]
        floor[i[nth == k - 1]] = np.maximum(floor[i[nth == k - 1]], low[nth == k - 1])
        kept = high >= floor[i]
        best = i[kept], j[kept], low[kept], high[kept]
    return best


def _best(pairs: list[tuple[float, float, int, int]], k: int) -> list[tuple[float, float, int, int]]:
    """Pairs (lowest, highest, id, hash) whose highest score reaches the k-th of the lowest."""
    if len(pairs) <= k:
        return pairs
    floor = heapq.nlargest(k, (p[0] for p in pairs))[-1]
    return [p for p in pairs if p[1] >= floor]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each query the ``k`` candidates of largest inner product, nearest first.

    Queries are the ids divisible by ``every``; candidates are all rows but those with the query's id; ties go to
    the smaller id. Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components,
    take no part; vectors of another length are no candidates. Of a repeated query id the smallest vector asks;
    repeated candidates are found each by itself. No other column is read. Equal vectors are told by 64-bit hashes.

    Blocks are bounded in bytes and met in slices, so a tile takes less than half a gigabyte whatever the input and however
    many vectors are equal; each tile passes on those pairs of a query that int8 cannot tell from its ``k`` best.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    x = F.col(vector_col)
    whole = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    usable = vectors.where(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("x"), F.size(x).alias("dim"))
    asked = usable.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("dim", "x")).alias("w")).select("id", F.col("w.x").alias("x"), F.col("w.dim").alias("dim"))
    sizes = usable.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("n_q"))
    cuts = sizes.select("dim", F.greatest(F.ceil(F.col("n") * F.col("dim") / CANDIDATE_BYTES), F.least(F.ceil(F.col("n") * F.col("dim") / LEAST_BYTES), F.lit(FEW_BLOCKS))).cast("int").alias("cs"), F.ceil(F.col("n_q") * F.col("dim") / QUERY_BYTES).cast("int").alias("qs")).where("qs > 0")
    cuts = written(cuts, "cuts")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    sent = ["id", "v", "q8", "scale", "norm", "lost"]
    c = rounded(usable, "x").withColumnRenamed("q", "q8").join(cuts, "dim").select("dim", F.pmod(F.xxhash64("id", "v"), F.col("cs")).cast("int").alias("c"), F.explode(upto("qs")).alias("q"), F.lit(False).alias("asks"), *sent)
    q = rounded(asked, "x").withColumnRenamed("q", "q8").join(cuts, "dim").select("dim", F.explode(upto("cs")).alias("c"), F.pmod(F.xxhash64("id"), F.col("qs")).cast("int").alias("q"), F.lit(True).alias("asks"), *sent)

    def work(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        data = table.column("q8").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(asks), -1)
        rows = Rounded(table.column("id").to_numpy(), table.column("v").to_numpy(), data, *(table.column(n).to_numpy() for n in ("scale", "norm", "lost")))
        i, ids, v, low, high = tile(rows.rows(asks), rows.rows(~asks), k)
        return pa.table({"query_id": rows.ids[asks][i], "id": ids, "v": v, "low": low, "high": high})

    pairs = c.union(q).groupBy("dim", "q", "c").applyInArrow(work, "query_id long, id long, v long, low double, high double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[float, float, int, int]]] = {}
        full: dict[int, int] = {}
        for batch in batches:
            for query, *pair in zip(*(batch.column(n).to_pylist() for n in ("query_id", "low", "high", "id", "v")), strict=True):
                own = held.setdefault(query, [])
                own.append(tuple(pair))
                if len(own) >= full.get(query, HELD * k):
                    held[query] = _best(own, k)
                    full[query] = max(HELD * k, 2 * len(held[query]))
        rows = ((query, i, v) for query, own in held.items() for _, _, i, v in _best(own, k))
        while part := [row for row, _ in zip(rows, range(10000))]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part, strict=True)], ["query_id", "id", "v"])

    left = pairs.repartition("query_id").mapInArrow(merge, "query_id long, id long, v long")
    # The vectors of the pairs that are left, once for each id and vector.
    theirs = usable.select("id", F.xxhash64("x").alias("v"), F.col("x").alias("y")).dropDuplicates(["id", "v"])
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda t, p: t + p)
    scored = left.join(theirs, ["id", "v"]).join(asked.select(F.col("id").alias("query_id"), "x"), "query_id").select("query_id", "id", product.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
