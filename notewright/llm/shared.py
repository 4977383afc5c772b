"""Helpers that several operators share: written tables, ranks without hot windows, words in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notewright.session import drop, ship_package, small_batches, table_scope, written

__all__ = ["drop", "ship_package", "small_batches", "table_scope", "written"]

#: A word, in Spark's (Java) and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: str | Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows that one task numbers in ``slots``.
ROWS_A_BLOCK = 50_000


def slots(df: DataFrame, group: list[str], order: list[str], out: str, rows: int, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """Adds ``out``, each row's position from 0 in its group, without gaps and without a window over a whole group.

    Of ``rows`` rows in all, a group is cut into blocks of about ``rows_a_block`` by a hash of the ``order`` columns, so
    that no block grows with the input. Counts per block give each block its first position; inside a block rows
    are ordered by ``order``. Null keys form a group of their own. Columns of ``df`` may have any names.
    """
    block, own, n, start, *keys = free_names(df, "_block", "_own", "_n", "_start", *[f"_g{i}" for i in range(len(group))])
    blocks = max(1, -(-rows // rows_a_block))
    cut = df.withColumn(block, F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = cut.groupBy(*group, block).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col(block).alias(own), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    same = F.col(block) == F.col(own)
    for g, k in zip(group, keys, strict=True):
        same &= F.col(g).eqNullSafe(F.col(k))
    inside = Window.partitionBy(*group, block).orderBy(*order)
    ranked = cut.join(starts, same).withColumn(out, F.row_number().over(inside) - 1 + F.col(start))
    return ranked.drop(block, own, start, *keys)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds ``most_bytes`` of ``column``, or one row that is longer."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column one after the other, and where each begins; null: empty."""
    column = pa.array(column).fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C55
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _POWERS[0] = (out[0], out[1])
    return _POWERS[0]


@dataclass
class Words:
    """The words of a block of texts: byte positions, a 64-bit hash each, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span: a polynomial by prefix sums, scrambled with the length."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """The words of all texts of a block, found and hashed by array operations."""
    if lower:
        data = _LOWER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~_SPACE[data]
    after = np.empty(len(data), bool)  # the byte before is a blank or in another text
    after[:1] = True
    after[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (after | edge[:-1]))
    ahead = np.empty(len(data), bool)
    ahead[-1:] = True
    ahead[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (ahead | edge[1:])) + 1
    return Words(starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets))
