"""Order over whole tables and giant groups without one task that holds all of it.

Rows are dealt into ranges of an order whose first columns name their group. What runs down a group (the row before, a
running total, the last value) is taken inside each range and joined with a small table of what the ranges before it ended
with; a group may lie in as many ranges as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.session import written

#: Rows of a range that one task sorts and numbers.
ROWS_A_RANGE = 100_000


def numbered_rows(df: DataFrame, order: list[str | Column], out: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Adds ``out``: a position from 0 without gaps, in the order of ``order``; rows that tie there are numbered at will.

    Rows are dealt into ranges of the order, as many as their number asks for, and written, as ranges come from a
    sample. The ranges' counts give each its first position; inside a range rows are sorted.
    """
    ranges = max(1, -(-df.count() // rows_a_range))
    cut = written(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return cut.join(starts, F.col("_range") == F.col("_r")).withColumn(out, F.row_number().over(inside) - 1 + F.col("_start")).drop("_range", "_r", "_start")


def ranged(df: DataFrame, order: list[str], rows_a_range: int | None = None) -> DataFrame:
    """Adds ``_range``, the number of a row's range in the order. Rows that fill more than one range are written, as ranges
    come from a sample."""
    rows_a_range = rows_a_range or ROWS_A_RANGE
    ranges = max(1, -(-df.count() // rows_a_range))
    if ranges == 1:
        return df.withColumn("_range", F.lit(0))
    return written(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def ranked(df: DataFrame, key: list[str], order: list[str], out: str, rows_a_range: int | None = None) -> DataFrame:
    """Adds ``out``: a row's position, from 1, among those of its group in the order; rows that tie are numbered at will.

    Rows are numbered inside (range, group); a table of one row for each range and group holds how many came before.
    """
    cut = ranged(df, [*key, *order], rows_a_range)
    counts = cut.groupBy("_range", *key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of the group
    starts = counts.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(key):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy("_range", *key).orderBy(*order)
    return cut.join(starts, same).withColumn(out, F.row_number().over(inside) + F.col("_start")).drop("_range", "_r", "_start", *[f"_k{i}" for i in range(len(key))])


def _joined(cut: DataFrame, ends: DataFrame, carry: Column, name: str) -> DataFrame:
    """The rows with what the ranges before theirs ended with: a row for each range."""
    carried = ends.select(F.col("_range").alias("_joined_range"), carry.alias(name))
    return cut.join(carried, F.col("_range") == F.col("_joined_range"), "left").drop("_joined_range")


def _group(key: list[str]) -> Column:
    return F.struct(*key)


def with_previous(cut: DataFrame, key: list[str], order: list[str], columns: list[str], out: str) -> DataFrame:
    """Adds ``out``, a struct of ``columns`` of the row before in the same group (null: the first)."""
    row = F.struct(_group(key).alias("key"), *columns)
    ends = cut.groupBy("_range").agg(F.max_by(row, F.struct(*order)).alias("_end"))
    carried = _joined(cut, ends, F.lag("_end").over(Window.orderBy("_range")), "_carry")
    before = F.coalesce(F.lag(row).over(Window.partitionBy("_range").orderBy(*order)), F.col("_carry"))
    return carried.withColumn(out, before).withColumn(out, F.when(F.col(f"{out}.key").eqNullSafe(_group(key)), F.col(out))).drop("_carry")


def running_total(cut: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over all rows up to this one: it grows with the order, over all groups."""
    cut = cut.withColumn("_value", value)
    ends = cut.groupBy("_range").agg(F.sum("_value").alias("_end"))
    before = F.sum("_end").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _joined(cut, ends, F.coalesce(before, F.lit(0)), "_carry").withColumn(out, F.sum("_value").over(upto) + F.col("_carry")).drop("_value", "_carry")


def with_last(cut: DataFrame, key: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``, the last value that is not null in the same group up to this row."""
    cut = cut.withColumn("_value", F.when(value.isNotNull(), F.struct(_group(key).alias("key"), value.alias("value"))))
    ends = cut.groupBy("_range").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
    before = F.last("_end", True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = _joined(cut, ends, before, "_carry").withColumn("_last", F.coalesce(F.last("_value", True).over(upto), F.col("_carry")))
    return last.withColumn(out, F.when(F.col("_last.key").eqNullSafe(_group(key)), F.col("_last.value"))).drop("_value", "_carry", "_last")
