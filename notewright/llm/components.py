"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.shared import drop, written


def components(links: DataFrame, a: str = "a", b: str = "b", label: str = "links") -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node reachable.

    Each round points neighbours at the smallest node near them: aggregation with map-side combine, then an
    equi-join that splits hot nodes, written to the shared folder. Rounds grow with the logarithm of the
    number of nodes. Links that hold a null, and links of a node to itself, are left out.
    """
    up = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = written(links.where(F.col(a) != F.col(b)).select(*up).distinct(), label)
    before = None
    while True:
        n, total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == before:
            break
        before = (n, total)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("w", "m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(lowest, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("w"))
        old, edges = edges, written(small.where("u <> v").select("u", "v").union(small.select(F.col("w").alias("u"), "v")).distinct(), label)
        drop(old)
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
