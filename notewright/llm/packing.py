"""Packing: length buckets that minimise padding, and batches of a token budget inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.shared import slots, word_count, written


def bucket_limits(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper limits of at most ``buckets`` buckets that minimise sum(count * (limit - length)), by dynamic programming.

    ``lengths`` rise and are distinct. cost[j] of one bucket over lengths i..j comes from prefix sums.
    """
    n = len(lengths)
    if n == 0:
        return []
    many = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    mass = np.concatenate(([0], np.cumsum(counts * lengths, dtype=np.float64)))
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (many[j] - many[:j]) - (mass[j] - mass[:j])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        cuts.append(cut)
        best = new
    limits, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        limits.append(int(lengths[j - 1]))
        j = int(cut[j])
    return limits[::-1]


def pack(docs: DataFrame, length: Column | None = None, max_length: int = 2048, buckets: int = 8, budget: int = 16384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each document's tokens go: one row for each piece of at most ``max_length`` tokens.

    Columns: the id, piece, start and n_tokens of the piece, bucket, bucket_length (all sequences of a batch
    are padded to it), batch (from 0 in its bucket, without gaps), place in the batch, n_padding. A batch holds
    budget // bucket_length sequences, at least one; only a bucket's last batch may hold fewer. ``length``
    defaults to the number of words of the text. Documents without tokens (null or empty texts) are one
    piece of 0 tokens. Repeated rows and null ids are packed each by itself.

    The histogram that goes to the driver has at most ``max_length`` + 1 rows, whatever the input.
    """
    n = (word_count(text_col) if length is None else F.coalesce(length, F.lit(0))).cast("long")
    sized = docs.select(F.col(id_col), F.xxhash64(text_col).alias("_text_key"), n.alias("_n"))
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("_n") - 1) / max_length), F.lit(0)).cast("long"))))
    start = F.col("piece") * max_length
    cut = cut.withColumns({"start": start, "n_tokens": F.least(F.lit(max_length).cast("long"), F.col("_n") - start)}).drop("_n")
    cut = written(cut, "pieces")
    found = sorted((r["n_tokens"], r["n"]) for r in cut.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())
    limits = bucket_limits(np.array([x for x, _ in found], np.int64), np.array([c for _, c in found], np.int64), buckets) or [0]
    limit = F.array(*[F.lit(x).cast("long") for x in limits])
    placed = cut.withColumn("bucket", F.size(F.filter(limit, lambda x: x < F.col("n_tokens"))))
    placed = placed.withColumn("bucket_length", F.element_at(limit, F.col("bucket") + 1))
    room = F.greatest(F.lit(1), F.floor(budget / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    ranked = slots(placed, ["bucket"], [id_col, "_text_key", "piece"], "_slot", sum(c for _, c in found))
    return ranked.select(id_col, "piece", "start", "n_tokens", "bucket", "bucket_length", F.floor(F.col("_slot") / room).cast("long").alias("batch"), F.pmod("_slot", room).cast("int").alias("place"), (F.col("bucket_length") - F.col("n_tokens")).alias("n_padding"))
