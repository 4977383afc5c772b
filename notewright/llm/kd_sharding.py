"""Sharding by a k-d tree over documents' metadata, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.shared import drop, slots, written

#: A point's place in a dimension is a number of 20 bits; below it a hash of the text of 40 bits breaks ties.
SCALE, TIE_BITS, DIGIT_BITS, DIGITS = (1 << 20) - 1, 40, 15, 4
#: Most rows, each of a few numbers, to send to all tasks; tables of nodes have one row a shard at most.
MOST_SENT = 200_000


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` rows at most, for a join: sent to all tasks where that is little, else dealt out."""
    return F.broadcast(df) if rows <= MOST_SENT else df


def _weighted_cut(points: DataFrame, nodes: int) -> DataFrame:
    """(node, cut): the smallest place of each node up to which it holds its goal of bytes.

    ``points`` has node, place (60 bits), bytes and goal. The cut is found digit by digit: bytes are summed by
    (node, digit), so a node's window holds at most 2**15 sums, and only points under the digits found
    go on to the next.
    """
    rest = points.select("node", "place", "bytes", F.col("goal").alias("left"), F.lit(0).cast("long").alias("cut"))
    for k in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - k)
        digit = F.shiftright("place", shift).bitwiseAND((1 << DIGIT_BITS) - 1)
        sums = rest.groupBy("node", digit.alias("digit")).agg(F.sum("bytes").alias("b"), F.max("left").alias("left"), F.max("cut").alias("cut"))
        upto = Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reached = sums.withColumn("upto", F.sum("b").over(upto)).where("upto >= left")
        found = reached.groupBy("node").agg(F.min_by(F.struct("digit", (F.col("left") - F.col("upto") + F.col("b")).alias("left"), F.shiftleft("cut", DIGIT_BITS).bitwiseOR(F.col("digit")).alias("cut")), "digit").alias("f")).select(F.col("node").alias("_node"), "f.*")
        if k == DIGITS - 1:
            return found.select(F.col("_node").alias("node"), "cut")
        rest = rest.drop("left", "cut").join(_sent(found, nodes), (F.col("node") == F.col("_node")) & (digit == F.col("digit"))).select("node", "place", "bytes", "left", "cut")
    raise AssertionError


def kd_shards(docs: DataFrame, shards: int = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The id, size, text_crc32, shard and slot of every document.

    Size is the UTF-8 bytes of the text (null: none) plus 1. Points are texts, each with the bytes of all its
    copies, so equal texts share a shard; a text whose copies hold more than half a shard is spread over several
    points by a hash of the id. Dimensions are the logarithm of the size and a hash of each ``metadata`` column (the
    smallest of the copies; null: its own value), each scaled so that all points span 0..1. A node that is to give k
    shards is cut along its widest dimension where k // 2 of k shares of its bytes are reached, until every
    leaf is one shard; a hash of the text orders points of one place, so it alone cuts where all points are alike. With ``target_bytes`` the number of shards is the total over it, rounded up.
    Shards differ by a few texts' bytes. Slots run from 0 without gaps. Empty tables give no row; null ids and
    repeated rows are placed as other rows; no other column is read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [m for m in metadata if m in docs.columns]
    scaled = [(F.crc32(F.coalesce(F.col(m).cast("string"), F.lit("\x00"))) / F.lit(float(1 << 32))).alias(f"_m{i}") for i, m in enumerate(names)]
    light = written(docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64(text).alias("_text_key"), *scaled), "shard-sizes")
    total, rows = light.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    texts = light.groupBy("_text_key").agg(F.sum("size").alias("bytes"), F.max("size").alias("size"), *[F.min(f"_m{i}").alias(f"_m{i}") for i in range(len(names))])
    half = max(1, total // (2 * shards))
    pieces = F.when(F.col("bytes") > half, F.ceil(F.col("bytes") / F.lit(max(1, half // 8)))).otherwise(1).cast("int")
    # At most 2 * shards texts hold more than half a shard.
    heavy = written(texts.where(F.col("bytes") > half).select(F.col("_text_key").alias("_heavy"), pieces.alias("_pieces")), "heavy-texts")
    light = light.join(_sent(heavy, 2 * shards), F.col("_text_key") == F.col("_heavy"), "left").withColumn("_piece", F.when(F.col("_pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(id_col), F.coalesce("_pieces", F.lit(1)))).cast("int")).drop("_heavy", "_pieces")
    dims = ["_d0", *[f"_m{i}" for i in range(len(names))]]
    tie = F.xxhash64("_text_key", "_piece").bitwiseAND((1 << TIE_BITS) - 1)
    points = light.groupBy("_text_key", "_piece").agg(F.sum("size").alias("bytes"), F.log2(F.max("size").cast("double")).alias("_d0"), *[F.min(f"_m{i}").alias(f"_m{i}") for i in range(len(names))])
    points = points.withColumn("_hash", tie)
    points = written(points.withColumns({"node": F.lit(0).cast("long"), "leaves": F.lit(shards).cast("long"), "first": F.lit(0).cast("long")}), "points")
    ends = points.agg(*[f(d).alias(f"{d}{f.__name__}") for d in dims for f in (F.min, F.max)]).first()
    root = {d: (ends[f"{d}min"] or 0.0, (ends[f"{d}max"] or 0.0) - (ends[f"{d}min"] or 0.0)) for d in dims}
    points = points.withColumns({d: (F.col(d) - low) / wide if wide else F.lit(0.0) for d, (low, wide) in root.items()})
    open_leaves = shards
    while open_leaves > 1:
        spread = F.array(*[F.struct((F.max(d) - F.min(d)).alias("width"), F.lit(-i).alias("i")) for i, d in enumerate(dims)])
        nodes = points.where("leaves > 1").groupBy("node").agg(F.max("leaves").alias("k"), F.sum("bytes").alias("all"), F.array_max(spread)["i"].alias("dim")).select(F.col("node").alias("_n"), (F.floor(F.col("k") / 2) * F.col("all") / F.col("k")).alias("goal"), (-F.col("dim")).alias("dim"))
        chosen = F.element_at(F.array(*dims), F.col("dim") + 1)
        placed = points.join(_sent(nodes, shards), F.col("node") == F.col("_n"), "left").withColumn("place", F.shiftleft(F.floor(F.coalesce(chosen, F.lit(0.0)) * SCALE).cast("long"), TIE_BITS).bitwiseOR(F.col("_hash"))).drop("_n", "dim")
        cuts = _weighted_cut(placed.where("goal is not null"), shards).select(F.col("node").alias("_n"), "cut")
        right = F.coalesce(F.col("place") > F.col("cut"), F.lit(False)).cast("long")
        lower = F.floor(F.col("leaves") / 2).cast("long")
        moved = placed.join(_sent(cuts, shards), F.col("node") == F.col("_n"), "left").withColumn("right", right)
        before, points = points, written(moved.select(*[c for c in points.columns if c not in ("node", "leaves", "first")], (2 * F.col("node") + F.col("right") + 1).alias("node"), F.when(F.col("leaves") <= 1, F.col("leaves")).when(F.col("right") == 1, F.col("leaves") - lower).otherwise(lower).alias("leaves"), (F.col("first") + F.when(F.col("leaves") > 1, F.col("right") * lower).otherwise(0)).alias("first")), "points")
        drop(before)
        open_leaves = -(-open_leaves // 2)
    leaves = points.select(F.col("_text_key").alias("_k"), F.col("_piece").alias("_p"), F.col("first").cast("int").alias("shard"))
    met = light.join(leaves, (F.col("_text_key") == F.col("_k")) & (F.col("_piece") == F.col("_p")))
    return slots(met, ["shard"], ["_text_key", id_col], "slot", rows).select(id_col, "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
