"""Mixing sources to target weights by entropy balancing, with built-in functions only.

A document's rate is the one nearest to 1 (in relative entropy between 0 and ``cap``) under which its source
takes the target number of words: cap / (1 + (cap - 1) * exp(-lam * size / mean size)), an exponential tilt of the
odds. The dual has one multiplier lam for each source. Newton steps solve it over a table of
(source, size, count), whose rows stand for all documents; rates then become whole copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.shared import drop, slots, word_count, written
from notewright.operators.ranks import numbered_rows

TOLERANCE, MOST_STEPS = 1e-7, 60


def _targets(sources: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """Adds target: shares of all sizes by weight, none above cap * source_size, the excess reshared by weight.

    Sources are ranked by name in ranges. The words a unit of weight gets rise as sources fill up, until no
    more do: one sum over the sources for each step, and a step fills at least one source.
    """
    place = numbered_rows(sources, [F.col("source").asc_nulls_last()], "_place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = written(place.withColumn("_weight", F.element_at(cycle, (F.pmod("_place", F.lit(len(weights))) + 1).cast("int"))).drop("_place"), "sources")
    most, level = cap * F.col("source_size"), 0.0
    while True:
        full = most <= level * F.col("_weight")
        total, filled, rest = weighed.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("_weight")))).first()
        if not rest:  # no source at all, or all are full
            break
        higher = ((total or 0) - cap * (filled or 0)) / rest
        if higher <= level:
            break
        level = higher
    return weighed.withColumn("target", F.least(most, level * F.col("_weight"))).drop("_weight")


def _rate(cap: float) -> Column:
    """The rate of a row of sizes joined to its source's row."""
    x = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -F.col("lam") * F.col("size") / F.col("mean")))
    return F.when(F.col("target") >= cap * F.col("source_size"), F.lit(cap)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(cap / (1 + (cap - 1) * F.exp(x)))


def _solve(sizes: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """Adds lam to each source: Newton steps, kept inside a bracket that each step narrows."""
    want = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    guess = F.when((want > 0) & (want < cap), -F.ln((cap / want - 1) / (cap - 1))).otherwise(0.0)
    state = written(sources.withColumns({"lam": guess, "low": F.lit(-1e4), "high": F.lit(1e4)}), "multipliers")
    for _ in range(MOST_STEPS):
        met = sizes.join(state, sizes["source"].eqNullSafe(state["source"])).drop(sizes["source"])
        rate = _rate(cap)
        mass = F.col("n") * F.col("size")
        step = met.groupBy("source", "source_size", "mean", "target", "lam", "low", "high").agg(F.sum(mass * rate).alias("got"), F.sum(mass * F.col("size") / F.col("mean") * rate * (1 - rate / cap)).alias("slope"))
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - F.try_divide(F.col("got") - F.col("target"), F.col("slope"))
        off = F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
        done = (off < TOLERANCE) | (F.col("target") >= cap * F.col("source_size")) | (F.col("target") <= 0)
        moved = step.select("source", "source_size", "mean", "target", F.when(done, F.col("lam")).otherwise(F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)).alias("lam"), low.alias("low"), high.alias("high"), F.when(done, 0.0).otherwise(off).alias("off"))
        before, state = state, written(moved, "multipliers")
        drop(before)
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    return state.drop("off")


def _nudged(rows: DataFrame, cap: int) -> DataFrame:
    """One copy more or less of one document in each source, if that brings its words nearer to the target."""
    off = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("off"))
    met = rows.join(off, rows["source"].eqNullSafe(off["source"])).drop(off["source"])
    sign = F.signum("off").cast("long")
    gap = F.abs(F.abs(F.col("off")) - F.col("size"))
    can = (F.col("copies") + sign >= 0) & (F.col("copies") + sign <= cap * F.col("n")) & (gap < F.abs("off"))
    best = met.where(can).groupBy("source").agg(F.min_by(F.struct("size", sign.alias("sign")), F.struct(gap, F.col("size"))).alias("best")).select(F.col("source").alias("_s"), F.col("best.size").alias("_size"), F.col("best.sign").alias("_sign"))
    return rows.join(best, rows["source"].eqNullSafe(best["_s"]) & (rows["size"] == best["_size"]), "left").withColumn("copies", F.col("copies") + F.coalesce("_sign", F.lit(0))).drop("_s", "_size", "_sign")


#: Columns that ``mix_sources`` adds.
ADDED = ("size", "source_size", "target", "copies", "taken")


def _mixed(docs: DataFrame, carried: list[str], weights: list[float], cap: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row (a struct of the ``carried`` columns) and the columns of ADDED, for every row of ``docs``.

    The caller's columns travel in the struct, so they may have any names. Texts are read once: what is made of them is
    written, and only that is counted and dealt out.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.struct(F.lit(0).alias("none"))
    sized = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(text_col).alias("text_key"))
    sized = written(sized, "sized")
    light = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sources = light.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("rows"), F.greatest(F.avg(F.when(F.col("size") > 0, F.col("size").cast("double"))), F.lit(1.0)).alias("mean"))
    sources = written(sources.withColumn("mean", F.coalesce("mean", F.lit(1.0))), "source-sizes")
    rows_in_all = sources.agg(F.sum("rows")).first()[0] or 0
    solved = _solve(light, _targets(sources.drop("rows"), list(weights), float(cap)), float(cap))
    rates = light.join(solved, light["source"].eqNullSafe(solved["source"])).drop(solved["source"]).withColumn("rate", _rate(float(cap)))
    upto = Window.partitionBy("source").orderBy(F.desc("size"))
    reach = F.round(F.sum(F.col("n") * F.col("rate")).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = rates.withColumn("_reach", reach)
    rows = written(ends.withColumn("copies", (F.col("_reach") - F.coalesce(F.lag("_reach").over(upto), F.lit(0.0))).cast("long")).select("source", "size", "n", "source_size", "target", "rate", "copies"), "copies")
    drop(light, sources)
    for _ in range(3):
        before, rows = rows, written(_nudged(rows, cap), "copies")
        drop(before)
    rows = rows.select(F.col("source").alias("_s"), F.col("size").alias("_size"), "source_size", "target", F.floor(F.col("copies") / F.col("n")).cast("int").alias("_each"), F.pmod("copies", "n").alias("_more"))
    ranked = slots(sized, ["source", "size"], ["id", "text_key"], "_slot", rows_in_all)
    met = ranked.join(rows, ranked["source"].eqNullSafe(rows["_s"]) & (ranked["size"] == rows["_size"]))
    copies = F.col("_each") + (F.col("_slot") < F.col("_more")).cast("int")
    return met.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of ``docs`` without its text, with size, source_size, target, copies and taken (copies * size) added.

    Size is the number of words (null: 0). Sources by code point, null last, weigh ``weights``, repeating; their
    targets share all sizes and stop at ``cap`` times their own. A document has 0 to ``cap`` copies; a source's
    words miss its target by about half its largest document at most, mostly by a few words. Documents without
    words get the copies their rate gives but take nothing. Equal documents may differ by one copy; which one
    has more depends on a hash of id and text, so reruns agree. Repeated rows count each by itself. Columns of
    ``docs`` with the names added give way to them; ``mixed_rows`` keeps all. Empty tables give no row.

    Only sizes and hashes of texts are dealt out, besides what else ``docs`` holds; the table of sizes is counted
    before it is dealt, sources and copies are ranked in ranges and blocks, so one hot source is no hot task.
    """
    carried = [c for c in docs.columns if c.lower() not in (*ADDED, text_col.lower())]
    out = _mixed(docs, carried, weights, cap, id_col, text_col, source_col)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in carried], *ADDED)


def mixed_rows(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix_sources`` gives it copies, every column as it was."""
    out = _mixed(docs, docs.columns, weights, cap, id_col, text_col, source_col).where("copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
