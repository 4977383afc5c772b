"""Jobs over streams of notes, edits and posts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from notewright.operators.forum import post_key
from notewright.plans.typeset import LayoutOptions, typeset
from notewright.session import ship_package, table_scope

#: Microseconds: a burst ends after the first, and edits later than the second after its first do not count.
QUIET, LONGEST = 5_000_000, 20_000_000
#: Of edits that no longer count the outer ones of each such cell stay, which keep the burst together.
CELL = 2_000_000


def settled_edits(edits: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """One row for each burst of edits (note_id, ts): note_id, first_edit, last_edit, n_edits.

    A burst ends after five quiet seconds; edits later than twenty seconds after its first do not count, nor do those without
    a time. On a table a burst of any length is never gathered. On a stream a row comes when the watermark has passed the
    burst's end; edits older than the watermark are late and left out; Spark's watermarks ask for times with a zone. The state of a note is four numbers for what the
    watermark has passed; of later edits it holds those of a burst's first twenty seconds and two for each further cell.
    """
    return _settled_stream(edits, lateness) if edits.isStreaming else _settled_table(edits)


@dataclass
class Burst:
    """An open burst, in microseconds: its first edit, the last and the number of those that count, and the last of all."""

    first: int
    last: int
    n: int
    seen: int


def _runs(times: np.ndarray) -> list[np.ndarray]:
    """Sorted times, cut where five seconds are quiet."""
    return np.split(times, np.flatnonzero(np.diff(times) >= QUIET) + 1) if len(times) else []


def settle(burst: Burst | None, times: np.ndarray, passed: int) -> tuple[Burst | None, np.ndarray, list[Burst]]:
    """The open burst, the times that stay, and the bursts that have ended, once no edit up to ``passed`` can come any more.

    ``times`` are sorted and hold every edit after the last ``passed``.
    """
    due, ahead = np.split(times, [np.searchsorted(times, passed, "right")])
    ended: list[Burst] = []
    for run in _runs(due):
        if burst is not None and run[0] - burst.seen >= QUIET:
            ended.append(burst)
            burst = None
        burst = burst or Burst(int(run[0]), int(run[0]), 0, int(run[0]))
        counted = int(np.searchsorted(run, burst.first + LONGEST, "right"))
        burst = Burst(burst.first, int(run[counted - 1]) if counted else burst.last, burst.n + counted, int(run[-1]))
    if burst is not None and burst.seen + QUIET <= passed + 1:
        ended.append(burst)
        burst = None
    return burst, _thinned(burst, ahead), ended


def _thinned(burst: Burst | None, ahead: np.ndarray) -> np.ndarray:
    """Times that may still count, and the outer ones of each cell after them. A burst's first edit can only become
    earlier, so what is too late for it now will always be."""
    kept = [ahead[:0]]
    for run in _runs(ahead):
        first = burst.first if burst is not None and run[0] - burst.seen < QUIET else run[0]
        some, rest = np.split(run, [np.searchsorted(run, first + LONGEST, "right")])
        cell = rest // CELL
        outer = np.ones(len(rest), bool)
        outer[1:-1] = (cell[1:-1] != cell[:-2]) | (cell[1:-1] != cell[2:])
        kept += [some, rest[outer]]
    return np.concatenate(kept)


def _settle_note(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One note's edits of a micro-batch, or its timeout."""
    first, last, n, seen, packed = state.getOption or (0, 0, 0, 0, b"")
    new = [f["_us"].to_numpy(np.int64) for f in frames]
    times = np.sort(np.concatenate([np.frombuffer(bytes(packed), np.int64), *new]))
    watermark = state.getCurrentWatermarkMs()
    burst, ahead, ended = settle(Burst(first, last, n, seen) if n else None, times, watermark * 1000)
    if burst is None and not len(ahead):
        state.remove()
    else:
        b = burst or Burst(0, 0, 0, 0)
        state.update((b.first, b.last, b.n, b.seen, ahead.tobytes()))
        # The next burst to end is the first; a timeout comes when the watermark is above its time.
        end = int(_runs(np.concatenate([[burst.seen], ahead]) if burst is not None else ahead)[0][-1])
        state.setTimeoutTimestamp(max(-(-(end + QUIET - 1) // 1000) - 1, watermark + 1))
    yield pd.DataFrame({"_key": [key[0]] * len(ended), "_first": [b.first for b in ended], "_last": [b.last for b in ended], "n_edits": [b.n for b in ended]})


def _settled_stream(edits: DataFrame, lateness: str) -> DataFrame:
    ship_package(edits.sparkSession)
    # A key of text is the same in pandas whether or not some are null.
    keyed = edits.where("ts is not null").withWatermark("ts", lateness).select("ts", F.col("note_id").cast("string").alias("_key"), F.unix_micros("ts").alias("_us"))
    settled = keyed.groupBy("_key").applyInPandasWithState(_settle_note, "_key string, _first long, _last long, n_edits long", "first long, last long, n long, seen long, ahead binary", "append", GroupStateTimeout.EventTimeTimeout)
    return settled.select(F.col("_key").cast(edits.schema["note_id"].dataType).alias("note_id"), F.timestamp_micros("_first").alias("first_edit"), F.timestamp_micros("_last").alias("last_edit"), "n_edits")


def _settled_table(edits: DataFrame) -> DataFrame:
    """Edits in one cell of five seconds belong to one burst: cells are counted first, then joined to bursts, each with three
    numbers. Of bursts over twenty seconds, which are few, the edits that count are looked up by cells of that length."""
    # A time without a zone is counted as if in UTC, where no hour is missing.
    instant = F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp") if dict(edits.dtypes)["ts"] == "timestamp_ntz" else F.col("ts")
    times = edits.where("ts is not null").select("note_id", "ts", F.unix_micros(instant).alias("_us"))
    cells = times.groupBy("note_id", F.floor(F.col("_us") / 5_000_000).alias("_cell")).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_to"), F.max("_us").alias("_hi"), F.min("_us").alias("_low"), F.count(F.lit(1)).alias("_n"))
    gap = F.make_interval(secs=((F.col("_hi") - F.col("_low") + 4_999_999) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    bursts = cells.groupBy("note_id", F.session_window("_lo", gap)).agg(F.min("_low").alias("_first"), F.max("_hi").alias("_last"), F.min("_lo").alias("first_edit"), F.max("_to").alias("last_edit"), F.sum("_n").alias("_all"))
    last = F.col("_first") + 20_000_000
    ends = bursts.where(F.col("_last") > last).select(F.col("note_id").alias("_note"), "_first", "first_edit", F.explode(F.array_distinct(F.array(F.floor(F.col("_first") / 20_000_000), F.floor(last / 20_000_000)))).alias("_part"))
    met = times.join(ends, F.col("note_id").eqNullSafe(F.col("_note")) & (F.floor(F.col("_us") / 20_000_000) == F.col("_part")) & F.col("_us").between(F.col("_first"), last))
    long = met.groupBy("note_id", "first_edit").agg(F.max("ts").alias("last_edit"), F.count(F.lit(1)).alias("n_edits"))
    return bursts.where(F.col("_last") <= last).select("note_id", "first_edit", "last_edit", F.col("_all").alias("n_edits")).union(long)


def distinct_post_stream(posts: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Posts (topic, floor, user, body, ts) without repeats that arrive within the watermark."""
    return posts.withColumn("post_key", post_key()).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["topic", "post_key"])


def tidy_batch(notes: DataFrame, number: int, target: str, options: LayoutOptions = LayoutOptions()) -> None:
    """Lays out one micro-batch until no note changes, and writes it as the folder ``batch=number`` of ``target``.

    A batch that runs again, after a driver was lost, replaces its folder, so each note is there once.
    """
    with table_scope():
        done = typeset(notes, options)
        done.select(*[F.col("new_text").alias("text") if c == "text" else c for c in notes.columns]).write.mode("overwrite").parquet(f"{target}/batch={number}")


def tidy_stream(notes: DataFrame, target: str, checkpoint: str, options: LayoutOptions = LayoutOptions()) -> StreamingQuery:
    """Lays out notes as they arrive: the same steps as for tables, on each micro-batch. Read the result with ``tidied``."""
    return notes.writeStream.foreachBatch(lambda df, number: tidy_batch(df, number, target, options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tidied(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The notes that ``tidy_stream`` has laid out, with the number of their batch."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", target).parquet(target)
