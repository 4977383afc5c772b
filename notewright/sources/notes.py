"""Reading notes, canvases and file inventories; writing what changed; plans and reports."""

from __future__ import annotations

import hashlib
import re
import string
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from notewright.session import ship_package, written

#: Extensions that count as images when importing, renaming and merging; and everywhere else.
IMPORT_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "heic")
IMAGE_EXTENSIONS = (*IMPORT_EXTENSIONS, "avif", "svg")

PLAN_COLUMNS = ("action", "src", "dst", "note_id", "reason")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _relative(root: str) -> Column:
    """The path of a file below ``root``."""
    at = F.try_url_decode(F.regexp_replace(F.col("_metadata.file_path"), "\\+", "%2B"))
    base = root.rstrip("/").removeprefix("file:").lstrip("/")
    return F.regexp_replace(at, F.lit("^.*?" + base.replace(".", "\\.") + "/"), F.lit(""))


def read_notes(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """Every note below ``root`` as one row: note_id (a hash of the path), path, folder, text."""
    read = spark.read.text(root, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    return read.select(_relative(root).alias("path"), F.col("value").alias("text")).select(F.xxhash64("path").alias("note_id"), "path", _folder(F.col("path")).alias("folder"), "text")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Notes and canvases, told apart by ext."""
    both = read_notes(spark, root).withColumn("ext", F.lit("md")).unionByName(read_notes(spark, root, "*.canvas").withColumn("ext", F.lit("canvas")))
    return both


def read_inventory(spark: SparkSession, root: str, uris: bool = False) -> DataFrame:
    """Every file below ``root``: path, name, ext, folder, size, and with ``uris`` its whole address, by which jobs that
    compare contents read the few files they need. Contents are pruned from the scan."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = read.select(_relative(root).alias("path"), F.col("length").alias("size"), F.col("_metadata.file_path").alias("uri"))
    out = at.select("path", _name(F.col("path")).alias("name"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), _folder(F.col("path")).alias("folder"), "size", "uri")
    return out if uris else out.drop("uri")


def _opened(uri: str) -> pa.NativeFile | None:
    """The file of an address, as a stream; null: gone. Other failures are the task's, which Spark tries again."""
    scheme, _, rest = uri.partition(":")
    if rest.startswith("/") and not rest.startswith("//"):
        uri = f"{scheme}://{rest}"
    system, at = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", urllib.parse.quote(uri, safe=string.punctuation)))
    try:
        return system.open_input_stream(at, compression=None)
    except FileNotFoundError:
        return None


def read_digests(files: DataFrame, bytes_a_task: int = 256 << 20, files_a_task: int = 10_000) -> DataFrame:
    """``files`` (size, uri and any columns) with digest, the SHA-256 of each file's bytes; a file that is gone has none.

    The files are dealt to as many tasks as their number and bytes ask for; each is read once, a megabyte at a time. No
    other file is opened, whatever the number of files.
    """
    ship_package(files.sparkSession)
    few = written(files, "files-to-read")
    n, size = few.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    names = [*files.columns, "digest"]

    def digest(uri: str | None) -> str | None:
        stream = _opened(uri) if uri is not None else None
        if stream is None:
            return None
        sha = hashlib.sha256()
        with stream:
            while part := stream.read(1 << 20):
                sha.update(part)
        return sha.hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([digest(u) for u in b.column("uri").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names)

    tasks = max(1, -(-n // files_a_task), -(-size // bytes_a_task))
    return few.repartition(tasks, F.xxhash64("uri")).mapInArrow(work, StructType([*few.schema.fields, StructField("digest", StringType())]))


def in_folder(df: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Rows below a folder; ``/`` or nothing: all."""
    return df if folder in ("", "/") else df.where(F.col(path).startswith(folder.rstrip("/") + "/"))


def images_only(files: DataFrame, extensions: tuple[str, ...] = IMPORT_EXTENSIONS) -> DataFrame:
    return files.where(F.lower("ext").isin(*extensions))


def all_documents(notes: DataFrame, canvases: DataFrame) -> DataFrame:
    """Notes and canvases in one table."""
    cols = ["note_id", "path", "folder", "text"]
    return notes.select(*cols).unionByName(canvases.select(*cols))


def changed_only(before: DataFrame, after: DataFrame, key: str = "note_id") -> DataFrame:
    """Rows of ``after`` whose text differs from that of the same note before."""
    old = before.select(F.col(key).alias("_key"), F.col("text").alias("_old"))
    return after.join(old, F.col(key) == F.col("_key")).where(~F.col("text").eqNullSafe(F.col("_old"))).drop("_key", "_old")


def run_report(df: DataFrame, before: str = "text", after: str = "new_text") -> DataFrame:
    """One row: notes processed, changed and failed (unreadable, so without text); a bad row fails no job."""
    return df.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col(before).isNotNull() & ~F.col(before).eqNullSafe(F.col(after))).alias("changed"), F.count_if(F.col(before).isNull()).alias("failed"))


def plan_rows(df: DataFrame, action: str | Column, src: Column, dst: Column, note_id: Column | None = None, reason: Column | None = None) -> DataFrame:
    """Rows of a change plan; nothing is moved, renamed or deleted by the jobs themselves."""
    what = F.lit(action) if isinstance(action, str) else action
    return df.select(what.alias("action"), src.alias("src"), dst.alias("dst"), (note_id if note_id is not None else F.lit(None)).cast("long").alias("note_id"), (reason if reason is not None else F.lit(None)).cast("string").alias("reason"))


def write_plan(plan: DataFrame, path: str) -> None:
    plan.write.mode("overwrite").partitionBy("action").parquet(path)


def organise_report(plan: DataFrame) -> DataFrame:
    """Counts of a plan's actions, with the distinct reasons in order."""
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))
