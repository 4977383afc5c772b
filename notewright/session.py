"""What jobs need from a session: the package on the workers, and tables in the folder that all machines share."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: The paths of written tables, and the scope of the running thread or task.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SCOPE: contextvars.ContextVar[TableScope | None] = contextvars.ContextVar("notewright_scope", default=None)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    home = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="notewright-")) / "notewright_package.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(to))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Readies a session for Arrow functions: workers get this package, and a batch holds at most ``rows`` rows,
    so that texts of a megabyte still fit in a worker."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where both are unset, a session in one JVM gets a temporary folder; on a cluster no machine-local folder will do,
    so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="notewright-")
        context.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/notewright/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    if (scope := _SCOPE.get()) is not None:
        scope.tables.append(out)
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` gave, when what was made of them has been written in turn. Others are left."""
    for table in tables:
        path = _PATHS.pop(table, None) if table is not None else None
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class TableScope:
    """The tables written in a ``with table_scope()`` block by its own thread."""

    def __init__(self, outer: TableScope | None) -> None:
        self.outer = outer
        self.tables: list[DataFrame] = []

    def keep(self, *tables: DataFrame) -> None:
        """Leaves tables to the scope around this one, or, without one, to the caller."""
        for table in tables:
            self.tables = [t for t in self.tables if t is not table]
            if self.outer is not None:
                self.outer.tables.append(table)


@contextlib.contextmanager
def table_scope() -> Iterator[TableScope]:
    """Drops, at its end, the tables written inside it but those kept. Save the results of jobs before.

    A scope sees only what its own thread (or task of an event loop) writes: jobs side by side in one session, streams among
    them, never drop one another's tables.
    """
    scope = TableScope(_SCOPE.get())
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        drop(*scope.tables)
