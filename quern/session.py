"""Getting the package onto executors, and staged tables in the folder that all of them share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Adds this package to the files that Spark hands to every Python worker, once per application.

    Functions that run on executors name the package's modules, and a worker need
    not have the driver's import path.
    """
    context, home = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_quern_shipped", False) or not home.is_dir():
        return
    target = Path(os.path.realpath(tempfile.mkdtemp(prefix="quern-"))) / "quern-package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, Path(home.name) / path.relative_to(home))
    context.addPyFile(str(target))
    context._quern_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode, where none need be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_quern_shared_dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.sparkContext._quern_shared_dir = base
    return base.rstrip("/")


#: Staged tables that no scope has: they stay until the process ends.
_STAGED: list[str] = []
#: Staged tables of the innermost scope that is open in this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("staged tables", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """A scope: what is staged inside, by this thread, is dropped when it ends, also by an error.

    Write or collect what was computed from staged tables before that. Scopes of
    other threads (two streams, a pipeline beside a query) do not see each other;
    a scope within a scope has its own tables.
    """
    own: list[str] = []
    outer = _SCOPE.set(own)
    try:
        yield
    finally:
        _SCOPE.reset(outer)
        for path in reversed(own):
            drop(spark, path)


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back with its schema.

    The table stays until its scope or, outside of any, the process ends.
    """
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    keep(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, path: str) -> None:
    """Counts the table at ``path`` among those of the scope."""
    own = _SCOPE.get()
    if own is not None:
        own.append(path)
        return
    if not _STAGED:
        atexit.register(_at_exit, spark)
    _STAGED.append(path)


def _at_exit(spark: SparkSession) -> None:
    while _STAGED:
        drop(spark, _STAGED.pop())


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table in the shared folder."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is already gone; the shared folder's owner cleans up
        pass

