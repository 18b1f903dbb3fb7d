"""Intermediate tables in the folder that the whole cluster shares.

A result that several later jobs read, or that ends an iteration, is written once as Parquet under
``spark.checkpoint.dir`` and read back. That cuts its lineage and survives lost executors, unlike a local checkpoint.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from quern.session import prepared

_OWN: dict[str, str] = {}
#: Tables written inside each open :func:`scope` of this thread or task, innermost last.
_SCOPES: ContextVar[tuple[dict[str, DataFrame], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset and Spark runs in one local process, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _OWN[app]


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for whatever is written there; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)  # a path that isn't there can't be marked
    files.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` as a table of the shared folder, in folders by the columns ``by``. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    prepared(spark)
    path = f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    if scopes := _SCOPES.get():
        scopes[-1][path] = out
    return out


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose tables go when it ends, but for those that the function it gives was called with. Whatever a block
    returns must be built on those alone."""
    made: dict[str, DataFrame] = {}
    before = _SCOPES.get()
    _SCOPES.set((*before, made))
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _SCOPES.set(before)
        for path, df in made.items():
            if not any(df is k for k in kept):
                _delete(df.sparkSession, path)
            elif before:
                before[-1][path] = df


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)
