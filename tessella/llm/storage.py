"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}
# The open scratch folders of this thread, so that jobs of several threads don't delete each other's tables.
_SCOPES: ContextVar[tuple[str, ...]] = ContextVar("tessella_scratch", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; unset, a temporary one if the master is local, else an error."""
    named = spark.conf.get(_KEY, None)
    if not named:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError(f"{_KEY} is not set; it must name a folder that all executors see")
        named = _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="tessella-"))
    return named.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tessella/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, within the innermost open ``scratch``."""
    return "/".join([_folder(spark), *_SCOPES.get()[-1:], f"{label}-{uuid.uuid4().hex}"])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written within go at its end, so what is made of them has to be written elsewhere before."""
    name = f"scratch-{uuid.uuid4().hex}"
    before = _SCOPES.set((*_SCOPES.get(), name))
    try:
        yield
    finally:
        _SCOPES.reset(before)
        _delete(spark, f"{_folder(spark)}/{name}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again, which cuts its lineage.

    Values such as partition numbers are fixed from here on, and a lost
    executor costs a read of the file rather than the work before it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals out both sides by the key, whatever their sizes.

    For tables that grow with the input: Spark takes a file's compressed
    columns and the rows of an explode for smaller than they are in memory,
    and would broadcast them by way of the driver.
    """
    return df.hint("merge")


def discard(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written."""
    _delete(spark, _folder(spark))
