"""Results that outlive the executors that made them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="revisit-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints.

    A folder of our own is taken only where none is named and all tasks run on this machine;
    on a cluster that would be a folder that executors cannot see, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = made.get() if made.isDefined() else None
    if named is not None:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _own_folder()
    raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Delete a copy, on whatever file system it is."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def durable_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path for ``forget``.

    Copies may be as large as the input or larger, and several lie there at once: they are packed tightly.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, columnar, prunable."""
    return durable_at(df, name)[0]


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A path in the shared folder that is gone when the block ends."""
    path = new_path(spark, name)
    try:
        yield path
    finally:
        forget(spark, path)
