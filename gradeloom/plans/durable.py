"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, a new temporary one in local mode (tests).

    On a cluster the setting is needed: executors do not see each other's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Folders that this process wrote.
_WRITTEN: list[str] = []


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_written(spark: SparkSession) -> int:
    """Delete all tables that ``written`` left in this process, once the results that read them are saved. Gives their number."""
    number = len(_WRITTEN)
    _delete(spark, _WRITTEN)
    _WRITTEN.clear()
    return number


def drop_written(table: DataFrame) -> None:
    """Delete a table that ``written`` gave, once nothing reads it any more."""
    path = table._written_at
    _WRITTEN.remove(path)
    _delete(table.sparkSession, [path])


#: Bytes of files up to which a written table may be broadcast: at most some half a million rows of two hashes.
SMALL = 4 << 20


def is_small(table: DataFrame) -> bool:
    """Whether the files of a table that ``written`` gave are small enough for a broadcast."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() <= SMALL


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` as a written table; the tables that were written on the way to it are deleted."""
    before = len(_WRITTEN)
    out = written(make())
    steps = _WRITTEN[before:-1]
    del _WRITTEN[before:-1]
    _delete(spark, steps)
    return out


#: Spark drops the shuffle files of a query at its end where this is set; a written table needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor costs no earlier work.

    The shuffle files of the work go when the table stands, so that disks hold those of one step at a time.
    """
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, "false")
    _WRITTEN.append(path)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table
