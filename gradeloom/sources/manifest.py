"""Reading manifests and publishing finished sets of tables."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV file with header (a byte order mark may lead), all values as stripped strings.

    A file without the required columns or without rows is an error.
    """
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    rows = rows.toDF(*[c.removeprefix("\ufeff").strip() for c in rows.columns])
    absent = sorted(set(required) - set(rows.columns))
    if absent:
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in rows.columns])


def publish_dataset(tables: dict[str, DataFrame], path: str, inputs: list[str] = ()) -> None:
    """Write all tables beside ``path``, then rename them into place at once, so that nobody sees half of a set.

    A target that exists is never overwritten, and one inside an input folder is refused.
    """
    target = urlparse(path.rstrip("/")).path
    for i in inputs:
        if (target + "/").startswith(urlparse(i.rstrip("/")).path + "/"):
            raise ValueError(f"{path} lies inside the input {i}")
    spark = next(iter(tables.values())).sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    final, staging = place(path), place(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(final):
        raise FileExistsError(path)
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{staging.toString()}/{name}")
    if files.exists(final) or not files.rename(staging, final):
        raise FileExistsError(path)
