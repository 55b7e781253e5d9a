"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it (clusters ship it with --py-files)."""
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if home not in paths:
        env["PYTHONPATH"] = ":".join([home, *paths])
    return spark


#: Rows of one Arrow batch where texts travel to Python workers.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of this session to ``BATCH_ROWS`` rows, so that long texts take little memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
