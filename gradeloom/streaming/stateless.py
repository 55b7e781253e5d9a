"""Streams that Spark's own operators express: statistics, sessions, rates, deduplication and scoring on event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from gradeloom.operators.inspections import Rule, apply_model_grade, batch_stats, score_inspections
from gradeloom.operators.records import event_envelope


def stream_batch_stats(records: DataFrame) -> DataFrame:
    """Statistics of each batch, kept up to date (output mode ``update``)."""
    return batch_stats(records)


def publish_batch_stats(records: DataFrame, folder: str, kind: str = "batch_statistics") -> DataStreamWriter:
    """A writer of one message ``{type, data, stats}`` for each batch that a micro-batch changed, with its statistics then.

    Messages of a micro-batch lie in a folder of its number, which a repeated micro-batch overwrites: after a crash or a
    restart each message is there once. Start it with a checkpoint location; ``published_stats`` reads it.
    """

    def write(changed: DataFrame, number: int) -> None:
        stats = [c for c in changed.columns if c != "batch_id"]
        event_envelope(changed, kind, ["batch_id"], stats).select("batch_id", "message").write.mode("overwrite").json(f"{folder}/number={number}")

    return stream_batch_stats(records).writeStream.outputMode("update").foreachBatch(write)


def published_stats(spark: SparkSession, folder: str) -> DataFrame:
    """``batch_id, number, message``: the latest message of each batch."""
    messages = spark.read.schema("batch_id long, message string, number long").json(folder)
    return messages.groupBy("batch_id").agg(F.max("number").alias("number"), F.max_by("message", "number").alias("message"))


def stream_sessions(events: DataFrame, key: str, ts: str, gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """Closed sessions of each key (output mode ``append``); a gap of exactly the limit stays in one session."""
    sessions = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_rate(events: DataFrame, ts: str, width: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Events in each closed window."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def stream_dedup(records: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """The first record of each key within the watermark."""
    return records.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def stream_score(records: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """Scores and grades by the rule in force when the query starts; a new rule takes a restart, so only later records see it."""
    return apply_model_grade(score_inspections(records, rule))


def score_each_batch(records: DataFrame, read_rule: Callable[[SparkSession], Rule], write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that reads the saved rule anew for every micro-batch, so that a changed rule counts for later records without a restart."""
    return records.writeStream.foreachBatch(lambda batch, number: write(stream_score(batch, read_rule(batch.sparkSession)), number))
