"""Batch twins of operators on streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.plans.catalog import query
from gradeloom.streaming.stateful import presence_events


@query("M02_presence_gate", """WITH f AS (SELECT user_id AS camera, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, (event_id % 5 < 2)::INT AS boxes FROM events),
 g AS (SELECT *, frame - max(CASE WHEN boxes > 0 THEN frame END) OVER (PARTITION BY camera ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM f)
 SELECT camera, frame, CASE WHEN boxes > 0 AND gap <= 3 THEN 'live_detection' WHEN boxes > 0 THEN 'detection_group' ELSE 'target_cleared' END AS event FROM g WHERE boxes > 0 OR gap = 3""")
def m02(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return presence_events(events.select(F.col("user_id").alias("camera"), frame.alias("frame"), F.expr("cast(event_id % 5 < 2 as int)").alias("boxes")), "camera")
