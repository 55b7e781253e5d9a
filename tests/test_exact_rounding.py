"""Means on an exact half, and losses whose logarithms are equal or not by engine: results do not hang on the order of sums or on a library's last bit."""

import duckdb

import __spark_entry__ as entry
from gradeloom.operators import inspections as ins


def test_means_on_a_half_go_up(spark):
    # the doubles add up to a little less than the exact sum
    scores = [30.2, 56.4, 26.0, 72.9, 48.9, 32.3]
    rows = [(1, *[80.0] * 5, x, "mild", []) for x in scores]
    schema = "batch_id long, color_score double, integrity_score double, shape_score double, size_score double, defect_score double, processing_time double, severity string, defects array<struct<type:string,name:string,severity:string>>"
    stats = ins.batch_stats(ins.score_inspections(spark.createDataFrame(rows, schema).coalesce(1))).first()
    assert stats.mean_time == 44.5
    less = ins.batch_stats(ins.score_inspections(spark.createDataFrame([(1, *[80.0] * 5, -x, "mild", []) for x in scores] + [(2, *[80.0] * 5, None, "mild", [])], schema)))
    assert {r.batch_id: r.mean_time for r in less.collect()} == {1: -44.5, 2: None}


def test_small_losses_go_by_probability(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(60_000).selectExpr("id AS doc_id", "'' AS text", "'en' AS lang", "'web' AS source", "0L AS n_chars").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = entry.queries()["E10_small_loss_select"](spark, folder).select("path", "class_id", "place").collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(entry.oracle_sql()["E10_small_loss_select"]).fetchall())
