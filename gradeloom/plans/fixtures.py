"""Views over the provided tables, written once for Spark and for the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (base table, select list). The expressions mean the same in Spark and in ANSI SQL engines.
VIEWS = {
    "inspections": ("lineitem", [
        "l_suppkey AS batch_id", "l_orderkey AS sample", "l_linenumber AS line",
        "CAST(l_quantity * 2 AS DOUBLE) AS color_score", "CAST(100 - l_discount * 1000 AS DOUBLE) AS integrity_score",
        "CAST(100 - l_tax * 1000 AS DOUBLE) AS shape_score", "CAST(l_partkey % 101 AS DOUBLE) AS size_score",
        "CAST(l_orderkey % 101 AS DOUBLE) AS defect_score",
        "CASE WHEN l_returnflag = 'A' THEN 'severe' WHEN l_returnflag = 'R' THEN 'moderate' ELSE 'mild' END AS severity",
        "l_linestatus AS defect_type", "CAST(l_shipdate AS TIMESTAMP) AS ts",
        "CASE WHEN l_orderkey % 5 = 0 THEN 'A' WHEN l_orderkey % 5 = 1 THEN 'C' END AS model_grade",
        "CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE CAST(l_partkey % 97 AS DOUBLE) END AS model_score",
        "CAST(l_partkey % 200 AS DOUBLE) AS processing_time",
    ]),
    "inspection_log": ("events", [
        "event_id AS id", "concat('P-', CAST(event_id AS VARCHAR(20))) AS sample_code", "user_id AS batch_id", "event_type AS variety",
        "CAST(least(100.0, greatest(0.0, CAST(value AS DOUBLE))) AS DOUBLE) AS score", "CAST(ts AS TIMESTAMP) AS ts",
    ]),
    "boxes": ("events", [
        "event_id AS box", "event_id - event_id % 8 AS image", "(event_id * 37) % 200 AS x1", "(event_id * 53) % 150 AS y1",
        "(event_id * 37) % 200 + 24 + (event_id * 7) % 60 AS x2", "(event_id * 53) % 150 + 24 + (event_id * 11) % 80 AS y2",
        "((event_id * 31) % 97 + 1) / CAST(98 AS DOUBLE) AS confidence", "((event_id * 17) % 89) / CAST(89 AS DOUBLE) AS red_core",
    ]),
    "manifest": ("documents", [
        "doc_id AS path", "source AS source_id", "concat(source, ':', lang) AS group_id", "lang AS origin", "text AS text",
        "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split",
        "doc_id % 4 AS class_id", "n_chars AS n_chars",
    ]),
    "predictions": ("documents", [
        "doc_id AS path", "source AS group_id", "doc_id % 4 AS class_id",
        "((doc_id * 2654435761 + 7) % 9973 + 1) / CAST(9975 AS DOUBLE) AS k1", "((doc_id * 2654435761 + 108) % 9973 + 1) / CAST(9975 AS DOUBLE) AS g0",
        "((doc_id * 2654435761 + 209) % 9973 + 1) / CAST(9975 AS DOUBLE) AS g1",
    ]),
    "predictions_b": ("documents", [
        "doc_id AS path", "source AS group_id", "doc_id % 4 AS class_id",
        "((doc_id * 2654435761 + 1017) % 9973 + 1) / CAST(9975 AS DOUBLE) AS k1", "((doc_id * 2654435761 + 1118) % 9973 + 1) / CAST(9975 AS DOUBLE) AS g0",
        "((doc_id * 2654435761 + 1219) % 9973 + 1) / CAST(9975 AS DOUBLE) AS g1",
    ]),
    "features": ("embeddings", [
        "vec_id AS path", "vec_id % 25 AS group_id", "label % 2 AS kind", "embedding AS embedding", "label AS label",
    ]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def with_views(sql: str, *names: str) -> str:
    """``sql`` after the views that it reads."""
    parts = [f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names]
    return "WITH " + ", ".join(parts) + (", " + sql.lstrip()[5:] if sql.lstrip().upper().startswith("WITH ") else " " + sql)
