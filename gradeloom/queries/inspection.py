"""Queries over inspection records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import inspections as ins
from gradeloom.plans.catalog import query
from gradeloom.plans.fixtures import view, with_views

SCORED = """WITH scored AS (SELECT *, CAST(round(CAST(color_score AS DECIMAL(9,4)) * CAST(0.30 AS DECIMAL(5,4)) + CAST(integrity_score AS DECIMAL(9,4)) * CAST(0.30 AS DECIMAL(5,4))
 + CAST(shape_score AS DECIMAL(9,4)) * CAST(0.15 AS DECIMAL(5,4)) + CAST(size_score AS DECIMAL(9,4)) * CAST(0.10 AS DECIMAL(5,4)) + CAST(defect_score AS DECIMAL(9,4)) * CAST(0.15 AS DECIMAL(5,4)), 1) AS DOUBLE) AS score FROM inspections),
 graded AS (SELECT *, CASE WHEN severity = 'severe' THEN 'C' WHEN score >= 85 THEN 'A' WHEN score >= 65 THEN 'B' ELSE 'C' END AS grade,
 CASE WHEN severity = 'severe' THEN 'severe defect: ' || defect_type ELSE 'weighted score ' || printf('%.1f', score) END AS reason FROM scored) """
#: Means and percentages to one place by whole numbers (of ten-thousandths), halves away from zero.
UNITS = "sum(CAST(CAST({c} AS DECIMAL(18,4)) * 10000 AS BIGINT))"
MEAN = f"sign({UNITS}) * ((20 * abs({UNITS}) + 10000 * count({{c}})) // (20000 * count({{c}})))::DOUBLE / 10"
SHARE = "((2000 * count(*) FILTER (grade = '{g}') + count(*)) // (2 * count(*)))::DOUBLE / 10"
STATS = ", ".join(f"{MEAN.format(c=c)} AS mean_{c}" for c in ins.SCORES)
BATCH = f"""stats AS (SELECT batch_id, count(*) AS total, {MEAN.format(c='score')} AS mean_score, {MEAN.format(c='processing_time')} AS mean_time, {STATS},
 count(*) FILTER (grade = 'A') AS n_a, count(*) FILTER (grade = 'B') AS n_b, count(*) FILTER (grade = 'C') AS n_c,
 {', '.join(f"{SHARE.format(g=g.upper())} AS pct_{g}" for g in 'abc')} FROM graded GROUP BY batch_id)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    defect = F.struct(F.col("defect_type").alias("type"), F.col("defect_type").alias("name"), F.col("severity"))
    return view(spark, sf, "inspections").withColumn("defects", F.array(defect))


def graded(spark: SparkSession, sf: str) -> DataFrame:
    return ins.score_inspections(records(spark, sf))


def sql(text: str) -> str:
    return with_views(SCORED + text, "inspections")


#: What a record may hold besides its scores, some of it broken, and the rules on it in their order.
EXTRA = {"length": "CAST(sample % 7 AS DOUBLE) - 1", "width": "CASE WHEN sample % 5 > 0 THEN CAST(sample % 11 AS DOUBLE) END", "confidence": "CASE WHEN sample % 9 > 0 THEN CAST(sample % 12 AS DOUBLE) / 10 END", "word": "CASE WHEN line = 6 THEN 'odd' WHEN line = 5 THEN NULL ELSE severity END"}
RULES = [f"CASE WHEN {c} < 0 OR {c} > 100 OR {c} IS NULL THEN '{c} outside 0..100' END" for c in ins.SCORES] + [
    "CASE WHEN length <= 0 THEN 'length not above 0' END", "CASE WHEN width <= 0 THEN 'width not above 0' END", "CASE WHEN confidence > 1 THEN 'confidence outside 0..1' END", "CASE WHEN model_score > 100 THEN 'model_score outside 0..100' END",
    "CASE WHEN processing_time < 0 THEN 'processing_time below 0' END", "CASE WHEN model_grade NOT IN ('A', 'B', 'C') THEN 'model_grade unknown' END", "CASE WHEN word = 'odd' THEN 'defect severity unknown' END",
]


@query("A08_validate_inspections", with_views(f"""WITH x AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in EXTRA.items())} FROM inspections), r AS (SELECT *, list_filter([{', '.join(RULES)}], lambda x: x IS NOT NULL) AS reasons FROM x)
 SELECT sample, line, batch_id, reasons, CASE WHEN len(reasons) = 0 THEN coalesce(confidence, 0.95) ELSE confidence END::DOUBLE AS confidence, CASE WHEN len(reasons) = 0 THEN coalesce(word, 'mild') ELSE word END AS severity FROM r""", "inspections"))
def a08(spark, sf):
    rows = view(spark, sf, "inspections").selectExpr("*", *[f"{v} AS {k}" for k, v in EXTRA.items()]).drop("severity")
    rows = rows.withColumn("defects", F.array(F.struct(F.col("defect_type").alias("type"), F.col("defect_type").alias("name"), F.col("word").alias("severity"))))
    valid, rejects = ins.validate(rows)
    both = valid.withColumn("reasons", F.array().cast("array<string>")).unionByName(rejects)
    return both.select("sample", "line", "batch_id", "reasons", "confidence", F.get("defects", F.lit(0))["severity"].alias("severity"))


@query("B01_score_inspections", sql("SELECT sample, line, batch_id, score, grade, reason FROM graded"))
def b01(spark, sf):
    return graded(spark, sf).select("sample", "line", "batch_id", "score", "grade", "reason")


@query("B02_apply_model_grade", sql("""SELECT sample, line, batch_id, coalesce(model_grade, grade) AS grade,
 CASE WHEN model_grade IS NOT NULL THEN coalesce(nullif(model_score, 0), score) ELSE score END AS score, CASE WHEN model_grade IS NOT NULL THEN 'model grade ' || model_grade ELSE reason END AS reason FROM graded"""))
def b02(spark, sf):
    return ins.apply_model_grade(graded(spark, sf)).select("sample", "line", "batch_id", "score", "grade", "reason")


LOGGED = "SELECT *, CASE id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS grade, CASE WHEN id % 2 = 0 THEN 'model grade' ELSE 'weighted score' END AS reason, CASE WHEN id % 5 = 0 THEN 'legacy' ELSE 'camera' END AS source FROM inspection_log"


@query("B06_search_inspections", with_views(f"WITH l AS ({LOGGED}), f AS (SELECT * FROM l WHERE (contains(lower(sample_code), '1') OR contains(lower(variety), '1')) AND grade = 'A' AND source = 'camera' AND reason LIKE 'model%') SELECT *, (SELECT count(*) FROM f) AS total, (SELECT ceil(count(*) / 5.0)::BIGINT FROM f) AS pages FROM f ORDER BY ts DESC, id LIMIT 5 OFFSET 5", "inspection_log"))
def b06(spark, sf):
    more = {"grade": "CASE id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END", "reason": "CASE WHEN id % 2 = 0 THEN 'model grade' ELSE 'weighted score' END", "source": "CASE WHEN id % 5 = 0 THEN 'legacy' ELSE 'camera' END"}
    rows = view(spark, sf, "inspection_log").withColumns({c: F.expr(e) for c, e in more.items()})
    return ins.search(rows, text="1", grade="A", source="camera", model_only=True, page=2, limit=5)


@query("B15_batch_narrative", sql(", " + BATCH + """, d AS (SELECT batch_id, string_agg(defect_type, ', ' ORDER BY n DESC, defect_type) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, defect_type) AS place FROM (SELECT batch_id, defect_type, count(*) AS n FROM graded GROUP BY 1, 2)) WHERE place <= 2 GROUP BY batch_id)
 SELECT batch_id, 'Batch ' || batch_id || ': ' || total || ' items, mean score ' || printf('%.1f', mean_score) || ', A ' || printf('%.1f', pct_a) || ' %, quality ' || CASE WHEN pct_a >= 50 THEN 'good' WHEN pct_c < 25 THEN 'fair' ELSE 'needs attention' END || '; ' || coalesce(worst, 'no frequent defect') AS narrative FROM stats LEFT JOIN d USING (batch_id)"""))
def b15(spark, sf):
    return ins.narrative(ins.batch_stats(graded(spark, sf)), ins.top_defects(records(spark, sf)))


@query("C17_score_as_of", with_views("""WITH v(valid_from, w1, w2, w3, w4, w5, a_min, b_min) AS (SELECT CAST(d AS TIMESTAMP), a, b, 0.15, 0.10, 0.15, 85.0, 65.0 FROM (VALUES ('1992-01-01', 0.30, 0.30), ('1995-06-01', 0.20, 0.40)) AS t(d, a, b)),
 s AS (SELECT sample, line, batch_id, severity, CASE WHEN ts < TIMESTAMP '1995-06-01' THEN 0.30 ELSE 0.20 END AS wa, CASE WHEN ts < TIMESTAMP '1995-06-01' THEN 0.30 ELSE 0.40 END AS wb, color_score, integrity_score, shape_score, size_score, defect_score FROM inspections WHERE ts >= TIMESTAMP '1992-01-01'),
 r AS (SELECT sample, line, batch_id, severity, CAST(round(CAST(color_score AS DECIMAL(9,4)) * CAST(wa AS DECIMAL(5,4)) + CAST(integrity_score AS DECIMAL(9,4)) * CAST(wb AS DECIMAL(5,4)) + CAST(shape_score AS DECIMAL(9,4)) * CAST(0.15 AS DECIMAL(5,4))
 + CAST(size_score AS DECIMAL(9,4)) * CAST(0.10 AS DECIMAL(5,4)) + CAST(defect_score AS DECIMAL(9,4)) * CAST(0.15 AS DECIMAL(5,4)), 1) AS DOUBLE) AS score FROM s)
 SELECT sample, line, batch_id, score, CASE WHEN severity = 'severe' THEN 'C' WHEN score >= 85 THEN 'A' WHEN score >= 65 THEN 'B' ELSE 'C' END AS grade FROM r""", "inspections"))
def c17(spark, sf):
    rules = spark.createDataFrame([("1992-01-01", 0.3, 0.3), ("1995-06-01", 0.2, 0.4), ("1997-01-01", 0.9, 0.9)], "d string, w1 double, w2 double")
    rules = rules.select(F.col("d").cast("timestamp").alias("valid_from"), "w1", "w2", *[F.lit(w).alias(n) for n, w in (("w3", 0.15), ("w4", 0.10), ("w5", 0.15), ("a_min", 85.0), ("b_min", 65.0))])
    return ins.score_as_of(records(spark, sf), rules).select("sample", "line", "batch_id", "score", "grade")


@query("D01_batch_stats", sql(", " + BATCH + " SELECT * FROM stats"))
def d01(spark, sf):
    return ins.batch_stats(graded(spark, sf))


@query("D02_score_distribution", sql("""SELECT batch_id, count(*) FILTER (score < 60) AS under_60, count(*) FILTER (score >= 60 AND score < 70) AS under_70, count(*) FILTER (score >= 70 AND score < 80) AS under_80,
 count(*) FILTER (score >= 80 AND score < 90) AS under_90, count(*) FILTER (score >= 90) AS from_90 FROM graded GROUP BY batch_id"""))
def d02(spark, sf):
    return ins.score_distribution(graded(spark, sf))


@query("D03_top_defects", with_views("SELECT * FROM (SELECT batch_id, defect_type AS defect, count(*) AS n, row_number() OVER (PARTITION BY batch_id ORDER BY count(*) DESC, defect_type) AS place FROM inspections GROUP BY batch_id, defect_type) WHERE place <= 8", "inspections"))
def d03(spark, sf):
    return ins.top_defects(records(spark, sf))


@query("D04_list_batches", sql(", " + BATCH + " SELECT s_suppkey AS batch_id, coalesce(total, 0) AS total, coalesce(mean_score, 0) AS mean_score FROM supplier LEFT JOIN stats ON s_suppkey = batch_id"))
def d04(spark, sf):
    return ins.list_batches(spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("batch_id")), ins.batch_stats(graded(spark, sf)))


@query("D05_live_summary", sql("SELECT defect_type AS kind, grade, count(*) AS n FROM graded GROUP BY defect_type, grade"))
def d05(spark, sf):
    return ins.live_summary(graded(spark, sf), "defect_type")


@query("E13_rate_per_window", with_views("SELECT date_trunc('second', ts) AS start, count(*) AS n FROM inspection_log GROUP BY 1", "inspection_log"))
def e13(spark, sf):
    return ins.rate_per_window(view(spark, sf, "inspection_log"))


@query("G04_clear_batch", with_views("SELECT * FROM inspection_log WHERE batch_id IS DISTINCT FROM 7", "inspection_log"))
def g04(spark, sf):
    return ins.clear_batch(view(spark, sf, "inspection_log"), 7)


@query("G06_ensure_batches", with_views("SELECT s_suppkey AS batch_id, 'saved' AS source FROM supplier UNION ALL SELECT DISTINCT batch_id, 'auto' FROM inspection_log WHERE batch_id IS NOT NULL AND batch_id NOT IN (SELECT s_suppkey FROM supplier)", "inspection_log"))
def g06(spark, sf):
    saved = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("batch_id"), F.lit("saved").alias("source"))
    return ins.ensure_batches(saved, view(spark, sf, "inspection_log"))
