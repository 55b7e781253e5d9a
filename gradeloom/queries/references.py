"""Queries that hold new rows against references, parse text and fit models."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import parsing as ps
from gradeloom.operators import fitting as ft
from gradeloom.operators import references as rf
from gradeloom.plans.catalog import query
from gradeloom.plans.durable import written
from gradeloom.plans.fixtures import view, with_views
from gradeloom.queries.evaluation import rounded
from gradeloom.queries.records import PRINTS, TRAIN, features, prints

#: One row in twenty is a query; every row is a reference in the scope of its split, for all rows but itself.
CROSS = f"WITH {PRINTS}, refs AS (SELECT split AS scope, hi, lo, list_sort(list(path))[:2] AS refs FROM fp JOIN manifest USING (path) GROUP BY ALL), near AS (SELECT n.path, scope, CASE WHEN refs[1] = n.path THEN refs[2] ELSE refs[1] END AS ref, bit_count(xor(n.hi, r.hi)) + bit_count(xor(n.lo, r.lo)) AS bits FROM fp n JOIN refs r ON n.path % 20 = 0 WHERE refs[1] <> n.path OR len(refs) > 1)"


def both_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    marks = written(prints(spark, sf))
    scope = view(spark, sf, "manifest").selectExpr("path", "split AS scope")
    return marks.filter("path % 20 = 0"), marks.join(scope.hint("merge"), "path")


@query("C08_cross_reference_matches", with_views(f"{CROSS} SELECT path, scope, CASE WHEN scope <> 'test' THEN ref END AS ref, bits FROM near WHERE bits <= 6", "manifest"))
def c08(spark, sf):
    return rf.cross_reference_matches(*both_sides(spark, sf), 6, "test")


@query("C09_nearest_reference", with_views(f"{CROSS} SELECT path, scope, min(bits) AS bits, arg_min(ref, bits * 1000000000000 + ref) AS ref FROM near GROUP BY path, scope", "manifest"))
def c09(spark, sf):
    return rf.nearest_reference(*both_sides(spark, sf))


#: The part of a row by a hash of its path: three quarters train, an eighth each val and new.
PART = "CASE WHEN substr(md5(CAST(path AS VARCHAR(20))), 1, 1) < 'c' THEN 't' WHEN substr(md5(CAST(path AS VARCHAR(20))), 1, 1) < 'e' THEN 'v' ELSE 'n' END"


def near_sql(new: str, base: str) -> str:
    return f"f AS (SELECT path, label, embedding::DOUBLE[] AS v, {PART} AS part FROM features), b AS (SELECT n.path, n.label, max(CASE WHEN t.label = n.label THEN list_cosine_similarity(n.v, t.v) END) AS same, max(CASE WHEN t.label <> n.label THEN list_cosine_similarity(n.v, t.v) END) AS other FROM f n JOIN f t ON {new} AND {base} AND n.path <> t.path GROUP BY ALL)"


@query("C14_domain_neighbours", with_views(f"WITH {near_sql('n.path % 20 = 0', 'true')} SELECT path, round(same, 6) AS same, round(other, 6) AS other FROM b", "features"))
def c14(spark, sf):
    rows = features(spark, sf)
    return rounded(rf.domain_neighbours(rows.filter("path % 20 = 0"), rows, "label", "v"))


@query("D25_domain_shift", with_views(f"""WITH {near_sql("n.part = 'n'", "t.part = 't'")}, x AS (SELECT label, part, unnest(v) / sqrt(list_dot_product(v, v)) AS x, generate_subscripts(v, 1) AS place FROM f),
 m AS (SELECT label, part, place, avg(x) AS x FROM x GROUP BY ALL), c AS (SELECT label, part, list(x ORDER BY place) AS c FROM m GROUP BY ALL),
 s AS (SELECT f.label, median(1 - list_cosine_similarity(v, c)) AS spread FROM f JOIN c ON c.label = f.label AND c.part = 't' WHERE f.part = 't' GROUP BY f.label),
 d AS (SELECT t.label, max(CASE WHEN o.part = 'v' THEN 1 - list_cosine_similarity(t.c, o.c) END) AS val_shift, max(CASE WHEN o.part = 'n' THEN 1 - list_cosine_similarity(t.c, o.c) END) AS new_shift FROM c t JOIN c o USING (label) WHERE t.part = 't' GROUP BY t.label),
 k AS (SELECT label, median(same) AS same, median(other) AS other FROM b GROUP BY label),
 w AS (SELECT label, spread, val_shift, new_shift, CASE WHEN val_shift > 0 THEN new_shift / val_shift END AS ratio, same, other FROM s LEFT JOIN d USING (label) LEFT JOIN k USING (label)),
 u AS (SELECT * FROM w UNION ALL SELECT NULL, median(spread), median(val_shift), median(new_shift), median(ratio), median(same), median(other) FROM w)
 SELECT label, round(spread, 6) AS spread, round(val_shift, 6) AS val_shift, round(new_shift, 6) AS new_shift, round(ratio, 6) AS ratio, round(same, 6) AS same, round(other, 6) AS other FROM u""", "features"))
def d25(spark, sf):
    rows = features(spark, sf).withColumn("part", F.expr(PART))
    return rounded(rf.domain_shift(*[rows.filter(F.col("part") == p) for p in "tvn"], "label", "v"))


TEXT = "CASE event_id % 5 WHEN 0 THEN '[1, 2, 3]' WHEN 1 THEN '[1, null, 3, 4]' WHEN 2 THEN 'none' ELSE concat('[', CAST(event_id AS VARCHAR(20)), ', 2.5, 3, -4]') END AS box"


@query("H13_parse_box", f"SELECT event_id, CASE WHEN event_id % 5 > 2 THEN box::JSON::DOUBLE[] END AS box, CASE event_id % 5 WHEN 0 THEN 'not four numbers' WHEN 1 THEN 'not finite' WHEN 2 THEN 'not a list' END AS reason FROM (SELECT event_id, {TEXT} FROM events)")
def h13(spark, sf):
    box, reason = ps.parse_box("box")
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", TEXT).select("event_id", box.alias("box"), reason.alias("reason"))


@query("H14_parse_values", """SELECT event_id, event_id % 3 < 2 AS flag, CASE WHEN event_id % 4 = 0 THEN event_id % 7 ELSE event_id % 5 END::DOUBLE AS first, CASE WHEN event_id % 5 > 0 THEN event_id % 5 / (event_id % 5 + 1)::DOUBLE END AS share FROM events""")
def h14(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'yes' ELSE 'no' END AS word", "CASE WHEN event_id % 4 = 0 THEN ' ' ELSE CAST(event_id % 5 AS STRING) END AS x", "CAST(event_id % 7 AS STRING) AS y", "CASE WHEN event_id % 5 = 0 THEN -1D ELSE 1D END AS a", "CAST(event_id % 5 AS DOUBLE) AS b")
    return rows.select("event_id", ps.parse_bool("word").alias("flag"), ps.first_float("x", "y").alias("first"), ps.normalise_pair("a", "b").alias("share"))


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).select("path", array_to_vector("v").alias("features"), "kind", "grade", F.lit(1.0).alias("kind_weight"), F.lit(1.0).alias("grade_weight"), (F.col("group_id") % 5).alias("fold"))


@query("L03_oof_predict")
def l03(spark, sf):
    return ft.oof_predict(training_rows(spark, sf), 5, LogisticRegression(maxIter=20, regParam=0.01)).select("path", "fold", "kind", "grade", "k1", "g0", "g1")


@query("L01_fit_hierarchical")
def l01(spark, sf):
    rows = training_rows(spark, sf)
    return ft.score_hierarchical(ft.fit_hierarchical(rows.filter(TRAIN), LogisticRegression(maxIter=20, regParam=0.01)), rows).select("path", "kind", "grade", "k1", "g0", "g1")


@query("L02_fit_direct")
def l02(spark, sf):
    rows = training_rows(spark, sf).withColumns({"class_id": F.expr("kind * 2 + grade"), "weight": F.lit(1.0)})
    model = ft.fit_direct(rows.filter(TRAIN), LogisticRegression(maxIter=20, regParam=0.01))
    return model.transform(rows).select("path", "class_id", vector_to_array("probability").alias("p"))


@query("L04_grid_select")
def l04(spark, sf):
    rows = training_rows(spark, sf).withColumn("fold", F.col("fold") % 3)
    grid = [(f"reg {r}", LogisticRegression(maxIter=10, regParam=r)) for r in (0.01, 1.0)]
    return ft.grid_select(rows, grid, 3)[2]


@query("L05_pca_whiten")
def l05(spark, sf):
    rows = features(spark, sf).select("path", "v")
    return ft.pca_whiten(rows.filter(TRAIN), rows, "v", 8)
