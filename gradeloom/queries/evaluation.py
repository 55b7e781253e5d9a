"""Queries over predictions of two models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.probability import JOINT, joint, log_spaced
from gradeloom.operators import evaluation as ev
from gradeloom.plans.catalog import query
from gradeloom.plans.fixtures import view, with_views

GRID = log_spaced(0.05, 10.0, 25)
BIASES = [round(-2 + 0.25 * i, 2) for i in range(17)]


def predictions(spark: SparkSession, sf: str, which: str = "predictions") -> DataFrame:
    return joint(view(spark, sf, which))


def judged(name: str, table: str) -> str:
    """The SQL of the joint probabilities and of all that is read off them."""
    return f"""{name}_j AS (SELECT path, group_id, class_id, k1, g0, g1, (1 - k1) * (1 - g0) AS j0, (1 - k1) * g0 AS j1, k1 * (1 - g1) AS j2, k1 * g1 AS j3 FROM {table}), {verdict(name, name + '_j')}"""


def verdict(name: str, table: str) -> str:
    return f"""{name} AS (SELECT *, (pred = class_id)::INT AS hit, (kind = class_id // 2)::INT AS kind_right, (CASE WHEN class_id < 2 THEN (j1 > j0)::INT ELSE (j3 > j2)::INT END = class_id % 2)::INT AS grade_right,
 -ln(greatest(CASE class_id WHEN 0 THEN j0 WHEN 1 THEN j1 WHEN 2 THEN j2 ELSE j3 END, 1e-15)) AS nll, least(floor(conf * 15), 14)::INT AS bin FROM
 (SELECT *, greatest(j0, j1, j2, j3) AS conf, CASE WHEN j0 >= conf THEN 0 WHEN j1 >= conf THEN 1 WHEN j2 >= conf THEN 2 ELSE 3 END AS pred, CASE WHEN j2 + j3 > j0 + j1 THEN 1 ELSE 0 END AS kind FROM {table}))"""


def metrics(table: str, keys: str, lead: str = "") -> str:
    """The SQL of all metrics by ``keys``."""
    f1 = " + ".join(f"2.0::DOUBLE * count(*) FILTER (class_id = {c} AND pred = {c}) / greatest(count(*) FILTER (class_id = {c}) + count(*) FILTER (pred = {c}), 1)" for c in range(4))
    gap = " + ".join(f"abs(coalesce(sum(hit - conf) FILTER (bin = {b}), 0))" for b in range(15))
    return f"""SELECT {lead}m.samples, g.groups, m.kind_accuracy, m.grade_accuracy, m.accuracy, m.macro_f1, g.group_accuracy, g.group_minimum, m.nll, m.ece FROM
 (SELECT {keys}, count(*) AS samples, round(avg(kind_right), 6) AS kind_accuracy, round(avg(grade_right), 6) AS grade_accuracy, round(avg(hit), 6) AS accuracy, round(({f1}) / 4, 6) AS macro_f1, round(avg(nll), 6) AS nll, round(({gap}) / count(*), 6) AS ece FROM {table} GROUP BY {keys}) m
 JOIN (SELECT {keys}, count(*) AS groups, round(avg(a), 6) AS group_accuracy, round(min(a), 6) AS group_minimum FROM (SELECT {keys}, group_id AS _g, avg(hit) AS a FROM {table} GROUP BY {keys}, group_id) GROUP BY {keys}) g USING ({keys})"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


A = judged("a", "predictions")
B = judged("b", "predictions_b")


def sql(text: str) -> str:
    return with_views(f"WITH {A} {text}", "predictions")


def sql_both(text: str) -> str:
    return with_views(f"WITH {A}, {B} {text}", "predictions", "predictions_b")


CELLS = "cells AS (SELECT t.range AS truth, p.range AS predicted, (SELECT count(*) FROM a WHERE class_id = t.range AND pred = p.range) AS n FROM range(4) t, range(4) p)"


@query("D12_confusion", sql(f", {CELLS} SELECT * FROM cells"))
def d12(spark, sf):
    return ev.confusion(ev.judged(predictions(spark, sf)))


@query("D13_per_class_metrics", sql(f""", {CELLS}, s AS (SELECT class_id, sum(n) FILTER (truth = class_id) AS support, sum(n) FILTER (predicted = class_id) AS p, sum(n) FILTER (truth = class_id AND predicted = class_id) AS t FROM cells, (SELECT range AS class_id FROM range(4)) GROUP BY class_id),
 r AS (SELECT class_id, support, t / greatest(p, 1)::DOUBLE AS precision, t / greatest(support, 1)::DOUBLE AS recall FROM s) SELECT class_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / greatest(precision + recall, 1e-12), 6) AS f1, support::BIGINT AS support FROM r"""))
def d13(spark, sf):
    return rounded(ev.per_class_metrics(ev.confusion(ev.judged(predictions(spark, sf)))))


@query("D14_branch_metrics", sql(", o AS (SELECT *, 1 AS whole FROM a) " + metrics("o", "whole")))
def d14(spark, sf):
    return rounded(ev.branch_metrics(predictions(spark, sf), []))


@query("D15_ece", sql("SELECT bin, count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(conf), 6) AS confidence, round(abs(avg(hit) - avg(conf)), 6) AS gap FROM a GROUP BY bin"))
def d15(spark, sf):
    return rounded(ev.ece(predictions(spark, sf).withColumn("conf", F.greatest(*JOINT))))


@query("D16_metrics_by", sql(", o AS (SELECT *, path % 7 AS origin FROM a) " + metrics("o", "origin", "origin, ")))
def d16(spark, sf):
    return rounded(ev.branch_metrics(predictions(spark, sf).withColumn("origin", F.expr("path % 7")), ["origin"]))


BINARY = """s AS (SELECT {keys} sum(w) FILTER (t = 0 AND p = 0) AS c00, coalesce(sum(w) FILTER (t = 0 AND p = 1), 0) AS c01, coalesce(sum(w) FILTER (t = 1 AND p = 0), 0) AS c10, coalesce(sum(w) FILTER (t = 1 AND p = 1), 0) AS c11 FROM x {by})
 SELECT {keys} round((coalesce(c00, 0) + c11) / greatest(coalesce(c00, 0) + c01 + c10 + c11, 1e-12), 6) AS accuracy, round((2 * coalesce(c00, 0) / greatest(2 * coalesce(c00, 0) + c01 + c10, 1e-12) + 2 * c11 / greatest(2 * c11 + c01 + c10, 1e-12)) / 2, 6) AS macro_f1 FROM s"""


@query("D17_weighted_binary_metrics", sql(", x AS (SELECT class_id % 2 AS t, (g0 > 0.5)::INT AS p, (path % 5)::DOUBLE AS w FROM a), " + BINARY.format(keys="", by="")))
def d17(spark, sf):
    return rounded(ev.weighted_binary_metrics(predictions(spark, sf), [], F.expr("class_id % 2"), (F.col("g0") > 0.5).cast("int"), F.expr("cast(path % 5 as double)")))


@query("P01_mix_models", sql_both("""SELECT path, round((2 * a.j2 + b.j2 + 2 * a.j3 + b.j3) / 3, 6) AS k1, round((2 * a.j1 + b.j1) / greatest(2 * a.j0 + b.j0 + 2 * a.j1 + b.j1, 1e-15), 6) AS g0, round((2 * a.j3 + b.j3) / greatest(2 * a.j2 + b.j2 + 2 * a.j3 + b.j3, 1e-15), 6) AS g1 FROM a JOIN b USING (path)"""))
def p01(spark, sf):
    long = predictions(spark, sf).withColumn("model", F.lit("a")).unionByName(predictions(spark, sf, "predictions_b").withColumn("model", F.lit("b")))
    return rounded(ev.mix_models(long, {"a": 2.0, "b": 1.0}).select("path", "k1", "g0", "g1"))


MIXES = [("a", 1.0), ("b", 0.0), ("a:0.25+b:0.75", 0.25), ("a:0.5+b:0.5", 0.5), ("a:0.75+b:0.25", 0.75)]
MIXED = "m_j AS (SELECT mix, path, a.group_id, a.class_id, " + ", ".join(f"x * a.{j} + (1 - x) * b.{j} AS {j}" for j in JOINT) + " FROM a JOIN b USING (path), (VALUES " + ", ".join(f"('{n}', {x}::DOUBLE)" for n, x in MIXES) + ") v(mix, x))"


@query("P02_score_mixes", sql_both(f", {MIXED}, {verdict('m', 'm_j')} {metrics('m', 'mix', 'mix, ')}"))
def p02(spark, sf):
    name = lambda df, m: df.select("path", *[F.col(j).alias(f"{m}_{j}") for j in JOINT])
    wide = predictions(spark, sf).select("path", "group_id", "class_id", *[F.col(j).alias(f"a_{j}") for j in JOINT]).join(name(predictions(spark, sf, "predictions_b"), "b"), "path")
    return rounded(ev.score_mixes(wide, ["a", "b"], [0.25, 0.5, 0.75])).drop("place")


@query("P03_fit_temperature", sql(""", r AS (SELECT 'kind' AS branch, k1 AS p, class_id // 2 AS y FROM a UNION ALL SELECT 'grade' || class_id // 2, CASE WHEN class_id < 2 THEN g0 ELSE g1 END, class_id % 2 FROM a),
 t AS (SELECT unnest([""" + ", ".join(map(str, GRID)) + """])::DOUBLE AS temperature), q AS (SELECT branch, temperature, y, 1 / (1 + exp((ln(greatest(1 - p, 1e-15)) - ln(greatest(p, 1e-15))) / temperature)) AS p FROM r, t)
 SELECT branch, temperature, round(avg(-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-15))), 6) AS nll FROM q GROUP BY branch, temperature"""))
def p03(spark, sf):
    return ev.temperature_losses(predictions(spark, sf), GRID).withColumn("nll", F.round("nll", 6))


@query("P04_apply_temperature", sql("SELECT path, " + ", ".join(f"round(1 / (1 + exp((ln(greatest(1 - {c}, 1e-15)) - ln(greatest({c}, 1e-15))) / {t})), 6) AS {c}" for c, t in (("k1", 1.5), ("g0", 0.8), ("g1", 2.0))) + " FROM a"))
def p04(spark, sf):
    return rounded(ev.apply_temperature(predictions(spark, sf), 1.5, 0.8, 2.0).select("path", "k1", "g0", "g1"))


@query("P05_branch_hybrid", sql_both("SELECT path, a.group_id, a.class_id, a.k1, b.g0, a.g1 FROM a JOIN b USING (path)"))
def p05(spark, sf):
    a, b = predictions(spark, sf), predictions(spark, sf, "predictions_b")
    return ev.branch_hybrid(a, b, a)


@query("P06_sweep_bias", sql(""", x AS (SELECT bias, class_id % 2 AS t, (1 / (1 + exp(ln(greatest(1 - g0, 1e-15)) - ln(greatest(g0, 1e-15)) - bias)) > 0.5)::INT AS p, (path % 5)::DOUBLE AS w FROM a, (SELECT unnest([""" + ", ".join(map(str, BIASES)) + "])::DOUBLE AS bias)), " + BINARY.format(keys="bias,", by="GROUP BY bias")))
def p06(spark, sf):
    return rounded(ev.sweep_bias(predictions(spark, sf), BIASES, "g0", F.expr("class_id % 2"), F.expr("cast(path % 5 as double)"))).drop("place")


@query("P07_group_bootstrap", sql_both(""", c AS (SELECT a.group_id, count(*) AS n, sum(a.hit - b.hit) AS d FROM a JOIN b USING (path) GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY group_id) - 1 AS place FROM c), s AS (SELECT count(*) AS s FROM c),
 w AS (SELECT range // s AS repeat, ('0x' || substr(md5('3089:' || range), 1, 8))::BIGINT % s AS place FROM range(5000 * (SELECT s FROM s)), s), o AS (SELECT repeat, sum(d)::DOUBLE / sum(n) AS x FROM w JOIN k USING (place) GROUP BY repeat)
 SELECT (SELECT round(sum(d)::DOUBLE / sum(n), 6) FROM c) AS difference, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, round(least(1, 2 * least(avg((x <= 0)::INT), avg((x >= 0)::INT))), 6) AS tail FROM o"""))
def p07(spark, sf):
    both = ev.prediction_table(predictions(spark, sf), predictions(spark, sf, "predictions_b")).join(view(spark, sf, "predictions").select("path", "group_id"), "path")
    return rounded(ev.group_bootstrap(both, F.col("right_a"), F.col("right_b"), 5000, 3089))


@query("P08_mcnemar", sql_both(""", c AS (SELECT count(*) FILTER (a.hit = 1 AND b.hit = 1) AS both, count(*) FILTER (a.hit = 1 AND b.hit = 0) AS only_a, count(*) FILTER (a.hit = 0 AND b.hit = 1) AS only_b, count(*) FILTER (a.hit = 0 AND b.hit = 0) AS neither FROM a JOIN b USING (path))
 SELECT *, (SELECT round(least(1, 2 * sum(exp(lgamma(only_a + only_b + 1) - CASE WHEN range = 0 THEN 0 ELSE lgamma(range + 1) END - lgamma(only_a + only_b - range + 1) - (only_a + only_b) * ln(2)))), 6) FROM range((SELECT least(only_a, only_b) + 1 FROM c))) AS p FROM c"""))
def p08(spark, sf):
    return rounded(ev.mcnemar(ev.prediction_table(predictions(spark, sf), predictions(spark, sf, "predictions_b")), F.col("right_a"), F.col("right_b")))


@query("P09_prediction_table", sql_both("SELECT path, a.class_id, a.pred AS pred_a, b.pred AS pred_b, round(a.conf, 6) AS conf_a, round(b.conf, 6) AS conf_b, a.hit = 1 AS right_a, b.hit = 1 AS right_b, a.pred <> b.pred AS changed FROM a JOIN b USING (path)"))
def p09(spark, sf):
    return rounded(ev.prediction_table(predictions(spark, sf), predictions(spark, sf, "predictions_b")))


@query("P10_ordered_probability", sql("SELECT path, [round(j0, 6), round(j1, 6), round(j2, 6), round(j3, 6)] AS ordered FROM a"))
def p10(spark, sf):
    rows = predictions(spark, sf).select("path", F.array(*[F.lit(c) for c in (3, 1, 0, 2)]).alias("classes"), F.array("j3", "j1", "j0", "j2").alias("p"))
    return ev.ordered_probability(rows, "classes", "p", [0, 1, 2, 3]).select("path", F.transform("ordered", lambda v: F.round(v, 6)).alias("ordered"))
