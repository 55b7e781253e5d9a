"""Queries of checks that list what is wrong, over manifests with faults put in, and of what they guard."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import boxes as bx
from gradeloom.operators import datasets as ds
from gradeloom.operators import evaluation as ev
from gradeloom.operators import fitting as ft
from gradeloom.operators import labels as lb
from gradeloom.operators import records as rc
from gradeloom.operators import vectors as vc
from gradeloom.plans.catalog import query
from gradeloom.plans.fixtures import view, with_views
from gradeloom.queries.boxes import PAIRS, boxes, shifted
from gradeloom.queries.boxes import sql as boxes_sql
from gradeloom.queries.evaluation import predictions, rounded
from gradeloom.queries.governance import FOLDS, SESSIONS, grouped
from gradeloom.queries.labels import audit
from gradeloom.queries.labels import sql as audit_sql
from gradeloom.queries.records import features, rounded_list
from gradeloom.queries.references import training_rows

#: Pairs of up to four rows, and a role that most rows have from their split, some from nowhere.
PAIRED = [
    "CASE WHEN path % 10 < 6 THEN path - path % 4 END AS pair_id",
    "CASE WHEN path % 13 = 0 THEN 'training' WHEN path % 29 = 0 THEN NULL WHEN split = 'train' THEN 'training' WHEN split = 'val' THEN 'model_selection' ELSE 'strict_test' END AS role",
]
FITS = "coalesce((role = 'training' AND split = 'train') OR (role = 'model_selection' AND split = 'val') OR (role = 'strict_test' AND split = 'test'), false)"


@query("D07_all_integrity_checks", with_views(f"""WITH p AS (SELECT *, {', '.join(PAIRED)} FROM manifest) SELECT 'repeated_path' AS "check", CAST(path AS VARCHAR) AS key, count(*) AS n FROM p GROUP BY path HAVING count(*) > 1
 UNION ALL SELECT 'repeated_content', sha256(text), count(*) FROM p GROUP BY sha256(text) HAVING count(*) > 1
 UNION ALL SELECT 'mixed_labels', group_id, count(DISTINCT class_id) FROM p GROUP BY group_id HAVING count(DISTINCT class_id) > 1
 UNION ALL SELECT 'crowded_pair', CAST(pair_id AS VARCHAR), count(*) FROM p WHERE pair_id IS NOT NULL GROUP BY pair_id HAVING count(*) > 2
 UNION ALL SELECT 'forbidden_split', CAST(path AS VARCHAR), count(*) FROM p WHERE NOT {FITS} GROUP BY path""", "manifest"))
def d07_all(spark, sf):
    rows = view(spark, sf, "manifest").selectExpr("*", *PAIRED)
    return ds.integrity_report(rows, "path", F.sha2("text", 256), "group_id", "class_id", "pair_id", 2, "role", "split", {"training": ["train"], "model_selection": ["val"], "strict_test": ["test"]})


PINNED = "id % 97 = 0"


@query("E02_pinned_holdout", with_views(f"WITH {SESSIONS}, h AS (SELECT batch_id, session, max({PINNED}) AS pinned, row_number() OVER (PARTITION BY batch_id ORDER BY session DESC) AS back FROM s GROUP BY 1, 2) SELECT id, CASE WHEN back <= 2 OR pinned THEN 'holdout' ELSE 'train' END AS pool FROM s JOIN h USING (batch_id, session)", "inspection_log"))
def e02_pinned(spark, sf):
    rows = ds.sessionize(view(spark, sf, "inspection_log"), "batch_id", "ts", "id", 7200)
    return ds.holdout_latest(rows, "batch_id", 2, F.expr(PINNED)).select("id", "pool")


@query("E03_scene_split", with_views("""WITH s AS (SELECT class_id, source_id, count(*) AS rows FROM manifest WHERE source_id IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, count(*) OVER (PARTITION BY class_id) AS n, row_number() OVER (PARTITION BY class_id ORDER BY md5('7:' || source_id) DESC, source_id DESC) AS back FROM s)
 SELECT class_id, source_id, rows, CASE WHEN back = 1 THEN 'test' WHEN back = 2 AND n >= 4 THEN 'val' ELSE 'train' END AS split FROM p""", "manifest"))
def e03_scenes(spark, sf):
    return ds.scene_split(view(spark, sf, "manifest"), "class_id", "source_id", 7)


SPLIT = """g AS (SELECT class_id, source_id || ':' || class_id AS grp, count(*) AS rows FROM manifest GROUP BY 1, 2), p AS (SELECT *, count(*) OVER (PARTITION BY class_id) AS n, row_number() OVER (PARTITION BY class_id ORDER BY md5('7:' || grp), grp) AS place FROM g),
 q AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE greatest(1, round_even(n * 0.1::DOUBLE, 0)::INT) END AS nt, CASE WHEN n < 3 THEN 0 ELSE greatest(1, round_even(n * 0.2::DOUBLE, 0)::INT) END AS nv0 FROM p),
 sp AS (SELECT grp, CASE WHEN place <= nt THEN 'test' WHEN place <= nt + least(nv0, n - 1 - nt) THEN 'val' ELSE 'train' END AS split FROM q)"""


@query("E03_split_violations", with_views(f"""WITH {SPLIT}, m AS (SELECT sp.split, sp.grp, source_id, sha256(text) AS content FROM manifest JOIN sp ON sp.grp = source_id || ':' || class_id),
 l AS (SELECT split, 'grp' AS key, grp AS value FROM m UNION ALL SELECT split, 'source_id', source_id FROM m UNION ALL SELECT split, 'content', content FROM m)
 SELECT key, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM l WHERE value IS NOT NULL AND value <> '' GROUP BY key, value HAVING count(DISTINCT split) > 1""", "manifest"))
def e03_violations(spark, sf):
    rows = grouped(spark, sf).drop("split").withColumn("content", F.sha2("text", 256))
    return ds.split_violations(rows, ds.stratified_group_split(rows, "grp", "class_id", 0.2, 0.1, 7), "grp", ["grp", "source_id", "content"])


@query("E05_fold_classes", with_views(f"WITH {FOLDS} SELECT CAST(fold AS INT) AS fold, m.class_id, count(*) AS rows, count(DISTINCT m.source_id || ':' || m.class_id) AS groups FROM manifest m JOIN f ON f.grp = m.source_id || ':' || m.class_id GROUP BY 1, 2", "manifest"))
def e05_classes(spark, sf):
    rows = grouped(spark, sf)
    return ds.fold_classes(rows, ds.group_kfold(rows, "grp", "class_id", 5, 9), "grp", "class_id")


#: Folds with faults: one source lies in two folds, one has none, fold 3 is empty and a seventh is named.
FAULTY = ["CASE WHEN fold = 3 THEN 2 WHEN source_id LIKE '%7' THEN 7 ELSE fold END AS fold"]


@query("E05_fold_violations", with_views("""WITH m AS (SELECT *, class_id % 2 || ':' || source_id AS grp, path - path % 3 AS pair_id, class_id + 1 AS fold FROM manifest WHERE source_id IS NOT NULL), f AS (SELECT DISTINCT grp, CASE WHEN fold = 3 THEN 2 WHEN source_id LIKE '%7' THEN 7 ELSE fold END AS fold FROM m WHERE source_id NOT LIKE '%5'),
 j AS (SELECT m.grp, m.pair_id, f.fold FROM m LEFT JOIN f USING (grp)) SELECT 'group_in_folds' AS "check", grp AS key, count(DISTINCT fold) AS n FROM j GROUP BY grp HAVING count(DISTINCT fold) > 1
 UNION ALL SELECT 'pair_in_folds', CAST(pair_id AS VARCHAR), count(DISTINCT fold) FROM j GROUP BY pair_id HAVING count(DISTINCT fold) > 1
 UNION ALL SELECT 'no_fold', grp, count(*) FROM j WHERE fold IS NULL GROUP BY grp UNION ALL SELECT 'unknown_fold', CAST(fold AS VARCHAR), count(*) FROM j WHERE fold NOT BETWEEN 0 AND 4 GROUP BY fold
 UNION ALL SELECT 'absent_fold', CAST(range AS VARCHAR), 0 FROM range(5) WHERE range NOT IN (SELECT fold FROM j WHERE fold IS NOT NULL)""", "manifest"))
def e05_violations(spark, sf):
    rows = view(spark, sf, "manifest").filter("source_id IS NOT NULL").selectExpr("*", "concat(CAST(class_id % 2 AS STRING), ':', source_id) AS grp", "path - path % 3 AS pair_id", "class_id + 1 AS fold")
    folds = rows.filter("source_id NOT LIKE '%5'").selectExpr("grp", *FAULTY).distinct()
    return ds.fold_violations(rows.drop("fold"), folds, "grp", "pair_id", 5).withColumn("n", F.col("n").cast("long"))


#: Views of pairs with weights, targets and faults: pairs without or with two canonical rows, views of another class, rows that are not eligible.
INSTANCES = [
    "path - path % 2 AS pair_id", "group_id", "CASE WHEN path % 2 = 1 AND path % 23 <> 1 THEN class_id - 1 ELSE class_id END AS class_id",
    "CASE WHEN path % 31 = 0 THEN 'detector_aligned' WHEN path % 2 = 0 OR path % 37 = 1 THEN 'canonical' ELSE 'detector_aligned' END AS view_type",
    "CASE (path - path % 2) % 10 WHEN 8 THEN 'strict_test' WHEN 6 THEN 'model_selection' ELSE 'training' END AS selection_role",
    "path % 41 <> 0 AS eligible", "CASE WHEN path % 5 = 0 THEN NULL ELSE CAST(path % 11 AS DOUBLE) / 10 END AS grade_target", "CAST(path % 3 AS DOUBLE) / 2 AS kind_weight", "CASE WHEN path % 6 = 0 THEN NULL ELSE CAST(path % 4 AS DOUBLE) / 4 END AS grade_weight",
    "CASE WHEN path % 3 = 0 THEN 'hard_label_retained' WHEN path % 3 = 1 THEN 'soft_label' END AS status",
]
BAD = """i AS (SELECT * FROM v WHERE selection_role IN ('training', 'model_selection')), c AS (SELECT selection_role, pair_id, count(*) FILTER (view_type = 'canonical') AS c, count(DISTINCT class_id) AS k, count(*) FILTER (selection_role = 'training' AND NOT eligible) AS e FROM i GROUP BY 1, 2),
 bad AS (SELECT pair_id, NULL::VARCHAR AS group_id, 'no canonical row' AS reason FROM c WHERE c = 0 UNION ALL SELECT pair_id, NULL, 'several canonical rows' FROM c WHERE c > 1 UNION ALL SELECT pair_id, NULL, 'views disagree' FROM c WHERE k > 1 UNION ALL SELECT pair_id, NULL, 'not eligible' FROM c WHERE e > 0)"""


def instances(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "manifest").selectExpr(*INSTANCES)


@query("I12_instance_violations", with_views(f"WITH v AS (SELECT {', '.join(INSTANCES)} FROM manifest), {BAD} SELECT * FROM bad UNION ALL SELECT NULL, group_id, 'group in both roles' FROM i WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(DISTINCT selection_role) > 1", "manifest"))
def i12_violations(spark, sf):
    return lb.instance_violations(instances(spark, sf))


@query("I12_role_instances", with_views(f"""WITH v AS (SELECT {', '.join(INSTANCES)} FROM manifest), {BAD}, g AS (SELECT selection_role, pair_id, string_agg(view_type, ',' ORDER BY view_type) AS views, count(*) AS n_views FROM i WHERE pair_id NOT IN (SELECT pair_id FROM bad) GROUP BY 1, 2), t AS (SELECT *, selection_role = 'training' AS tr FROM i WHERE view_type = 'canonical')
 SELECT g.pair_id, g.selection_role, t.class_id, t.group_id, views, n_views, (class_id // 2)::DOUBLE AS kind_target, CASE WHEN tr AND grade_target IS NOT NULL THEN grade_target ELSE (class_id % 2)::DOUBLE END AS grade_target,
 CASE WHEN tr AND kind_weight > 0 THEN kind_weight ELSE 1 END::DOUBLE AS kind_weight, CASE WHEN tr THEN coalesce(grade_weight, 0) ELSE 1 END::DOUBLE AS grade_weight, NOT tr OR (coalesce(grade_weight, 0) > 0 AND coalesce(status = 'hard_label_retained', false)) AS consistent FROM g JOIN t USING (selection_role, pair_id)""", "manifest"))
def i12_instances(spark, sf):
    return lb.role_instances(instances(spark, sf))


@query("A04_feature_violations", with_views("""SELECT path, CASE WHEN path % 17 = 0 THEN 'other label' WHEN path % 19 = 0 THEN 'other group_id' WHEN path % 13 = 0 THEN 'not finite' ELSE 'zero' END AS reason FROM features WHERE path % 17 = 0 OR path % 19 = 0 OR path % 13 = 0 OR path % 23 = 0""", "features"))
def a04_violations(spark, sf):
    rows = features(spark, sf).select("path", "label", "group_id", "v")
    bad = F.when(F.col("path") % 13 == 0, F.transform("v", lambda x: x * float("inf"))).when(F.col("path") % 23 == 0, F.transform("v", lambda x: x * 0.0)).otherwise(F.col("v"))
    given = rows.select("path", F.expr("CASE WHEN path % 17 = 0 THEN label + 1 ELSE label END AS label"), F.expr("CASE WHEN path % 19 = 0 THEN NULL ELSE group_id END AS group_id"), bad.alias("v"))
    return vc.aligned(rows, given, "v", 64, ("label", "group_id"))


@query("C16_source_overlap", with_views("SELECT o.split AS scope, n.source_id AS value, n.n FROM (SELECT source_id, count(*) AS n FROM manifest WHERE path % 20 = 0 AND source_id <> '' GROUP BY 1) n JOIN (SELECT DISTINCT split, source_id FROM manifest) o USING (source_id)", "manifest"))
def c16_sources(spark, sf):
    rows = view(spark, sf, "manifest")
    return rc.source_overlap(rows.filter("path % 20 = 0").select("source_id"), rows.select("source_id", F.col("split").alias("scope")), "source_id", "scope")


@query("B14_resolution_reason", boxes_sql("SELECT image, box, CASE WHEN greatest(x2 - x1, y2 - y1) * 2 < 112 THEN 'below 112 pixels' WHEN greatest(x2 - x1, y2 - y1) * 2 < 160 THEN 'below 160 pixels' END AS reason FROM boxes"))
def b14_reason(spark, sf):
    return boxes(spark, sf).select("image", "box", bx.resolution_reason(F.greatest(bx.wide(), bx.high()) * 2).alias("reason"))


@query("D11_coverage_with_total", boxes_sql(f"WITH {PAIRS}, h AS (SELECT DISTINCT image, a FROM p WHERE iou >= 0.3 AND b IN (SELECT box FROM boxes WHERE confidence >= 0.5)) SELECT x.image, count(*) AS truth, count(h.a) AS matched, count(h.a)::DOUBLE / count(*) AS share FROM boxes x LEFT JOIN h ON x.image = h.image AND x.box = h.a GROUP BY GROUPING SETS ((x.image), ())"))
def d11_total(spark, sf):
    return bx.coverage_with_total(shifted(spark, sf).filter("confidence >= 0.5"), boxes(spark, sf))


TIER = "CASE path % 3 WHEN 0 THEN 0.35 WHEN 1 THEN 0.6 ELSE 1.0 END"


@query("D19_audit_counts", audit_sql(f""", x AS (SELECT *, CAST({TIER} AS DOUBLE) AS tier FROM audit), y AS (SELECT 'status' AS part, status AS value, * FROM x UNION ALL SELECT 'priority', CAST(priority AS VARCHAR), * FROM x UNION ALL SELECT 'tier', CAST(tier AS VARCHAR), * FROM x UNION ALL SELECT 'all', 'all', * FROM x)
 SELECT part, value, count(*) AS n, round(avg(kind_agreement), 6) AS kind_agreement, round(avg(grade_agreement), 6) AS grade_agreement, sum(kind_weight) AS kind_mass, sum(grade_weight) AS grade_mass FROM y GROUP BY part, value"""))
def d19_counts(spark, sf):
    return rounded(lb.audit_counts(audit(spark, sf).withColumn("tier", F.expr(f"CAST({TIER} AS DOUBLE)"))))


@query("D24_fuse_with_factors", with_views("WITH x AS (SELECT path, generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding)::DOUBLE AS x FROM features), n AS (SELECT path, sqrt(sum(x * x)) AS n FROM x GROUP BY path) SELECT path, list_concat(list(round(x / n * 0.25, 5) + 0.0 ORDER BY place), list(round(x / n * 2, 5) + 0.0 ORDER BY place)) AS v FROM x JOIN n USING (path) GROUP BY path", "features"))
def d24_factors(spark, sf):
    return features(spark, sf).select("path", rounded_list(vc.fuse_families(["v", "v"], [0.25, 2.0])).alias("v"))


JOINT = "[(1 - k1) * (1 - g0), (1 - k1) * g0, k1 * (1 - g1), k1 * g1]"


@query("I11_realigned", with_views(f"""WITH j AS (SELECT path, {JOINT} AS p FROM predictions), m AS (SELECT [avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4])] AS m FROM j), r AS (SELECT path, list_transform(p, lambda x, i: x * 0.25 / m[i]) AS p FROM j, m)
 SELECT path, list_transform(p, lambda x: round(x / list_sum(p), 5) + 0.0) AS p FROM r""", "predictions"))
def i11_realigned(spark, sf):
    rows = predictions(spark, sf).select("path", F.expr(JOINT.replace("[", "array(").replace("]", ")")).alias("p"))
    return lb.realigned(rows, "p", 4).select("path", rounded_list("p").alias("p"))


@query("W06_inverse_frequency_sample", with_views("""WITH r AS (SELECT path, class_id, row_number() OVER (PARTITION BY class_id ORDER BY md5('5:' || path), path) AS row FROM manifest), s AS (SELECT class_id, count(*) AS rows, row_number() OVER (ORDER BY class_id) - 1 AS rank FROM manifest GROUP BY 1),
 d AS (SELECT range AS draw, ('0x' || substr(md5('5:class:' || range), 1, 15))::BIGINT % (SELECT count(*) FROM s) AS rank, ('0x' || substr(md5('5:row:' || range), 1, 15))::BIGINT AS cr FROM range((SELECT count(*) FROM manifest)))
 SELECT draw, path, s.class_id FROM d JOIN s USING (rank) JOIN r ON r.class_id = s.class_id AND r.row = d.cr % s.rows + 1""", "manifest"))
def w06_inverse(spark, sf):
    rows = view(spark, sf, "manifest")
    return lb.inverse_frequency_sample(rows, "class_id", rows.count(), 5)


@query("P03_best_temperature")
def p03_best(spark, sf):
    found = ev.fit_temperature(predictions(spark, sf))
    return spark.createDataFrame(sorted((k, float(v)) for k, v in found.items()), "branch string, temperature double")


@query("L04_grid_over_seeds")
def l04_seeds(spark, sf):
    rows = training_rows(spark, sf).withColumn("group_id", F.col("path") % 25)
    grid = [(f"reg {r}", LogisticRegression(maxIter=10, regParam=r)) for r in (0.01, 1.0)]
    return ft.grid_over_seeds(rows, grid, 2, "group_id", [1, 2])[1]
