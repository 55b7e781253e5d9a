"""Queries over label audits, pairs of views and sample weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.probability import JOINT
from gradeloom.operators import labels as lb
from gradeloom.operators.datasets import pair_mass
from gradeloom.operators.evaluation import judged as judge
from gradeloom.plans.catalog import query
from gradeloom.plans.fixtures import view, with_views
from gradeloom.operators.references import group_excluded_knn
from gradeloom.plans.durable import written
from gradeloom.queries.evaluation import predictions, rounded, sql_both
from gradeloom.queries.records import knn_sql

#: Three models with five views each, from two hashes of the document number; views move little.
PROBABILITY = "(((path * 2654435761 + {c} + m * 101) % 9973 + 1) / CAST(9975 AS DOUBLE) * 9 + ((path * 40503 + {c} + v * 13) % 997) / CAST(997 AS DOUBLE)) / 10"
LONG = "SELECT path, m AS model, v AS view, " + ", ".join(f"{PROBABILITY.format(c=c)} AS {n}" for n, c in (("k1", 7), ("g0", 108), ("g1", 209)))


def oof(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "manifest").select("path", F.explode(F.array(*[F.lit(m) for m in (1, 2, 3)])).alias("m")).select("path", "m", F.explode(F.array(*[F.lit(v) for v in range(5)])).alias("v"))
    return rows.selectExpr("path", "m AS model", "v AS view", *[f"{PROBABILITY.format(c=c)} AS {n}" for n, c in (("k1", 7), ("g0", 108), ("g1", 209))])


def vote_features(spark: SparkSession, sf: str) -> DataFrame:
    """The features of manifest rows, with kind and grade of their class."""
    rows = view(spark, sf, "features").select("path", "group_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rows.join(view(spark, sf, "manifest").selectExpr("path", "CAST(floor(class_id / 2) AS INT) AS kind", "CAST(class_id % 2 AS INT) AS grade").hint("merge"), "path")


#: ``knn``: the vote of the three nearest centroids of each grade, of the same kind and other groups.
KNN = knn_sql("(SELECT f.path, f.group_id, class_id // 2 AS kind, class_id % 2 AS grade, embedding FROM (SELECT vec_id AS path, vec_id % 25 AS group_id, embedding FROM embeddings) f JOIN manifest m ON m.path = f.path)")
OOF = f"""{KNN}, long AS ({LONG} FROM manifest, (SELECT unnest([1, 2, 3]) AS m), (SELECT unnest([0, 1, 2, 3, 4]) AS v)), r AS (SELECT l.*, class_id, CASE WHEN class_id < 2 THEN g0 ELSE g1 END AS g FROM long l JOIN manifest USING (path)),
 o AS (SELECT *, avg(k1) OVER (PARTITION BY path, model) AS mk, avg(g) OVER (PARTITION BY path, model) AS mg FROM r),
 ms AS (SELECT path, class_id, model, avg(k1) AS mk, avg(g) AS mg, avg(((k1 > 0.5) = (mk > 0.5) AND (g > 0.5) = (mg > 0.5))::INT) AS st FROM o GROUP BY ALL),
 u AS (SELECT path, class_id, avg(mk) AS p_kind, avg(mg) AS p_grade, min(st) AS stability, count(*) AS n, count(*) FILTER (mk > 0.5) AS k, count(*) FILTER (mg > 0.5) AS gg, min(((mk > 0.5)::INT <> class_id // 2)::INT) AS kind_opposite, min(((mg > 0.5)::INT <> class_id % 2)::INT) AS grade_opposite FROM ms GROUP BY path, class_id),
 s AS (SELECT path, class_id, p_kind, p_grade, stability, kind_opposite, grade_opposite, CASE WHEN p_kind > 0.5 THEN k ELSE n - k END / n::DOUBLE AS kind_agreement, CASE WHEN p_grade > 0.5 THEN gg ELSE n - gg END / n::DOUBLE AS grade_agreement, knn_grade, knn_margin FROM u LEFT JOIN knn USING (path)),
 w AS (SELECT *, CASE WHEN class_id >= 2 THEN p_kind ELSE 1 - p_kind END AS ok, CASE WHEN class_id % 2 = 1 THEN p_grade ELSE 1 - p_grade END AS og FROM s),
 z AS (SELECT *, CASE WHEN kind_opposite = 1 AND ok <= 1 - 0.8::DOUBLE AND stability >= 0.8 THEN 'kind_contradiction' WHEN grade_opposite = 1 AND 1 - og >= 0.8 AND stability >= 0.8 AND ok >= 0.9 AND kind_agreement = 1 AND knn_grade <> class_id % 2 AND knn_margin >= 0.005 THEN 'grade_contradiction'
 WHEN p_grade BETWEEN 0.4 AND 0.6 THEN 'ambiguous' WHEN (p_grade > 0.5)::INT <> class_id % 2 THEN 'grade_differs' ELSE 'agreed' END AS status FROM w),
 audit AS (SELECT *, CASE status WHEN 'kind_contradiction' THEN 1 WHEN 'grade_contradiction' THEN 1 WHEN 'ambiguous' THEN 3 WHEN 'grade_differs' THEN 2 ELSE 9 END AS priority, CASE WHEN status LIKE '%contradiction' THEN 0 ELSE 1 END::DOUBLE AS kind_weight, CASE WHEN status = 'agreed' THEN 1 ELSE 0 END::DOUBLE AS grade_weight FROM z)"""


def sql(text: str) -> str:
    return with_views(f"WITH {OOF} {text}", "manifest")


def summary(spark: SparkSession, sf: str) -> DataFrame:
    return lb.oof_summary(oof(spark, sf), view(spark, sf, "manifest"))


def audit(spark: SparkSession, sf: str) -> DataFrame:
    """The audit, with the vote of the neighbouring groups of the rows' features; rows without features have none."""
    votes = group_excluded_knn(vote_features(spark, sf), "v").select("path", "knn_grade", "knn_margin")
    return lb.audit_labels(summary(spark, sf).join(written(votes).hint("merge"), "path", "left"))


AUDITED = "path, class_id, status, priority, kind_weight, grade_weight"


@query("I01_oof_summary", sql("SELECT path, class_id, round(p_kind, 6) AS p_kind, round(p_grade, 6) AS p_grade, round(stability, 6) AS stability, kind_opposite, grade_opposite, round(kind_agreement, 6) AS kind_agreement, round(grade_agreement, 6) AS grade_agreement FROM s"))
def i01(spark, sf):
    return rounded(summary(spark, sf))


@query("I02_audit_labels", sql(f"SELECT {AUDITED} FROM audit"))
def i02(spark, sf):
    return audit(spark, sf).select(*AUDITED.split(", "))


FLIP = "p_grade BETWEEN 0.4 AND 0.6 AND (p_grade > 0.5)::INT <> class_id % 2"


@query("I03_relabel_ambiguous", sql(f"""SELECT path, class_id, CASE WHEN f THEN class_id - class_id % 2 + 1 - class_id % 2 ELSE class_id END AS new_class, CASE WHEN f THEN 0.65 WHEN {FLIP} THEN 0 WHEN (p_grade > 0.5)::INT <> class_id % 2 AND grade_agreement = 1 THEN 0.3 ELSE 1 END::DOUBLE AS new_weight
 FROM (SELECT *, {FLIP} AND grade_agreement = 1 AND stability >= 0.75 AND greatest(p_kind, 1 - p_kind) >= 0.6 AS f FROM s)"""))
def i03(spark, sf):
    return lb.relabel_ambiguous(summary(spark, sf)).select("path", "class_id", "new_class", "new_weight")


VIEWS = "vw AS (SELECT path, path AS pair_id, class_id, group_id, split, 'canonical' AS view_type, 1.0 AS weight, source_id FROM manifest UNION ALL SELECT -path - 1, CASE WHEN path % 30 = 0 THEN path - 1000000000 ELSE path END, (class_id + (path % 15 = 0)::INT) % 4, group_id, split, CASE WHEN path % 33 = 0 THEN 'other' ELSE 'detector_aligned' END, 1.0, CASE WHEN path % 21 = 0 THEN 'elsewhere' ELSE source_id END FROM manifest WHERE path % 3 = 0)"


def second_views(spark: SparkSession, sf: str) -> DataFrame:
    """A second view of every third row; some name no canonical row, some disagree in class."""
    return view(spark, sf, "manifest").filter("path % 3 = 0").selectExpr("-path - 1 AS path", "CASE WHEN path % 30 = 0 THEN path - 1000000000 ELSE path END AS pair_id", "(class_id + CAST(path % 15 = 0 AS INT)) % 4 AS class_id", "group_id", "split", "CASE WHEN path % 33 = 0 THEN 'other' ELSE 'detector_aligned' END AS view_type", "CAST(1 AS DOUBLE) AS weight", "CASE WHEN path % 21 = 0 THEN 'elsewhere' ELSE source_id END AS source_id")


def all_views(spark: SparkSession, sf: str) -> DataFrame:
    first = view(spark, sf, "manifest").selectExpr("path", "path AS pair_id", "class_id", "group_id", "split", "'canonical' AS view_type", "CAST(1 AS DOUBLE) AS weight", "source_id")
    return first.unionByName(second_views(spark, sf))


@query("I04_pseudo_relabel", sql(f""", {VIEWS} SELECT vw.path, pair_id, CASE WHEN f THEN vw.class_id - vw.class_id % 2 + 1 - vw.class_id % 2 ELSE vw.class_id END AS new_class, CASE WHEN f THEN 0.35 ELSE 1 END::DOUBLE AS weight,
 CASE WHEN f THEN CASE WHEN vw.class_id % 2 = 0 THEN 0.96 ELSE 0.04 END ELSE vw.class_id % 2 END::DOUBLE AS target FROM vw LEFT JOIN (SELECT path AS p, true AS f FROM audit WHERE status = 'grade_contradiction' AND 1 - og >= 0.82) ON p = pair_id"""))
def i04(spark, sf):
    return lb.pseudo_relabel(all_views(spark, sf), audit(spark, sf), 0.82, 0.35).select("path", "pair_id", "new_class", "weight", "target")


@query("I05_pseudo_targets", sql("""SELECT path, CASE WHEN c THEN round(p_grade, 6) ELSE class_id % 2 END::DOUBLE AS target, CASE WHEN c THEN 0.2 ELSE 1 END::DOUBLE AS weight, NOT c AS consistent, c AND (p_grade > 0.5)::INT = class_id % 2 AS violation
 FROM (SELECT *, status IN ('grade_contradiction', 'ambiguous') AS c FROM audit)"""))
def i05(spark, sf):
    out = lb.pseudo_targets(audit(spark, sf), F.col("status").isin("grade_contradiction", "ambiguous"))
    return out.select("path", F.round("target", 6).alias("target"), "weight", "consistent", "violation")


@query("I07_build_targets", with_views("""SELECT path, c // 2 * 2 + (t > 0.5)::INT AS class_id, round(t, 6) AS target, w AS weight, CASE WHEN d THEN path % 2 = 0 AND w > 0 ELSE w >= 0.999 END AS consistent
 FROM (SELECT path, d, CASE WHEN d THEN (class_id + 1) % 4 ELSE class_id END AS c, CASE WHEN d THEN path % 9 / 9.0::DOUBLE ELSE path % 5 / 5.0::DOUBLE END AS t, CASE WHEN d THEN path % 3 / 2.0::DOUBLE WHEN path % 4 = 0 THEN 1 ELSE path % 4 / 4.0::DOUBLE END AS w
 FROM (SELECT *, path % 7 = 0 AND split = 'train' AS d FROM manifest))""", "manifest"))
def i07(spark, sf):
    rows = view(spark, sf, "manifest").selectExpr("path", "split", "class_id", "CASE WHEN path % 4 = 0 THEN NULL ELSE path % 4 / 4D END AS weight", "path % 5 / 5D AS target")
    decisions = view(spark, sf, "manifest").filter("path % 7 = 0").selectExpr("path", "(class_id + 1) % 4 AS class_id", "path % 3 / 2D AS weight", "path % 9 / 9D AS target", "CASE WHEN path % 2 = 0 THEN 'agreed' ELSE 'ambiguous' END AS status")
    return lb.build_targets(rows, decisions, ["agreed"]).select("path", "class_id", F.round("target", 6).alias("target"), "weight", "consistent")


@query("D29_run_summary", sql("SELECT class_id, count(*) AS n, count(*) FILTER (priority <= 2) AS n_review, coalesce(list(path ORDER BY path) FILTER (priority <= 2), [])[1:20] AS review FROM audit GROUP BY class_id UNION ALL SELECT NULL, count(*), count(*) FILTER (priority <= 2), coalesce(list(path ORDER BY path) FILTER (priority <= 2), [])[1:20] FROM audit"))
def d29(spark, sf):
    return lb.run_summary(audit(spark, sf), "class_id", F.col("priority") <= 2)


@query("I06_restore_zero_weight", sql("SELECT path, CASE WHEN grade_weight = 0 THEN class_id % 2 ELSE round(p_grade, 6) END::DOUBLE AS target, grade_weight > 0 AS consistent FROM audit"))
def i06(spark, sf):
    rows = audit(spark, sf).withColumns({"target": F.round("p_grade", 6), "consistent": F.lit(True)})
    return lb.restore_zero_weight(rows).select("path", "target", "consistent")


@query("I08_initial_reliability", sql("SELECT path, (p_kind > 0.5)::INT = class_id // 2 AND (p_grade > 0.5)::INT = class_id % 2 AND stability >= 0.8 AND og >= 0.52 AS reliable FROM w"))
def i08(spark, sf):
    return lb.initial_reliability(summary(spark, sf)).select("path", "reliable")


@query("I09_training_safety", sql("""SELECT path, path % 10 <> 0 AS leak_safe, path % 5 <> 0 AND status <> 'kind_contradiction' AS trainable, CASE WHEN path % 5 = 0 OR status = 'kind_contradiction' THEN 0 WHEN status = 'agreed' THEN 0.5 ELSE 0.25 END::DOUBLE AS weight FROM audit"""))
def i09(spark, sf):
    matches = view(spark, sf, "manifest").filter("path % 5 = 0").selectExpr("path", "path % 10 = 0 AS exact")
    return lb.training_safety(audit(spark, sf), matches).select("path", "leak_safe", "trainable", "weight")


@query("I10_consensus_pseudo_labels", sql_both("SELECT path, a.pred, round(0.5 + 0.5 * greatest(0, least(1, (least(a.conf, b.conf) - 0.4::DOUBLE) / 0.6::DOUBLE)), 6) AS weight FROM a JOIN b USING (path) WHERE a.pred = b.pred AND least(a.conf, b.conf) >= 0.4"))
def i10(spark, sf):
    return rounded(lb.consensus_pseudo_labels(judge(predictions(spark, sf)), judge(predictions(spark, sf, "predictions_b")), 0.4))


@query("I11_soft_confidence_weight", sql_both(""", c AS (SELECT pred, avg(conf) AS c FROM a GROUP BY pred), t AS (SELECT (SELECT max(c) FROM c) AS best, avg(conf) AS mu, greatest(stddev_pop(conf), 0.06) AS sd FROM a)
 SELECT path, pred, round(CASE WHEN conf < 0.5 THEN 0 WHEN conf >= greatest(0.62, least(0.92, mu * c / best)) THEN 1 WHEN conf >= mu THEN 1 ELSE 0.22 * exp(-(conf - mu) * (conf - mu) / (2 * sd * sd)) END, 6)::DOUBLE AS weight FROM a JOIN c USING (pred), t"""))
def i11(spark, sf):
    return rounded(lb.soft_confidence_weight(judge(predictions(spark, sf)).select("path", "pred", "conf")).select("path", "pred", "weight"))


@query("I12_paired_instances", with_views(f"WITH {VIEWS} SELECT pair_id, max(class_id) FILTER (view_type = 'canonical') AS class_id, string_agg(view_type, ',' ORDER BY view_type) AS views FROM vw GROUP BY pair_id", "manifest"))
def i12(spark, sf):
    return lb.paired_instances(all_views(spark, sf))


@query("C01_merge_views", with_views(f"""WITH {VIEWS} SELECT v.path, v.pair_id, coalesce(m.class_id, v.class_id) AS class_id, coalesce(m.group_id, v.group_id) AS group_id, view_type, CASE WHEN view_type = 'canonical' THEN 'canonical' WHEN m.class_id IS NULL THEN 'review_only' ELSE 'matched_view' END AS role
 FROM vw v LEFT JOIN manifest m ON m.path = v.pair_id""", "manifest"))
def c01(spark, sf):
    return lb.merge_views(view(spark, sf, "manifest"), second_views(spark, sf))


@query("C02_ownership_conflicts", with_views(f"""WITH {VIEWS} SELECT DISTINCT pair_id, CASE WHEN m.split IS NULL THEN 'no canonical row' ELSE 'split, group or class differs' END AS reason FROM vw v LEFT JOIN manifest m ON m.path = v.pair_id
 WHERE view_type <> 'canonical' AND (m.split IS NULL OR m.split IS DISTINCT FROM v.split OR m.group_id IS DISTINCT FROM v.group_id OR m.class_id IS DISTINCT FROM v.class_id)""", "manifest"))
def c02(spark, sf):
    return lb.ownership_conflicts(view(spark, sf, "manifest"), second_views(spark, sf))


@query("C12_apply_decisions", with_views("""SELECT path, CASE WHEN d THEN 3 - class_id ELSE class_id END AS class_id, CASE WHEN d THEN 0.25 ELSE 1 END::DOUBLE AS weight, d AS decided FROM (SELECT *, path % 4 = 0 AND path % 8 <> 0 AND split = 'train' AS d FROM manifest)""", "manifest"))
def c12(spark, sf):
    rows = view(spark, sf, "manifest")
    once = rows.filter("path % 4 = 0").selectExpr("path", "3 - class_id AS class_id", "CAST(0.25 AS DOUBLE) AS weight")
    decisions = once.unionByName(once.filter("path % 8 = 0"))
    return lb.apply_decisions(rows.withColumn("weight", F.lit(None).cast("double")), decisions).select("path", "class_id", "weight", "decided")


@query("C15_propagate_canonical", with_views(f"WITH {VIEWS} SELECT v.path, v.pair_id, m.class_id FROM vw v LEFT JOIN manifest m ON m.path = v.pair_id", "manifest"))
def c15(spark, sf):
    return lb.propagate_canonical(all_views(spark, sf), ["class_id"]).select("path", "pair_id", "class_id")


@query("C15_canonical_violations", with_views(f"""WITH {VIEWS}, o AS (SELECT pair_id, class_id FROM vw WHERE view_type = 'canonical') SELECT vw.pair_id, CASE WHEN count(o.pair_id) = 0 THEN 'not one canonical row' WHEN count(*) FILTER (vw.class_id <> o.class_id) > 0 THEN 'classes differ' ELSE 'unknown view type' END AS reason FROM vw LEFT JOIN o USING (pair_id) GROUP BY vw.pair_id
 HAVING count(o.pair_id) = 0 OR count(*) FILTER (vw.class_id <> o.class_id) > 0 OR count(*) FILTER (view_type = 'other') > 0""", "manifest"))
def c15_violations(spark, sf):
    return lb.canonical_violations(all_views(spark, sf))


@query("D09_pair_consistency", with_views(f"""WITH {VIEWS}, m AS (SELECT *, CASE WHEN path % 28 = 0 THEN 0.4 ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY pair_id) END AS mass FROM vw)
 SELECT pair_id, count(DISTINCT class_id) AS labels, count(DISTINCT group_id) AS groups, count(DISTINCT source_id) AS sources, round(sum(mass), 6) AS mass, string_agg(view_type, ',' ORDER BY view_type) AS views FROM m GROUP BY pair_id
 HAVING labels <> 1 OR groups <> 1 OR sources <> 1 OR abs(sum(mass) - 1) > 1e-12 OR views NOT IN ('canonical', 'canonical,detector_aligned')""", "manifest"))
def d09(spark, sf):
    rows = pair_mass(all_views(spark, sf), "pair_id").withColumn("mass", F.expr("CASE WHEN path % 28 = 0 THEN CAST(0.4 AS DOUBLE) ELSE mass END"))
    return lb.pair_consistency(rows)


@query("D18_supervision_mass", sql("SELECT class_id, count(*) AS pairs, count(*) FILTER (grade_weight >= 0.999) AS consistent, sum(grade_weight) AS mass FROM audit GROUP BY class_id"))
def d18(spark, sf):
    return lb.supervision_mass(audit(spark, sf))


@query("D19_audit_summary", sql("SELECT status, priority, count(*) AS n, round(avg(grade_agreement), 6) AS agreement, sum(kind_weight) AS kind_mass, sum(grade_weight) AS grade_mass FROM audit GROUP BY status, priority"))
def d19(spark, sf):
    return rounded(lb.audit_summary(audit(spark, sf)))


@query("E09_review_queue", sql("""SELECT path, class_id, number, (number + 19) // 20 AS page, (p_grade > 0.5)::INT + class_id // 2 * 2 AS suggested FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY p_grade, path) AS number FROM audit WHERE priority = 2)"""))
def e09(spark, sf):
    return lb.review_queue(audit(spark, sf), 2, 20).select("path", "class_id", "number", "page", "suggested")


@query("E10_small_loss_select", sql_both("SELECT path, class_id, place FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY greatest(CASE class_id WHEN 0 THEN j0 WHEN 1 THEN j1 WHEN 2 THEN j2 ELSE j3 END, 1e-15) DESC, path) AS place, count(*) OVER (PARTITION BY class_id) AS n FROM a) WHERE place <= greatest(1, ceil(n * 0.3::DOUBLE))"))
def e10(spark, sf):
    # the least negative log likelihood is the highest probability; logarithms differ in their last bit between engines
    own = F.get(F.array(*JOINT), F.col("class_id").cast("int"))
    return lb.small_loss_select(predictions(spark, sf).withColumn("loss", -F.greatest(own, F.lit(1e-15))), "class_id", 0.3).select("path", "class_id", "place")


@query("W03_source_balanced", with_views("""WITH x AS (SELECT path, class_id, source_id, (path % 5)::DOUBLE AS w FROM manifest), g AS (SELECT class_id, source_id, sum(w) AS mass, count(*) FILTER (w > 0) AS n FROM x GROUP BY 1, 2 HAVING mass > 0), c AS (SELECT class_id, count(*) AS groups, sum(n) AS rows FROM g GROUP BY 1),
 t AS (SELECT count(*) AS k, sum(rows) AS total FROM c) SELECT path, round(coalesce(w * total / (k * groups * mass), 0), 6) AS balanced FROM x LEFT JOIN g ON x.class_id = g.class_id AND x.source_id = g.source_id LEFT JOIN c ON c.class_id = g.class_id, t""", "manifest"))
def w03(spark, sf):
    rows = view(spark, sf, "manifest").withColumn("w", F.expr("cast(path % 5 as double)"))
    return rounded(lb.source_balanced(rows, "source_id", "class_id", "w").select("path", "balanced"))


@query("W06_balanced_sample", with_views("""WITH m AS (SELECT path, class_id, concat_ws(chr(31), class_id, source_id) AS pair FROM manifest WHERE source_id IS NOT NULL), r AS (SELECT path, pair, row_number() OVER (PARTITION BY pair ORDER BY md5('5:' || path), path) - 1 AS row FROM m),
 g AS (SELECT class_id, pair, count(*) AS rows, row_number() OVER (PARTITION BY class_id ORDER BY md5('5:' || pair), pair) - 1 AS grp FROM m GROUP BY 1, 2), s AS (SELECT class_id, count(*) AS groups, row_number() OVER (ORDER BY class_id) - 1 AS rank FROM g GROUP BY 1),
 d AS (SELECT range AS draw, range % (SELECT count(*) FROM s) AS rank, ('0x' || substr(md5('5:group:' || range), 1, 8))::BIGINT AS cg, ('0x' || substr(md5('5:row:' || range), 1, 8))::BIGINT AS cr FROM range((SELECT count(*) FROM manifest)))
 SELECT draw, path, s.class_id FROM d JOIN s USING (rank) JOIN g ON g.class_id = s.class_id AND g.grp = d.cg % s.groups JOIN r ON r.pair = g.pair AND r.row = d.cr % g.rows""", "manifest"))
def w06(spark, sf):
    rows = view(spark, sf, "manifest")
    return lb.balanced_sample(rows, "class_id", "source_id", rows.count(), 5)


@query("W07_expand_views", with_views("SELECT path, v AS view, 1.0::DOUBLE / (1 + path % 3) AS view_weight FROM (SELECT path, unnest(range(1 + path % 3)) AS v FROM manifest)", "manifest"))
def w07(spark, sf):
    rows = view(spark, sf, "manifest").select("path", F.expr("sequence(0, path % 3)").alias("views"), F.lit(1.0).alias("weight"))
    return lb.expand_views(rows, "views", "weight").select("path", "view", "view_weight")
