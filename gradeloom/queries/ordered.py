"""Queries of ordered operators: scans, chains, steady labels and balanced folds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.operators import ordered as od
from gradeloom.plans.catalog import query
from gradeloom.plans.fixtures import view, with_views
from gradeloom.queries.evaluation import rounded
from gradeloom.queries.governance import GROUPS, grouped


def scan_sql(key: str, value: str, first: str, step: str) -> str:
    """Recursive SQL of a scan in the order of time: ``first`` and ``step`` over ``x`` and the state before."""
    sql = with_views(
        f"""WITH o AS (SELECT id, {key} AS k, {value} AS x, row_number() OVER (PARTITION BY {key} ORDER BY ts, id) AS n FROM inspection_log),
 e AS (SELECT id, k, n, {first} AS smooth FROM o WHERE n = 1 UNION ALL SELECT o.id, o.k, o.n, {step} FROM e JOIN o ON o.k = e.k AND o.n = e.n + 1) SELECT id, k AS batch_id, round(smooth, 6) AS smooth FROM e""",
        "inspection_log",
    )
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("E11_ema", scan_sql("batch_id", "score", "x", "0.7::DOUBLE * e.smooth + 0.3::DOUBLE * o.x"))
def e11(spark, sf):
    return rounded(od.ema(view(spark, sf, "inspection_log"), "batch_id", ["ts", "id"], "score", 0.3).select("id", "batch_id", "smooth"))


#: Half of all rows are of one key.
HOT = "CASE WHEN batch_id % 2 = 0 THEN 0 ELSE batch_id END"


@query("E11_ema_hot_key", scan_sql(HOT, "score", "x", "0.98::DOUBLE * e.smooth + 0.02::DOUBLE * o.x"))
def e11_hot(spark, sf):
    rows = view(spark, sf, "inspection_log").withColumn("batch_id", F.expr(HOT))
    return rounded(od.ema(rows, "batch_id", ["ts", "id"], "score", 0.02).select("id", "batch_id", "smooth"))


GAMMA = "least(1.45, greatest(0.65, ln(0.46) / ln(least(0.95, greatest(0.05, score / 100)))))"


@query("E11_adaptive_gamma", scan_sql("batch_id", GAMMA, "0.88::DOUBLE + 0.12::DOUBLE * x", "0.88::DOUBLE * e.smooth + 0.12::DOUBLE * o.x"))
def e11_gamma(spark, sf):
    rows = view(spark, sf, "inspection_log").withColumn("luminance", F.col("score") / 100)
    return rounded(od.adaptive_gamma(rows, "batch_id", ["ts", "id"], "luminance").select("id", "batch_id", "smooth"))


@query("M05_throttle", with_views("""WITH o AS (SELECT id, batch_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY batch_id ORDER BY ts, id) AS n FROM inspection_log),
 r AS (SELECT batch_id, n, us FROM o WHERE n = 1 UNION ALL SELECT o.batch_id, min(o.n), min(o.us) FROM r JOIN o ON o.batch_id = r.batch_id AND o.us >= r.us + 21600000000 GROUP BY o.batch_id) SELECT o.id, o.batch_id FROM r JOIN o ON o.batch_id = r.batch_id AND o.n = r.n""", "inspection_log").replace("WITH ", "WITH RECURSIVE ", 1))
def m05(spark, sf):
    rows = view(spark, sf, "inspection_log").select("id", "batch_id", F.unix_micros("ts").alias("us"))
    return od.throttle_events(rows, "batch_id", "us", "id", 21_600_000_000).select("id", "batch_id")


#: Observations by camera: label, confidence and whether the box was sharp enough.
OBSERVED = ["CASE WHEN (event_id * 7919) % 10 < 5 THEN 'a' WHEN (event_id * 7919) % 10 < 9 THEN 'b' ELSE 'c' END AS label", "CAST((event_id * 31) % 97 AS DOUBLE) / 97 AS confidence", "event_id % 7 <> 0 AS usable"]


@query("M04_steady_labels", f"""WITH RECURSIVE f AS (SELECT user_id AS camera, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, {', '.join(OBSERVED)} FROM events),
 s AS (SELECT camera, frame, NULL::VARCHAR AS shown, usable::INT AS seen, CASE WHEN usable THEN label END AS l1, CASE WHEN usable THEN confidence END AS c1, NULL::VARCHAR AS other, 0 AS run FROM f WHERE frame = 1
 UNION ALL SELECT f.camera, f.frame,
  CASE WHEN NOT f.usable OR (s.shown IS NULL AND s.seen = 0) THEN s.shown WHEN s.shown IS NULL THEN CASE WHEN f.label = s.l1 OR s.c1 > f.confidence OR (s.c1 = f.confidence AND s.l1 < f.label) THEN s.l1 ELSE f.label END
   WHEN f.label <> s.shown AND f.label IS NOT DISTINCT FROM s.other AND s.run >= 2 THEN f.label ELSE s.shown END,
  s.seen + f.usable::INT, CASE WHEN f.usable AND s.seen = 0 THEN f.label ELSE s.l1 END, CASE WHEN f.usable AND s.seen = 0 THEN f.confidence ELSE s.c1 END,
  CASE WHEN NOT f.usable OR s.shown IS NULL THEN s.other WHEN f.label = s.shown OR (f.label IS NOT DISTINCT FROM s.other AND s.run >= 2) THEN NULL ELSE f.label END,
  CASE WHEN NOT f.usable OR s.shown IS NULL THEN s.run WHEN f.label = s.shown OR (f.label IS NOT DISTINCT FROM s.other AND s.run >= 2) THEN 0 WHEN f.label IS NOT DISTINCT FROM s.other THEN s.run + 1 ELSE 1 END
  FROM s JOIN f ON f.camera = s.camera AND f.frame = s.frame + 1) SELECT camera, frame, shown FROM s""")
def m04(spark, sf):
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumns({"camera": F.col("user_id"), "frame": frame}).selectExpr("camera", "frame", *OBSERVED)
    return od.steady_labels(rows, "camera", "frame", "label", "confidence", "usable").select("camera", "frame", "shown")


#: Rounds of the greedy rule, one group each: loads of the label's rows and of all rows by fold are lists.
GREEDY = f"""{GROUPS}, o AS (SELECT *, row_number() OVER (ORDER BY class_id, rows DESC, md5('9:' || grp), grp) AS n FROM g),
 t AS (SELECT class_id, list(md5('9:fold:' || class_id || ':' || f) ORDER BY f) AS h FROM (SELECT DISTINCT class_id FROM g), range(5) AS r(f) GROUP BY class_id),
 q AS (SELECT class_id, list_transform(h, lambda x: len(list_filter(h, lambda y: y < x))) AS tie FROM t),
 p AS (SELECT o.*, tie, row_number() OVER (PARTITION BY o.class_id ORDER BY n) = 1 AS fresh FROM o JOIN q USING (class_id)),
 b AS (SELECT 0::BIGINT AS n, NULL::VARCHAR AS grp, NULL::BIGINT AS class_id, 0::BIGINT AS rows, NULL::INT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS own, [0, 0, 0, 0, 0]::BIGINT[] AS whole
  UNION ALL SELECT n, grp, class_id, rows, fold, list_transform(base, lambda x, i: x + CASE WHEN i = fold + 1 THEN rows ELSE 0 END), list_transform(whole, lambda x, i: x + CASE WHEN i = fold + 1 THEN rows ELSE 0 END)
  FROM (SELECT *, list_position(cost, list_min(cost)) - 1 AS fold FROM (SELECT p.n, p.grp, p.class_id, p.rows, CASE WHEN fresh THEN [0, 0, 0, 0, 0]::BIGINT[] ELSE own END AS base, whole,
   list_transform([1, 2, 3, 4, 5], lambda i: (CASE WHEN fresh THEN 0 ELSE own[i] END) * 100000000000::BIGINT + whole[i] * 10 + tie[i]) AS cost FROM b JOIN p ON p.n = b.n + 1)))"""


@query("E04_balanced_folds", with_views(f"WITH {GREEDY} SELECT grp, class_id, rows, fold FROM b WHERE n > 0", "manifest").replace("WITH ", "WITH RECURSIVE ", 1))
def e04_balanced(spark, sf):
    return od.balanced_group_folds(grouped(spark, sf), "grp", "class_id", 5, 9)
