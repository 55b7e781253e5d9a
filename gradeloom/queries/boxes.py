"""Queries over the boxes of detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import boxes as bx
from gradeloom.plans.catalog import query
from gradeloom.plans.fixtures import view, with_views

WIDTH, HEIGHT = 300, 250
CLAMPED = """WITH c AS (SELECT image, box, confidence, red_core, greatest(0, least(300, x1))::DOUBLE AS x1, greatest(0, least(250, y1))::DOUBLE AS y1, greatest(0, least(300, x2))::DOUBLE AS x2, greatest(0, least(250, y2))::DOUBLE AS y2 FROM boxes)"""
SHIFTED = "d AS (SELECT image, box, x1 + box % 5 AS x1, y1 - box % 3 AS y1, x2 + box % 5 AS x2, y2 - box % 3 AS y2 FROM boxes)"
PAIRS = f"""{SHIFTED}, i AS (SELECT a.image, a.box AS a, b.box AS b, ((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)))::DOUBLE AS n, (a.x2 - a.x1) * (a.y2 - a.y1) AS s, (b.x2 - b.x1) * (b.y2 - b.y1) AS t
 FROM boxes a JOIN d b ON a.image = b.image AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2), p AS (SELECT image, a, b, n / (s + t - n) AS iou FROM i)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "boxes")


def shifted(spark: SparkSession, sf: str) -> DataFrame:
    """A second detector: the boxes moved by a few points."""
    return boxes(spark, sf).withColumns({"x1": F.expr("x1 + box % 5"), "x2": F.expr("x2 + box % 5"), "y1": F.expr("y1 - box % 3"), "y2": F.expr("y2 - box % 3")})


def sql(text: str) -> str:
    return with_views(text, "boxes")


@query("B10_gate_boxes", sql(CLAMPED + """ SELECT image, box, list_filter([CASE WHEN confidence < 0.15 THEN 'low_confidence' END, CASE WHEN red_core < 0.30 THEN 'low_red_core' END, CASE WHEN (x2 - x1) * (y2 - y1) / 75000 < 0.0015 THEN 'too_small' END,
 CASE WHEN (x2 - x1) * (y2 - y1) / 75000 > 0.12 THEN 'too_large' END, CASE WHEN greatest(x2 - x1, y2 - y1) > 5 * greatest(least(x2 - x1, y2 - y1), 1) THEN 'too_long' END, CASE WHEN least(x2 - x1, y2 - y1) < 24 THEN 'short_side' END], lambda r: r IS NOT NULL) AS reasons FROM c"""))
def b10(spark, sf):
    return bx.gate(boxes(spark, sf), WIDTH, HEIGHT).select("image", "box", "reasons")


@query("B11_geometry_filter", sql("""SELECT image, box FROM boxes WHERE x1 > 2 AND y1 > 2 AND x2 < 298 AND y2 < 248 AND greatest(x2 - x1, y2 - y1) >= 1.30 * greatest(least(x2 - x1, y2 - y1), 1) AND (x1 + x2) / 2 BETWEEN 30 AND 270 AND (y1 + y2) / 2 BETWEEN 25 AND 225"""))
def b11(spark, sf):
    return bx.geometry_filter(boxes(spark, sf), WIDTH, HEIGHT, (30, 25, 270, 225)).select("image", "box")


@query("B12_pad_box", sql("""WITH g AS (SELECT image, box, x1, y1, x2, y2, greatest(4.0::DOUBLE, 0.12::DOUBLE * (x2 - x1)) AS dx, greatest(4.0::DOUBLE, 0.12::DOUBLE * (y2 - y1)) AS dy FROM boxes),
 k AS (SELECT image, box, greatest(0, least(300, round(x1 - dx))) AS x1, greatest(0, least(250, round(y1 - dy))) AS y1, greatest(0, least(300, round(x2 + dx))) AS x2, greatest(0, least(250, round(y2 + dy))) AS y2 FROM g)
 SELECT image, box, x1, y1, x2, y2, round((x1 + x2) / 600, 6) AS cx, round((y1 + y2) / 500, 6) AS cy, round((x2 - x1) / 300, 6) AS w, round((y2 - y1) / 250, 6) AS h FROM k"""))
def b12(spark, sf):
    out = bx.to_xywh(bx.pad(boxes(spark, sf), WIDTH, HEIGHT, 4, 0.12), WIDTH, HEIGHT)
    return out.select("image", "box", *bx.CORNERS, *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query("B12_pad_long_side", sql("WITH g AS (SELECT image, box, x1, y1, x2, y2, greatest(22.0::DOUBLE, 0.40::DOUBLE * greatest(x2 - x1, y2 - y1)) AS d FROM boxes) SELECT image, box, greatest(0, least(300, round(x1 - d))) AS x1, greatest(0, least(250, round(y1 - d))) AS y1, greatest(0, least(300, round(x2 + d))) AS x2, greatest(0, least(250, round(y2 + d))) AS y2 FROM g"))
def b12_long(spark, sf):
    return bx.pad(boxes(spark, sf), WIDTH, HEIGHT, 22, 0.40, long_side=True).select("image", "box", *bx.CORNERS)


@query("B12_expand_touching", sql("""WITH g AS (SELECT *, greatest(30, round_even(0.38::DOUBLE * (x2 - x1), 0))::INT AS gx, greatest(30, round_even(0.38::DOUBLE * (y2 - y1), 0))::INT AS gy FROM boxes)
 SELECT image, box, greatest(0, x1 - CASE WHEN x1 <= 2 THEN gx ELSE greatest(8, gx // 6) END)::DOUBLE AS x1, greatest(0, y1 - CASE WHEN y1 <= 2 THEN gy ELSE greatest(8, gy // 6) END)::DOUBLE AS y1, least(300, x2 + CASE WHEN box % 4 = 0 THEN gx ELSE greatest(8, gx // 6) END)::DOUBLE AS x2, least(250, y2 + CASE WHEN box % 7 = 0 THEN gy ELSE greatest(8, gy // 6) END)::DOUBLE AS y2 FROM g"""))
def b12_touching(spark, sf):
    flags = {"left": F.expr("x1 <= 2"), "top": F.expr("y1 <= 2"), "right": F.expr("box % 4 = 0"), "bottom": F.expr("box % 7 = 0")}
    return bx.expand_touching(boxes(spark, sf).withColumns(flags), WIDTH, HEIGHT).select("image", "box", *bx.CORNERS)


@query("B13_qc_status", sql("""WITH f AS (SELECT image, box, list_filter([CASE WHEN x1 <= 0 OR y1 <= 0 OR x2 >= 300 OR y2 >= 250 THEN 'info_edge' END, CASE WHEN (x2 - x1) * (y2 - y1) / 75000 < 0.002 THEN 'coverage_low' END, CASE WHEN (x2 - x1) * (y2 - y1) / 75000 > 0.75 THEN 'coverage_high' END,
 CASE WHEN (x2 - x1) * (y2 - y1) / 75000 < 0.01 THEN 'area_low' END, CASE WHEN (x2 - x1) * (y2 - y1) / 75000 > 0.55 THEN 'area_high' END, CASE WHEN (box * 13) % 200 < 150 THEN 'blurred' END], lambda r: r IS NOT NULL) AS flags FROM boxes)
 SELECT *, CASE WHEN len(list_filter(flags, lambda r: NOT starts_with(r, 'info_'))) > 0 THEN 'review' ELSE 'ok' END AS status FROM f"""))
def b13(spark, sf):
    return bx.quality_flags(boxes(spark, sf).withColumn("sharpness", F.expr("(box * 13) % 200")), WIDTH, HEIGHT).select("image", "box", "flags", "status")


@query("B14_resolution_tier", sql("SELECT image, box, CASE WHEN greatest(x2 - x1, y2 - y1) * 2 < 112 THEN 0.35 WHEN greatest(x2 - x1, y2 - y1) * 2 < 160 THEN 0.60 ELSE 1.0 END::DOUBLE AS tier FROM boxes"))
def b14(spark, sf):
    return boxes(spark, sf).select("image", "box", bx.resolution_tier(F.greatest(bx.wide(), bx.high()) * 2).alias("tier"))


@query("B16_rank_components", sql("""SELECT image, box, round(ln(1 + area) + 3 * surround + 0.4 * least(red_core, 0.8) - 0.15 * greatest(0, aspect - 5), 6) AS rank_score FROM
 (SELECT *, ((x2 - x1) * (y2 - y1))::DOUBLE AS area, confidence AS surround, greatest(x2 - x1, y2 - y1)::DOUBLE / greatest(least(x2 - x1, y2 - y1), 1) AS aspect FROM boxes)
 WHERE x2 - x1 >= 5 AND y2 - y1 >= 5 AND (x1 + x2)::DOUBLE / 600 BETWEEN 0.02 AND 0.98 AND (y1 + y2)::DOUBLE / 500 BETWEEN 0.10 AND 0.98 AND aspect <= 9.5 AND surround >= 0.42 AND area BETWEEN 24 AND 2625"""))
def b16(spark, sf):
    regions = boxes(spark, sf).withColumns({"area": (bx.wide() * bx.high()).cast("double"), "surround": F.col("confidence"), "density": F.col("red_core")})
    return bx.rank_components(regions, WIDTH, HEIGHT).select("image", "box", F.round("rank_score", 6).alias("rank_score"))


@query("C03_iou_pairs", sql(f"WITH {PAIRS} SELECT image, a, b, round(iou, 6) AS iou FROM p WHERE iou >= 0.2"))
def c03(spark, sf):
    return bx.iou_pairs(boxes(spark, sf), shifted(spark, sf), 0.2).select("image", "a", "b", F.round("iou", 6).alias("iou"))


def recursive(text: str) -> str:
    return sql(text).replace("WITH ", "WITH RECURSIVE ", 1)


#: The greedy rules as recursive SQL: one row for each image and step, with a list of what is taken.
MATCHED = f"""WITH {PAIRS}, q AS (SELECT * FROM p WHERE iou >= 0.3), m(image, step, xs, ys, a, b, iou) AS (SELECT DISTINCT image, 0, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM q
 UNION ALL SELECT image, step + 1, list_append(xs, w.a), list_append(ys, w.b), w.a, w.b, w.iou FROM (SELECT m.image, m.step, m.xs, m.ys, arg_max({{'a': q.a::BIGINT, 'b': q.b::BIGINT, 'iou': q.iou}}, (q.iou, q.a, q.b)) AS w FROM m JOIN q ON q.image = m.image AND NOT list_contains(m.xs, q.a) AND NOT list_contains(m.ys, q.b) GROUP BY ALL))
 SELECT image, a, b, round(iou, 6) AS iou FROM m WHERE step > 0"""


def meeting(one: str, two: str, name: str) -> str:
    """SQL of the overlapping boxes of two tables, with the share of both and of the smaller one."""
    return f"""{name}_i AS (SELECT a.image, a.box AS a, b.box AS b, ((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)))::DOUBLE AS n, (a.x2 - a.x1) * (a.y2 - a.y1) AS s, (b.x2 - b.x1) * (b.y2 - b.y1) AS t FROM {one} a JOIN {two} b ON a.image = b.image AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2),
 {name} AS (SELECT image, a, b, n / (s + t - n) AS iou, n / least(s, t) AS inside FROM {name}_i)"""


#: Boxes ``o`` numbered by image (``n``), each with its earlier ``rivals``: kept unless one of these is.
KEPT = """e AS (SELECT o.image, o.n, o.box::BIGINT AS box, coalesce(list(r.rival::BIGINT) FILTER (r.rival IS NOT NULL), []) AS rivals FROM o LEFT JOIN r ON r.image = o.image AND r.box = o.box GROUP BY ALL),
 k(image, n, kept) AS (SELECT DISTINCT image, 0::BIGINT, []::BIGINT[] FROM o UNION ALL SELECT k.image, e.n, CASE WHEN list_has_any(kept, rivals) THEN kept ELSE list_append(kept, e.box) END FROM k JOIN e ON e.image = k.image AND e.n = k.n + 1), z AS (SELECT image, arg_max(kept, n) AS kept FROM k GROUP BY image)"""


@query("C04_match_one_to_one", recursive(MATCHED))
def c04(spark, sf):
    return bx.match_one_to_one(bx.iou_pairs(boxes(spark, sf), shifted(spark, sf), bx.MATCH_IOU)).select("image", "a", "b", F.round("iou", 6).alias("iou"))


@query("C05_nms", recursive(f"WITH {meeting('boxes', 'boxes', 'c')}, o AS (SELECT image, box, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, box) AS n FROM boxes), r AS (SELECT c.image, c.a AS box, c.b AS rival FROM c JOIN o x ON x.image = c.image AND x.box = c.a JOIN o y ON y.image = c.image AND y.box = c.b WHERE c.iou > 0.45 AND y.n < x.n), {KEPT} SELECT b.image, b.box, list_contains(z.kept, b.box::BIGINT) AS kept FROM boxes b JOIN z USING (image)"))
def c05(spark, sf):
    return bx.nms(boxes(spark, sf)).select("image", "box", "kept")


@query("C06_fuse_proposals", recursive(f"""WITH {SHIFTED}, pri AS (SELECT * FROM boxes WHERE box % 2 = 0), sec AS (SELECT * FROM d WHERE box % 2 = 1), {meeting('sec', 'pri', 'h')}, {meeting('sec', 'sec', 'c')},
 free AS (SELECT image, box FROM sec WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.image = sec.image AND h.a = sec.box AND (iou > 0.30 OR inside > 0.65))), o AS (SELECT image, box, row_number() OVER (PARTITION BY image ORDER BY box) AS n FROM free), r AS (SELECT image, a AS box, b AS rival FROM c WHERE b < a AND (iou > 0.30 OR inside > 0.65)), {KEPT}
 SELECT image, box, 'primary' AS role FROM pri UNION ALL SELECT o.image, o.box, 'secondary' FROM o JOIN z USING (image) WHERE list_contains(z.kept, o.box::BIGINT)"""))
def c06(spark, sf):
    return bx.fuse_proposals(boxes(spark, sf).filter("box % 2 = 0"), shifted(spark, sf).filter("box % 2 = 1")).select("image", "box", "role")


@query("D11_reference_coverage", sql(f"WITH {PAIRS}, h AS (SELECT DISTINCT image, a FROM p WHERE iou >= 0.3 AND b IN (SELECT box FROM boxes WHERE confidence >= 0.5)) SELECT x.image, count(*) AS truth, count(h.a) AS matched, count(h.a)::DOUBLE / count(*) AS share FROM boxes x LEFT JOIN h ON x.image = h.image AND x.box = h.a GROUP BY x.image"))
def d11(spark, sf):
    return bx.coverage(shifted(spark, sf).filter("confidence >= 0.5"), boxes(spark, sf))


@query("D30_candidate_audit", sql("""WITH r AS (SELECT image, ((x2 - x1) * (y2 - y1))::DOUBLE AS area, row_number() OVER (PARTITION BY image ORDER BY (x2 - x1) * (y2 - y1) DESC, box) AS n FROM boxes), f AS (SELECT image, greatest(1500, 0.10::DOUBLE * quantile_cont(area, 0.5)) AS floor, quantile_cont(area, 0.5) AS median FROM r WHERE n <= 25 GROUP BY image)
 SELECT image, round(floor, 6) AS floor, count(*) AS candidates, count(*) FILTER (area >= floor) AS selected, CASE WHEN selected >= 6 THEN 'ok' ELSE 'shortfall' END AS status, list(round(area / median, 6) ORDER BY area DESC) AS ratios FROM r JOIN f USING (image) GROUP BY image, floor"""))
def d30(spark, sf):
    return bx.candidate_audit(boxes(spark, sf), 6, 1500).withColumns({"floor": F.round("floor", 6), "ratios": F.transform("ratios", lambda x: F.round(x, 6))})


@query("D31_count_recall", sql("SELECT image, count(*) FILTER (confidence >= 0.5) AS found, count(*) FILTER (red_core >= 0.5) AS truth, CASE WHEN truth = 0 THEN 1.0 ELSE round(least(found, truth) / truth::DOUBLE, 6) END::DOUBLE AS recall FROM boxes GROUP BY image"))
def d31(spark, sf):
    return bx.count_recall(boxes(spark, sf), F.col("confidence") >= 0.5, F.col("red_core") >= 0.5).withColumn("recall", F.round("recall", 6))


@query("E06_top_n_per_image", sql("SELECT image, box, place FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, box) AS place FROM boxes) WHERE place <= 1 + image // 8 % 4"))
def e06(spark, sf):
    return bx.top_n(boxes(spark, sf), F.expr("1 + image div 8 % 4"), [F.desc("confidence"), F.col("box")]).select("image", "box", "place")


@query("E07_reading_order", recursive("""WITH o AS (SELECT image, box, cx, cy, row_number() OVER (PARTITION BY image ORDER BY cy, cx, box) AS n, greatest(12.0, 0.75 * median(high) OVER (PARTITION BY image))::DOUBLE AS reach FROM (SELECT image, box, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy, y2 - y1 AS high FROM boxes)),
 l(image, n, box, cx, line, cur) AS (SELECT DISTINCT image, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, 0::BIGINT, []::DOUBLE[] FROM o UNION ALL SELECT l.image, o.n, o.box::BIGINT, o.cx, CASE WHEN l.n > 0 AND abs(o.cy - list_aggregate(cur, 'median')) > reach THEN line + 1 ELSE line END, CASE WHEN l.n > 0 AND abs(o.cy - list_aggregate(cur, 'median')) > reach THEN [o.cy] ELSE list_append(cur, o.cy) END FROM l JOIN o ON o.image = l.image AND o.n = l.n + 1)
 SELECT image, box, line, row_number() OVER (PARTITION BY image ORDER BY line, cx, box) AS place FROM l WHERE n > 0"""))
def e07(spark, sf):
    return bx.reading_order(boxes(spark, sf))


@query("E08_number_accepted", sql("SELECT image, box, CASE WHEN confidence >= 0.3 THEN printf('%d-%04d', image, sum((confidence >= 0.3)::INT) OVER (PARTITION BY image ORDER BY box ROWS UNBOUNDED PRECEDING)::BIGINT) ELSE '' END AS number FROM boxes"))
def e08(spark, sf):
    return bx.number_accepted(boxes(spark, sf), F.col("confidence") >= 0.3, ["box"]).select("image", "box", "number")


@query("E15_motion", sql("""WITH m AS (SELECT image, box, (x1 + x2) / 2 - lag((x1 + x2) / 2) OVER w AS dx, (y1 + y2) / 2 - lag((y1 + y2) / 2) OVER w AS dy FROM boxes WINDOW w AS (PARTITION BY image ORDER BY box))
 SELECT *, round(sqrt(dx * dx + dy * dy), 6) AS shift FROM m"""))
def e15(spark, sf):
    return bx.motion(boxes(spark, sf), "image", "box").select("image", "box", "dx", "dy", F.round("shift", 6).alias("shift"))
