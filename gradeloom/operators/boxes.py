"""Boxes of detectors: gates, geometry, overlap joins, matching, suppression and order.

A box has ``image``, ``box`` (its id), ``x1, y1, x2, y2`` and, where ranked, ``confidence``. Boxes of one
image meet in equi joins on the image; greedy rules run as rounds of joins over the overlapping pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.plans.durable import written

#: Fixed limits of the candidate gate.
MIN_CONFIDENCE, MIN_RED, MIN_AREA, MAX_AREA, MAX_ASPECT, MIN_SIDE = 0.15, 0.30, 0.0015, 0.12, 5.0, 24
MIN_ELONGATION, NMS_IOU, MATCH_IOU, FUSE_IOU, FUSE_INSIDE = 1.30, 0.45, 0.30, 0.30, 0.65
CORNERS = ("x1", "y1", "x2", "y2")


def wide() -> Column:
    return F.col("x2") - F.col("x1")


def high() -> Column:
    return F.col("y2") - F.col("y1")


def clamp(df: DataFrame, width: float, height: float) -> DataFrame:
    """Corners rounded, held inside the frame and put in order."""
    hold = lambda c, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.round(F.col(c).cast("double"))))
    x, y = (hold("x1", width), hold("x2", width)), (hold("y1", height), hold("y2", height))
    return df.withColumns({"x1": F.least(*x), "y1": F.least(*y), "x2": F.greatest(*x), "y2": F.greatest(*y)})


def gate(df: DataFrame, width: float, height: float) -> DataFrame:
    """Add ``reasons``: every gate that the clamped box fails, in a fixed order; empty for a candidate."""
    box = clamp(df, width, height)
    area, short = wide() * high() / (width * height), F.least(wide(), high())
    rules = [
        ("low_confidence", F.col("confidence") < MIN_CONFIDENCE),
        ("low_red_core", F.col("red_core") < MIN_RED),
        ("too_small", area < MIN_AREA),
        ("too_large", area > MAX_AREA),
        ("too_long", F.greatest(wide(), high()) > MAX_ASPECT * F.greatest(short, F.lit(1.0))),
        ("short_side", short < MIN_SIDE),
    ]
    return box.withColumn("reasons", F.array_compact(F.array(*[F.when(test, name) for name, test in rules])))


def geometry_filter(df: DataFrame, width: float, height: float, region: tuple[float, float, float, float], margin: float = 2) -> DataFrame:
    """Boxes off the border, long enough and with their centre in the region (bounds included)."""
    inside = (F.col("x1") > margin) & (F.col("y1") > margin) & (F.col("x2") < width - margin) & (F.col("y2") < height - margin)
    long = F.greatest(wide(), high()) >= MIN_ELONGATION * F.greatest(F.least(wide(), high()), F.lit(1))
    centre = ((F.col("x1") + F.col("x2")) / 2).between(region[0], region[2]) & ((F.col("y1") + F.col("y2")) / 2).between(region[1], region[3])
    return df.filter(inside & long & centre)


def pad(df: DataFrame, width: float, height: float, least: float, ratio: float, long_side: bool = False) -> DataFrame:
    """Grow every side by ``max(least, ratio * own side)``, or of the long side, inside the frame."""
    sides = (F.greatest(wide(), high()),) * 2 if long_side else (wide(), high())
    dx, dy = (F.greatest(F.lit(float(least)), ratio * side) for side in sides)
    return clamp(df.withColumns({"x1": F.col("x1") - dx, "x2": F.col("x2") + dx, "y1": F.col("y1") - dy, "y2": F.col("y2") + dy}), width, height)


def expand_touching(df: DataFrame, width: float, height: float, least: int = 30, ratio: float = 0.38, calm: int = 8) -> DataFrame:
    """Grow the sides that touch (booleans ``left, top, right, bottom``) by ``max(least, ratio * side)``, the others by a sixth of that, ``calm`` at least."""
    gx, gy = (F.greatest(F.lit(least), F.bround(ratio * side).cast("int")) for side in (wide(), high()))
    other = lambda g: F.greatest(F.lit(calm), F.floor(g / 6))
    by = lambda flag, g: F.when(F.col(flag), g).otherwise(other(g))
    grown = {"x1": F.col("x1") - by("left", gx), "y1": F.col("y1") - by("top", gy), "x2": F.col("x2") + by("right", gx), "y2": F.col("y2") + by("bottom", gy)}
    return clamp(df.withColumns(grown), width, height)


def to_xywh(df: DataFrame, width: float, height: float) -> DataFrame:
    """Add centre and size as shares of the frame: ``cx, cy, w, h``."""
    return df.withColumns({"cx": (F.col("x1") + F.col("x2")) / (2 * width), "cy": (F.col("y1") + F.col("y2")) / (2 * height), "w": wide() / width, "h": high() / height})


def resolution_tier(side: Column) -> Column:
    return F.when(side < 112, 0.35).when(side < 160, 0.60).otherwise(1.0)


def resolution_reason(side: Column) -> Column:
    """Why ``resolution_tier`` lowers the weight of a row; null where it does not."""
    return F.when(side < 112, "below 112 pixels").when(side < 160, "below 160 pixels")


def quality_flags(df: DataFrame, width: float, height: float) -> DataFrame:
    """Add ``flags`` and ``status``: ``review`` where any flag but the border note is set."""
    area = wide() * high() / (width * height)
    edge = (F.col("x1") <= 0) | (F.col("y1") <= 0) | (F.col("x2") >= width) | (F.col("y2") >= height)
    rules = [("info_edge", edge), ("coverage_low", area < 0.002), ("coverage_high", area > 0.75), ("area_low", area < 0.01), ("area_high", area > 0.55), ("blurred", F.col("sharpness") < 150)]
    out = df.withColumn("flags", F.array_compact(F.array(*[F.when(test, name) for name, test in rules])))
    return out.withColumn("status", F.when(F.exists("flags", lambda f: ~f.startswith("info_")), "review").otherwise("ok"))


def rank_components(df: DataFrame, width: float, height: float) -> DataFrame:
    """Plausible regions with ``rank_score``: an area in a band of the frame's, sides, place, shape and surroundings; columns ``area``, ``surround`` and ``density`` come with the region."""
    aspect = F.greatest(wide(), high()) / F.greatest(F.least(wide(), high()), F.lit(1))
    cx, cy = (F.col("x1") + F.col("x2")) / (2 * width), (F.col("y1") + F.col("y2")) / (2 * height)
    whole = width * height
    band = F.col("area").between(max(24, int(whole * 0.000025)), int(whole * 0.035))
    plausible = band & (wide() >= 5) & (high() >= 5) & cx.between(0.02, 0.98) & cy.between(0.10, 0.98) & (aspect <= 9.5) & (F.col("surround") >= 0.42)
    score = F.log1p("area") + 3 * F.col("surround") + 0.4 * F.least("density", F.lit(0.8)) - 0.15 * F.greatest(F.lit(0.0), aspect - 5)
    return df.filter(plausible).withColumn("rank_score", score)


def _in_cells(df: DataFrame, box: str) -> DataFrame:
    """A row for each grid cell that a box reaches, on its own level and on all coarser ones that an image has.

    A level's cells are as wide as a power of two that no side of its boxes exceeds, so that a box reaches four of them at most.
    """
    sides = [F.col(c).cast("double") for c in CORNERS]
    rows = df.select("image", F.col("box").alias(box), *[c.alias(f"{box}_{n}") for c, n in zip(sides, CORNERS, strict=True)])
    x1, y1, x2, y2 = (F.col(f"{box}_{n}") for n in CORNERS)
    return rows.withColumn(f"{box}_level", F.ceil(F.log2(F.greatest(x2 - x1, y2 - y1, F.lit(1.0)))).cast("int"))


def _cells(rows: DataFrame, box: str, levels: DataFrame) -> DataFrame:
    x1, y1, x2, y2 = (F.col(f"{box}_{n}") for n in CORNERS)
    wide = F.pow(F.lit(2.0), F.col("level"))
    span = lambda low, high: F.sequence(F.floor(low / wide), F.floor(high / wide))
    at = rows.crossJoin(F.broadcast(levels)).withColumn("level", F.explode(F.filter("levels", lambda n: n >= F.col(f"{box}_level")))).drop("levels")  # one row
    return at.filter((x2 >= x1) & (y2 >= y1)).withColumn("cx", F.explode(span(x1, x2))).withColumn("cy", F.explode(span(y1, y2)))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """``image, a, b, iou, inside`` of all boxes of the two tables that overlap; inside: of the smaller one.

    Boxes meet in grid cells of the size of the larger one, each pair in the cell of its common upper left corner alone, so that an image of many
    boxes makes about as many candidates as neighbours, whatever the boxes' sizes.
    """
    left, right = _in_cells(a, "a"), _in_cells(b, "b")
    # the levels in use, a few numbers: sides are under 2**1024
    levels = left.select(F.col("a_level").alias("n")).unionByName(right.select(F.col("b_level").alias("n"))).agg(F.array_sort(F.collect_set("n")).alias("levels"))
    one, two = _cells(left, "a", levels), _cells(right, "b", levels)
    cell = ["image", "level", "cx", "cy"]
    meet = one.filter("a_level = level").join(two.hint("merge"), cell).unionByName(one.filter("a_level < level").join(two.filter("b_level = level").hint("merge"), cell))
    wide = F.pow(F.lit(2.0), F.col("level"))
    owner = (F.floor(F.greatest("a_x1", "b_x1") / wide) == F.col("cx")) & (F.floor(F.greatest("a_y1", "b_y1") / wide) == F.col("cy"))
    meet = meet.filter("a_x1 < b_x2 AND b_x1 < a_x2 AND a_y1 < b_y2 AND b_y1 < a_y2").filter(owner)
    inter = F.expr("(least(a_x2, b_x2) - greatest(a_x1, b_x1)) * (least(a_y2, b_y2) - greatest(a_y1, b_y1))")
    one, two = F.expr("(a_x2 - a_x1) * (a_y2 - a_y1)"), F.expr("(b_x2 - b_x1) * (b_y2 - b_y1)")
    return meet.select("image", "a", "b", (inter / F.greatest(one + two - inter, F.lit(1e-9))).alias("iou"), (inter / F.greatest(F.least(one, two), F.lit(1e-9))).alias("inside"))


def iou_pairs(a: DataFrame, b: DataFrame, min_iou: float) -> DataFrame:
    return overlaps(a, b).filter(F.col("iou") >= min_iou).select("image", "a", "b", "iou")


def match_one_to_one(pairs: DataFrame, floor: float = MATCH_IOU) -> DataFrame:
    """Greedy one-to-one matching by IoU, ties to the larger ``a``, then the larger ``b``.

    Each round takes the pairs that are best on both sides and drops all other pairs of their ends; the
    order is total, so the rounds give the greedy result. A round takes at least the best pair left of every image.
    """
    left, found = written(pairs.filter(F.col("iou") >= floor).select("image", "a", "b", "iou")), []
    order = [F.desc("iou"), F.desc("a"), F.desc("b")]
    while not left.isEmpty():
        ranked = left.withColumn("_i", F.row_number().over(Window.partitionBy("image", "a").orderBy(*order)))
        ranked = ranked.withColumn("_j", F.row_number().over(Window.partitionBy("image", "b").orderBy(*order)))
        best = written(ranked.filter("_i = 1 AND _j = 1").drop("_i", "_j"))
        found.append(best)
        left = written(left.join(best.select("image", "a").hint("merge"), ["image", "a"], "left_anti").join(best.select("image", "b").hint("merge"), ["image", "b"], "left_anti"))
    out = left
    for best in found:
        out = out.unionByName(best)
    return out


def _greedy_losers(edges: DataFrame) -> DataFrame:
    """``image, box`` of the boxes that a kept better box drops; ``edges``: ``image, better, worse``.

    A round keeps the boxes without a better one left and drops all that they beat; as many rounds as the longest chain.
    """
    left, lost = written(edges.select("image", "better", "worse")), []
    none = left.select("image", F.col("worse").alias("box")).limit(0)
    while not left.isEmpty():
        kept = left.select("image", "better").distinct().join(left.select("image", F.col("worse").alias("better")).hint("merge"), ["image", "better"], "left_anti")
        gone = written(left.join(kept.hint("merge"), ["image", "better"]).select("image", F.col("worse").alias("box")).distinct())
        lost.append(gone)
        left = written(
            left.join(gone.select("image", F.col("box").alias("better")).hint("merge"), ["image", "better"], "left_anti")
            .join(gone.select("image", F.col("box").alias("worse")).hint("merge"), ["image", "worse"], "left_anti")
            .select("image", "better", "worse")
        )
    for gone in lost:
        none = none.unionByName(gone)
    return none


def nms(df: DataFrame, threshold: float = NMS_IOU) -> DataFrame:
    """Add ``kept``: false for a box that overlaps a kept one of higher confidence (ties: smaller id) by more than the threshold."""
    rank = df.select("image", "box", "confidence")
    close = overlaps(df, df).filter((F.col("iou") > threshold) & (F.col("a") != F.col("b")))
    close = close.join(rank.select("image", F.col("box").alias("a"), F.col("confidence").alias("_ca")), ["image", "a"]).join(rank.select("image", F.col("box").alias("b"), F.col("confidence").alias("_cb")), ["image", "b"])
    edges = close.filter("_ca > _cb OR (_ca = _cb AND a < b)").select("image", F.col("a").alias("better"), F.col("b").alias("worse"))
    lost = _greedy_losers(edges).withColumn("_lost", F.lit(True))
    return df.join(lost.hint("merge"), ["image", "box"], "left").withColumn("kept", F.col("_lost").isNull()).drop("_lost")


def fuse_proposals(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """All primaries, and the secondaries (in the order of their ids) that repeat no primary and no accepted secondary."""
    repeats = (F.col("iou") > FUSE_IOU) | (F.col("inside") > FUSE_INSIDE)
    hit = overlaps(secondary, primary).filter(repeats).select("image", F.col("a").alias("box"))
    free = secondary.join(hit.hint("merge"), ["image", "box"], "left_anti")
    edges = overlaps(free, free).filter(repeats & (F.col("a") < F.col("b"))).select("image", F.col("a").alias("better"), F.col("b").alias("worse"))
    kept = free.join(_greedy_losers(edges).hint("merge"), ["image", "box"], "left_anti")
    return primary.withColumn("role", F.lit("primary")).unionByName(kept.withColumn("role", F.lit("secondary")))


def top_n(df: DataFrame, n: Column, order: list[Column]) -> DataFrame:
    """The first ``n`` boxes of each image; ``n`` may be a column."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("image").orderBy(*order))).filter(F.col("place") <= n)


def number_accepted(df: DataFrame, accepted: Column, order: list[str]) -> DataFrame:
    """Add ``number``: a running id over the accepted boxes of an image, empty for the others."""
    so_far = F.sum(accepted.cast("int")).over(Window.partitionBy("image").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("number", F.when(accepted, F.format_string("%s-%04d", F.col("image").cast("string"), so_far)).otherwise(""))


def reading_order(df: DataFrame) -> DataFrame:
    """``image, box, line, place``: lines from top to bottom, boxes from left to right in a line.

    A new line starts when a centre lies further from the median of the line so far than ``max(12, 0.75 * median height)``.
    The rule is a scan over the boxes of one image from top to bottom; a task takes many images one after another and holds the line it is at.
    """
    own = df.select("image", "box", *[F.col(c).cast("double").alias(c) for c in CORNERS])
    high = own.groupBy(F.col("image").alias("_image")).agg(F.greatest(F.lit(12.0), 0.75 * F.percentile(F.col("y2") - F.col("y1"), F.lit(0.5))).alias("reach"))
    rows = own.select("image", "box", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    rows = rows.join(high.hint("merge"), F.col("image").eqNullSafe(F.col("_image"))).select("image", "box", "cx", "cy", "reach")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line, current = None, 0, []  # ``current``: the centres of the line so far, ascending, so that their median is in the middle
        for batch in batches:
            lines = []
            for image, cy, reach in zip(*[batch.column(c).to_pylist() for c in ("image", "cy", "reach")], strict=True):
                if now != (image,):
                    now, line, current = (image,), 0, []
                n = len(current)
                if n and abs(cy - (current[(n - 1) // 2] + current[n // 2]) / 2) > reach:
                    line, current = line + 1, []
                current.append(cy)
                lines.append(line)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("image", "box", "cx")], pa.array(lines, pa.int64())], ["image", "box", "cx", "line"])

    ordered = rows.repartition("image").sortWithinPartitions("image", "cy", "cx", "box")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("image", "box", "cx"))
    lined = ordered.mapInArrow(scan, f"{kinds}, line long")
    place = F.row_number().over(Window.partitionBy("image").orderBy("line", "cx", "box")).cast("long")
    return lined.select("image", "box", "line", place.alias("place"))


def coverage(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per image: reference boxes, how many a detection matches (IoU of at least 0.30), and their share."""
    hit = iou_pairs(truth, found, MATCH_IOU).select("image", F.col("a").alias("box")).distinct().withColumn("_hit", F.lit(1))
    rows = truth.select("image", "box").join(hit.hint("merge"), ["image", "box"], "left")
    return rows.groupBy("image").agg(F.count(F.lit(1)).alias("truth"), F.count("_hit").alias("matched")).withColumn("share", F.col("matched") / F.col("truth"))


def coverage_with_total(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``coverage`` of each image, and one row with a null image of all reference boxes together."""
    each = written(coverage(found, truth))
    whole = each.agg(F.lit(None).cast(each.schema["image"].dataType).alias("image"), F.coalesce(F.sum("truth"), F.lit(0)).alias("truth"), F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"))
    return each.unionByName(whole.withColumn("share", F.col("matched") / F.nullif(F.col("truth"), F.lit(0))))


def count_recall(df: DataFrame, found: Column, truth: Column) -> DataFrame:
    """Per image ``min(found, truth) / truth``; one where nothing was to find."""
    counts = df.groupBy("image").agg(F.count_if(found).alias("found"), F.count_if(truth).alias("truth"))
    return counts.withColumn("recall", F.when(F.col("truth") == 0, 1.0).otherwise(F.least("found", "truth") / F.col("truth")))


def candidate_audit(df: DataFrame, expected: int, min_area: float) -> DataFrame:
    """Per image: candidates, those above the fragment floor, the floor, the status and ``ratios``: areas over the median, largest first.

    The floor is the greater of ``min_area`` and a tenth of the median of the 25 largest areas.
    """
    area = (wide() * high()).cast("double")
    rows = df.withColumn("_area", area).withColumn("_n", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("_area"), "box")))
    median = F.percentile("_area", F.lit(0.5))
    floor = rows.filter("_n <= 25").groupBy("image").agg(F.greatest(F.lit(float(min_area)), 0.10 * median).alias("floor"), median.alias("_median"))
    ratio = F.when(F.col("_median") > 0, F.col("_area") / F.col("_median")).otherwise(0.0)
    ratios = F.reverse(F.array_sort(F.collect_list(ratio)))  # an image's boxes
    out = rows.join(floor.hint("merge"), "image").groupBy("image", "floor").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("_area") >= F.col("floor")).alias("selected"), ratios.alias("ratios"))
    return out.withColumn("status", F.when(F.col("selected") >= expected, "ok").otherwise("shortfall"))


def motion(df: DataFrame, track: str, order: str) -> DataFrame:
    """Add ``dx, dy, shift`` of the centre since the row before in the track; null in the first."""
    by = Window.partitionBy(track).orderBy(order)
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    out = df.withColumns({"dx": cx - F.lag(cx).over(by), "dy": cy - F.lag(cy).over(by)})
    return out.withColumn("shift", F.hypot("dx", "dy"))
