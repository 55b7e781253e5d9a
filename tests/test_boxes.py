"""Greedy box rules against plain loops over one image at a time."""

import random
import statistics

from gradeloom.operators import boxes as bx

SCHEMA = "image long, box long, x1 long, y1 long, x2 long, y2 long, confidence double"


def some(seed, images=4, per=14):
    rng, rows = random.Random(seed), []
    for image in range(images):
        for n in range(per):
            x, y = rng.randrange(60), rng.randrange(60)
            rows.append((image, image * 100 + n, x, y, x + rng.randrange(10, 50), y + rng.randrange(10, 50), rng.randrange(8) / 8))
    return rows


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    if w <= 0 or h <= 0:
        return 0.0, 0.0
    one, two = (a[4] - a[2]) * (a[5] - a[3]), (b[4] - b[2]) * (b[5] - b[3])
    return w * h / (one + two - w * h), w * h / min(one, two)


def test_suppression(spark):
    rows = some(1)
    got = {r.box: r.kept for r in bx.nms(spark.createDataFrame(rows, SCHEMA)).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(k[0] != r[0] or iou(k, r)[0] <= bx.NMS_IOU for k in kept):
            kept.append(r)
    assert got == {r[1]: r in kept for r in rows}


def test_fusion(spark):
    first, second = some(2, per=5), [(r[0], r[1] + 50, *r[2:]) for r in some(3)]
    got = {r.box for r in bx.fuse_proposals(spark.createDataFrame(first, SCHEMA), spark.createDataFrame(second, SCHEMA)).collect()}
    kept = list(first)
    for r in sorted(second, key=lambda r: r[1]):
        if all(k[0] != r[0] or (iou(k, r)[0] <= bx.FUSE_IOU and iou(k, r)[1] <= bx.FUSE_INSIDE) for k in kept):
            kept.append(r)
    assert got == {r[1] for r in kept}


def test_matching(spark):
    left, right = some(4), some(5)
    pairs = bx.iou_pairs(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), bx.MATCH_IOU)
    got = {(r.a, r.b) for r in bx.match_one_to_one(pairs).collect()}
    every = sorted(((iou(a, b)[0], a[1], b[1]) for a in left for b in right if a[0] == b[0] and iou(a, b)[0] >= bx.MATCH_IOU), reverse=True)
    used_a, used_b, want = set(), set(), set()
    for _, a, b in every:
        if a not in used_a and b not in used_b:
            want.add((a, b))
            used_a.add(a)
            used_b.add(b)
    assert got == want and got


def test_reading_order(spark):
    rows = [(1, 1, 0, 0, 10, 40, 1.0), (1, 2, 50, 5, 60, 45, 1.0), (1, 3, 20, 2, 30, 42, 1.0), (1, 4, 5, 100, 15, 140, 1.0)]
    got = sorted((r.place, r.box, r.line) for r in bx.reading_order(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 0), (2, 3, 0), (3, 2, 0), (4, 4, 1)]


def test_no_boxes(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bx.nms(none).count() == 0
    assert bx.match_one_to_one(bx.iou_pairs(none, none, 0.3)).count() == 0


def test_dense_image_of_all_sizes(spark):
    """Small, large and touching boxes of one image: the grid finds the pairs of all boxes that overlap, once each."""
    rng, rows = random.Random(2), []
    for k in range(700):
        side = rng.choice([0, 1, 3, 8, 8, 20, 64, 300, 2000])
        x, y = rng.randrange(-500, 3000), rng.randrange(-500, 3000)
        rows.append((k % 2, k, x, y, x + side, y + rng.choice([side, 1 + side // 3])))
    boxes = spark.createDataFrame(rows, "image long, box long, x1 long, y1 long, x2 long, y2 long")
    got = sorted((r.image, r.a, r.b) for r in bx.overlaps(boxes, boxes.filter("box % 3 > 0")).collect())
    meet = lambda p, q: p[0] == q[0] and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5]
    assert got == sorted((p[0], p[1], q[1]) for p in rows for q in rows if q[1] % 3 > 0 and meet(p, q))


def test_many_boxes_make_few_candidates(spark):
    side = 150  # 22,500 boxes of one image, each over its right and lower neighbours
    rows = spark.range(side * side).selectExpr("0L AS image", "id AS box", f"id % {side} * 10 AS x1", f"floor(id / {side}) * 10 AS y1").selectExpr("*", "x1 + 12 AS x2", "y1 + 12 AS y2")
    found = bx.overlaps(rows, rows)
    assert found.count() == side * side + 4 * side * (side - 1) + 4 * (side - 1) ** 2


def test_reading_order_of_many_images(spark):
    """Images follow one another in a task: lines and their medians start anew, and no image costs a call of its own."""
    rng, rows = random.Random(3), []
    for k in range(600):
        x, y, high = rng.randrange(100), rng.randrange(90), rng.choice([8, 20, 31])
        rows.append((rng.randrange(40), k, x, y, x + 10, y + high))
    want = {}
    for image in range(40):
        part = sorted(((y1 + y2) / 2, (x1 + x2) / 2, box, y2 - y1) for i, box, x1, y1, x2, y2 in rows if i == image)
        reach, line, current, out = max(12.0, 0.75 * statistics.median(p[3] for p in part)), 0, [], []
        for cy, cx, box, _ in part:
            if current and abs(cy - statistics.median(current)) > reach:
                line, current = line + 1, []
            current.append(cy)
            out.append((line, cx, box))
        want |= {(image, box): (line, place) for place, (line, _, box) in enumerate(sorted(out), 1)}
    found = bx.reading_order(spark.createDataFrame(rows, "image long, box long, x1 long, y1 long, x2 long, y2 long"))
    assert {(r.image, r.box): (r.line, r.place) for r in found.collect()} == want
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
