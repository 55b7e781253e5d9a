"""The steps of the label audit read their rows once and do no work over again."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import labels as lb
from gradeloom.operators import references as rf
from gradeloom.operators import vectors as vc


def counted(spark, df):
    """``df`` and an accumulator of how many of its rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(each, df.schema), seen


def test_unit_vectors_in_one_pass(spark):
    """The norm of a vector is computed once, not for each of its places."""
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [None, 2.0])], "path long, v array<double>")
    assert {r.path: r.v for r in rows.select("path", vc.l2_normalise("v").alias("v")).collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: [], 5: [None, 2.0]}
    places = 40_000
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(places)), lambda x: x + F.rand(5) * 0 + 0.0).alias("v"))
    began = time.monotonic()
    assert long.select(F.size(F.filter(vc.l2_normalise("v"), lambda x: x > 0)).alias("n")).first().n == places
    assert time.monotonic() - began < 10


def test_features_are_read_once(spark):
    rng = random.Random(4)
    rows = [(k, k % 3, k % 2, k % 4 // 2, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)]
    df, seen = counted(spark, spark.createDataFrame(rows, "path long, group_id long, kind int, grade int, v array<double>"))
    assert rf.group_excluded_knn(df, "v").count() == 60
    assert seen.value == 60


def test_queue_reads_its_rows_once(spark):
    rows = [(k, k % 4, k * 37 % 101 / 101, 2 if k % 3 else 9) for k in range(500)]
    df, seen = counted(spark, spark.createDataFrame(rows, "path long, class_id long, p_grade double, priority int").repartition(4))
    got = [(r.class_id, r.p_grade, r.path, r.number, r.page) for r in lb.review_queue(df, 2, 20).collect()]
    want = []
    for c in range(4):
        mine = sorted((p, path) for path, of, p, priority in rows if of == c and priority == 2)
        want += [(c, p, path, n, (n + 19) // 20) for n, (p, path) in enumerate(mine, 1)]
    assert sorted(got) == sorted(want)
    assert seen.value == 500


def test_stability_without_windows(spark):
    """Shares of views that vote as their model, with nulls as an average skips them, without a second sort of all views."""
    rng = random.Random(9)
    value = lambda: rng.choice([None, *[rng.random() for _ in range(5)]])
    views = [(path, m, v, value(), value(), value()) for path in range(80) for m in range(3) for v in range(4)]
    views += [(path, 0, v, *[None if path % 2 else 0.7] * 3) for path in (90, 91) for v in range(2)]
    pred = spark.createDataFrame(views, "path long, model int, view int, k1 double, g0 double, g1 double")
    labels = pred.select("path", (F.col("path") % 4).alias("class_id")).distinct()
    out = lb.oof_summary(pred, labels)
    both = lambda a, b: False if a is False or b is False else None if a is None or b is None else True
    same = lambda x, mean: None if x is None or mean is None else (x > 0.5) == (mean > 0.5)
    for r in out.collect():
        stable = []
        for m in range(3):
            mine = [(k, g0 if r.class_id < 2 else g1) for path, model, _, k, g0, g1 in views if path == r.path and model == m]
            mean = [sum(known) / len(known) if (known := [x for x in side if x is not None]) else None for side in zip(*mine, strict=True)] if mine else []
            votes = [s for k, g in mine if (s := both(same(k, mean[0]), same(g, mean[1]))) is not None]
            stable += [sum(votes) / len(votes)] if votes else []
        assert r.stability == (pytest.approx(min(stable)) if stable else None)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
