from gradeloom.operators import inspections as ins

SCHEMA = "batch_id long, color_score double, integrity_score double, shape_score double, size_score double, defect_score double, processing_time double, severity string, defects array<struct<type:string,name:string,severity:string>>"


def graded(spark, *rows):
    return ins.score_inspections(spark.createDataFrame(rows, SCHEMA))


def test_score_and_grades(spark):
    rows = graded(
        spark,
        (1, 92.0, 95.0, 86.0, 88.0, 90.0, 1.0, "mild", []),
        (1, 95.0, 95.0, 95.0, 95.0, 95.0, 1.0, "severe", [("rot", "rot", "Severe")]),
        (1, 80.0, 80.0, 80.0, 80.0, 80.0, 1.0, "moderate", [("spot", "spot", "moderate")]),
        (2, 98.0, 98.0, 98.0, 98.0, 98.0, 1.0, "severe", [(None, None, "severe")]),
        (2, 10.0, 10.0, 10.0, 10.0, 10.0, None, None, None),
    ).collect()
    assert [(r.score, r.grade) for r in rows] == [(91.3, "A"), (95.0, "C"), (80.0, "B"), (98.0, "C"), (10.0, "C")]
    assert rows[1].reason == "severe defect: rot" and rows[3].reason == "severe defect: unknown"
    stats = {r.batch_id: r for r in ins.batch_stats(graded(spark, (1, 92.0, 95.0, 86.0, 88.0, 90.0, 1.0, "mild", []))).collect()}
    assert stats[1].total == 1 and stats[1].n_a == 1 and stats[1].pct_c == 0.0


def test_empty_weights_fall_back(spark):
    row = (1, 92.0, 95.0, 86.0, 88.0, 90.0, 1.0, "mild", [])
    rule = ins.Rule(weights=(None,) * 5, a_min=None, b_min=None)
    assert ins.score_inspections(spark.createDataFrame([row], SCHEMA), rule).first().score == 91.3
