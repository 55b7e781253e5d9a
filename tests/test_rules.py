"""Expected values of the rules, counted by hand, and errors that the operators must raise."""

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import geometry as gm
from gradeloom.operators import datasets as ds
from gradeloom.operators import inspections as ins
from gradeloom.operators import records as rc
from gradeloom.operators.labels import small_loss_select
from gradeloom.operators.ranking import beside_group, numbered
from gradeloom.streaming.stateless import score_each_batch


def test_good_and_bad_predictions(spark):
    rows = spark.createDataFrame([(1, 0, 0.63, 0.3, 0.1, 0.5, 0.9), (2, 3, 0.54, 0.6, 0.2, 0.9, 0.8)], "path long, pred int, conf double, k1 double, g0 double, g1 double, detector double")
    good, bad = sorted(rc.prediction_to_inspection(rows).collect(), key=lambda r: r.path)
    assert (good.model_grade, good.defects, good.variety) == ("A", [], "kind 0")
    assert [round(x, 6) for x in (good.color_score, good.integrity_score, good.shape_score, good.size_score, good.defect_score, good.model_score)] == [70, 90, 90, 90, 90, 90]
    assert bad.model_grade == "C" and [d.severity for d in bad.defects] == ["moderate"] and bad.defects[0].confidence == pytest.approx(0.9)
    assert [round(x, 6) for x in (bad.color_score, bad.integrity_score, bad.shape_score, bad.defect_score)] == [60, 90, 10, 10]
    assert bad.model_reason == "model: class 3; kind 60.0%, grade 90.0%, joint 54.0%"


def test_validation_splits_and_fills(spark):
    scores = ", ".join(f"{c} double" for c in ins.SCORES)
    one = (90.0,) * 5
    rows = [(1, *one, None, 2.0, None, None), (2, *one[:4], 101.0, 0.5, 2.0, "A", None), (3, *one, 1.5, 0.0, "D", [("rot", None, "awful", 2.0)]), (4, None, *one[:4], None, None, None, [("rot", "Rot", None, None)]), (5, *one, 1.0, None, "B", [("rot", "Rot", None, None)])]
    df = spark.createDataFrame(rows, f"id long, {scores}, confidence double, length double, model_grade string, defects array<struct<type:string,name:string,severity:string,confidence:double>>")
    valid, rejects = ins.validate(df)
    got = {r.id: r for r in valid.collect()}
    assert set(got) == {1, 5} and got[1].confidence == 0.95 and got[1].defects == [] and tuple(got[5].defects[0]) == ("rot", "Rot", "mild", 0.8)
    why = {r.id: r.reasons for r in rejects.collect()}
    assert why[2] == ["defect_score outside 0..100"] and why[4] == ["color_score outside 0..100"]
    assert why[3] == ["length not above 0", "confidence outside 0..1", "model_grade unknown", "defect without type or name", "defect severity unknown", "defect confidence outside 0..1"]


def test_search_pages(spark):
    rows = spark.createDataFrame([(k, f"P-{k}", "Red" if k % 2 else "Green", k) for k in range(23)], "id long, sample_code string, variety string, s long").withColumn("ts", F.col("s").cast("timestamp"))
    got = ins.search(rows, text="red", page=2, limit=5).collect()
    assert [r.id for r in got] == [11, 9, 7, 5, 3] and {(r.total, r.pages) for r in got} == {(11, 3)}
    assert ins.search_totals(rows.filter("false"), 5).first()["pages"] == 0
    with pytest.raises(ValueError):
        ins.search(rows, limit=201)


def test_receipts_and_roles(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), (None, "x"), ("", None)], "p string, q string")
    found = ds.table_fingerprint(df, ["p", "q"]).first()
    receipt = {"columns": ["p", "q"], "rows": found.rows, "content": found.content}
    assert ds.verify_receipt(df, receipt) is df
    assert ds.table_fingerprint(df.repartition(3), ["p", "q"]).first() == found
    for other in ([("ab", ""), ("a", "b"), (None, "x"), ("", "")], [("a", "b"), ("a", "b"), (None, "x"), ("", None)]):
        with pytest.raises(ValueError):
            ds.verify_receipt(spark.createDataFrame(other, "p string, q string"), receipt)
    parts = ds.split_by_role(df.filter("p IS NOT NULL"), "p", ["a", "ab", "", "none"])
    assert {role: part.count() for role, part in parts.items()} == {"a": 1, "ab": 1, "": 1, "none": 0}
    with pytest.raises(ValueError):
        ds.split_by_role(df, "p", ["a", "ab", ""])
    folds = spark.createDataFrame([("a", 0), ("a", 1)], "p string, fold int")
    with pytest.raises(ValueError):
        ds.fold_complement(df, folds, "p", 0)


def test_numbers_and_sums_of_large_groups(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 10 < 8 THEN 'hot' WHEN id % 10 = 8 THEN NULL ELSE concat('k', id % 50) END AS key", "(id * 7919) % 5003 AS v").repartition(8)
    got = numbered(rows, "key", [F.col("v"), F.col("id")], "n").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.v, r.id)):
        by.setdefault(r.key, []).append(r.n)
    assert all(n == list(range(1, len(n) + 1)) for n in by.values()) and len(by["hot"]) == 4000 and len(by[None]) == 500
    sums = {(r.key, r.total) for r in beside_group(rows, "key", total=F.sum("v")).collect()}
    want = {}
    for r in rows.collect():
        want[r.key] = want.get(r.key, 0) + r.v
    assert sums == set(want.items())
    least = small_loss_select(rows.filter("key IS NOT NULL").withColumnsRenamed({"v": "loss", "id": "path"}), "key", 0.1)
    assert least.filter("key = 'hot'").count() == 400


def test_sql_functions(spark):
    gm.register_sql(spark)
    r = spark.sql("SELECT hamming64(5, 3) AS h, box_iou(0D, 0D, 10D, 10D, 5D, 0D, 15D, 10D) AS i, first_argmax(array(0.2D, 0.4D, 0.4D)) AS a, softmax_at(array(0.9D, 0.1D), 2D) AS s").first()
    assert (r.h, r.a) == (2, 1) and r.i == pytest.approx(1 / 3) and r.s == pytest.approx([0.75, 0.25])
    boxes = spark.sql("SELECT 0 AS ax1, 0 AS ay1, 10 AS ax2, 10 AS ay2, 5 AS bx1, 0 AS by1, 25 AS bx2, 10 AS by2")
    a, b = gm.box("a"), gm.box("b")
    got = boxes.select(gm.iou(a, b), gm.inside_smaller(a, b), gm.coverage(b, a), gm.area(b), gm.iou(gm.translate(a, 5, 0), b)).first()
    assert list(got) == pytest.approx([50 / 250, 0.5, 0.25, 200, 0.5])


def test_a_changed_rule_counts_for_later_records(spark, tmp_path):
    schema = ", ".join(f"{c} double" for c in ins.SCORES) + ", id long, model_grade string, model_score double, defects array<struct<type:string,severity:string>>"
    seen, rules = {}, [ins.Rule(), ins.Rule(a_min=95.0)]
    for n in range(2):
        spark.createDataFrame([(*(90.0,) * 5, n, None, None, [])], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = score_each_batch(stream, lambda s: rules[len(seen)], lambda df, n: seen.update({n: df.first()["grade"]})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert list(seen.values()) == ["A", "B"]


def test_written_tables_can_be_cleared(spark, tmp_path):
    from pathlib import Path

    from gradeloom.plans import durable

    folder = Path(durable.shared_folder(spark).removeprefix("file://"))
    durable._WRITTEN.clear()
    assert durable.written(spark.range(3)).count() == 3
    here = Path(durable._WRITTEN[-1].removeprefix("file://"))
    assert here.exists() and here.parent == folder
    assert durable.clear_written(spark) == 1 and not here.exists()
