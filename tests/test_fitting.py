"""Fitting, sources and joins with hot keys, on small tables."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gradeloom.operators import fitting as ft
from gradeloom.operators.hot_keys import look_up
from gradeloom.sources.manifest import publish_dataset, read_manifest


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for n in range(200):
        kind, grade = n % 2, n // 2 % 2
        data.append((n, [float(x) for x in rng.normal(0, 0.4, 3) + [2 * kind, 2 * grade, 0]], kind, grade, 1.0, 1.0, n // 4 % 3, kind * 2 + grade, 1.0))
    return spark.createDataFrame(data, "path long, v array<double>, kind int, grade int, kind_weight double, grade_weight double, fold int, class_id int, weight double").withColumn("features", array_to_vector("v"))


def test_out_of_fold_predictions_and_choice(rows):
    good, bad = LogisticRegression(maxIter=20, regParam=0.01), LogisticRegression(maxIter=20, regParam=50.0, elasticNetParam=1.0)
    out = ft.oof_predict(rows, 3, good)
    assert out.count() == 200 and ft.class_scores(out)[1] > 0.95
    name, models, table = ft.grid_select(rows, [("bad", bad), ("good", good)], 3)
    assert name == "good" and set(models) == {"k1", "g0", "g1"} and table.count() == 2


def test_a_fold_does_not_see_its_labels(rows):
    other = rows.withColumn("kind", F.when(F.col("fold") == 0, 1 - F.col("kind")).otherwise(F.col("kind")))
    good = LogisticRegression(maxIter=20, regParam=0.01)
    one, two = ({r.path: r.k1 for r in ft.oof_predict(x, 3, good).filter("fold = 0").collect()} for x in (rows, other))
    assert one == pytest.approx(two)


def test_one_class_is_refused(rows):
    with pytest.raises(ValueError):
        ft.fit_hierarchical(rows.filter("kind = 0"), LogisticRegression())


def test_direct_model(rows):
    model = ft.fit_direct(rows, LogisticRegression(maxIter=30))
    assert model.transform(rows).filter("prediction = class_id").count() > 190


def test_whitened_components_have_unit_covariance(rows):
    got = np.array([r.v for r in ft.pca_whiten(rows, rows, "v", 2).collect()])
    assert np.allclose(np.cov(got.T, bias=True), np.eye(2), atol=1e-6)


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes("\ufeffpath,label\n a , 1\nb,2\n".encode())
    assert [tuple(r) for r in read_manifest(spark, str(path), ["path", "label"]).collect()] == [("a", "1"), ("b", "2")]
    with pytest.raises(ValueError, match="lacks other"):
        read_manifest(spark, str(path), ["other"])
    path.write_text("path,label\n")
    with pytest.raises(ValueError, match="no rows"):
        read_manifest(spark, str(path), ["path"])


def test_publish(spark, tmp_path):
    target = f"file://{tmp_path}/set"
    publish_dataset({"a": spark.range(3), "b": spark.range(2)}, target)
    assert spark.read.parquet(f"{target}/a").count() == 3 and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(FileExistsError):
        publish_dataset({"a": spark.range(3)}, target)
    with pytest.raises(ValueError):
        publish_dataset({"a": spark.range(3)}, f"{target}/a/new", [target])


def test_look_up_gives_the_rows_of_a_join(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id < 2000 THEN 0 WHEN id < 2010 THEN NULL ELSE id % 50 END AS k")
    table = rows.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("_n"), F.max("id").alias("top")).filter("k <> 7")
    got = sorted(map(tuple, look_up(rows, table, "k", 3000).select("id", "k", "top").collect()))
    assert got == sorted(map(tuple, rows.join(table, "k").select("id", "k", "top").collect())) and len(got) > 2000


def test_logistic_fit_is_the_optimum(rows):
    """The coefficients are where the penalised likelihood, written out in numpy, has its maximum."""
    table = rows.select("v", "kind", "grade").collect()
    x, y = np.array([r.v for r in table]), np.array([r.kind for r in table])
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(4)
    penalty = np.diag([0.01, 0.01, 0.01, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / len(x) + penalty, z.T @ (p - y) / len(x) + penalty @ w)
    models = ft.fit_hierarchical(rows, LogisticRegression(maxIter=60, regParam=0.01, standardization=False, tol=1e-9))
    found = [*models["k1"].coefficients.toArray(), models["k1"].intercept]
    assert found == pytest.approx(w.tolist(), abs=1e-4)
    out = {r.path: r.k1 for r in ft.score_hierarchical(models, rows).collect()}
    assert out[0] == pytest.approx(1 / (1 + np.exp(-z[0] @ w)), abs=1e-4)


def test_whitened_components_are_eigenvectors(rows):
    x = np.array([r.v for r in rows.orderBy("path").collect()])
    out = np.array([r.v for r in ft.pca_whiten(rows.select("path", "v"), rows.select("path", "v"), "v", 2).orderBy("path").collect()])
    scaled = (x - x.mean(0)) / x.std(0, ddof=1)
    _, vectors = np.linalg.eigh(np.cov(scaled.T))
    want = scaled @ vectors[:, ::-1][:, :2]
    want = want / want.std(0)
    for k in range(2):
        assert min(np.abs(out[:, k] - want[:, k]).max(), np.abs(out[:, k] + want[:, k]).max()) < 1e-6


def test_grid_over_seeds(rows):
    good, bad = LogisticRegression(maxIter=4, regParam=0.01), LogisticRegression(maxIter=4, regParam=50.0, elasticNetParam=1.0)
    name, table = ft.grid_over_seeds(rows.withColumn("grp", F.col("path") % 20), [("bad", bad), ("good", good)], 2, "grp", [1, 2])
    assert name == "good" and [(r.name, r.seeds) for r in table.orderBy("place").collect()] == [("bad", 2), ("good", 2)]


def test_temperature_is_the_best_of_a_dense_grid(spark):
    from gradeloom.operators import evaluation as ev

    rng = np.random.default_rng(8)
    k1, g0, g1 = rng.uniform(0.02, 0.98, (3, 400))
    kind = (rng.uniform(size=400) < k1 ** 2 / (k1 ** 2 + (1 - k1) ** 2)).astype(int)
    grade = (rng.uniform(size=400) < np.where(kind == 1, g1, g0)).astype(int)
    df = spark.createDataFrame([(n, "g", int(2 * k + g), float(a), float(b), float(c)) for n, (k, g, a, b, c) in enumerate(zip(kind, grade, k1, g0, g1))], "path long, group_id string, class_id int, k1 double, g0 double, g1 double")
    found = ev.fit_temperature(df)
    loss = lambda t, p, y: -np.log(np.where(y == 1, 1 / (1 + ((1 - p) / p) ** (1 / t)), 1 - 1 / (1 + ((1 - p) / p) ** (1 / t)))).mean()
    for name, p, y in (("kind", k1, kind), ("grade0", g0[kind == 0], grade[kind == 0]), ("grade1", g1[kind == 1], grade[kind == 1])):
        best = min(loss(t, p, y) for t in np.exp(np.linspace(np.log(0.05), np.log(10), 2000)))
        assert loss(found[name], p, y) <= best + 1e-4
