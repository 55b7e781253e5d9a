"""Fitting on Spark: models by level, out-of-fold predictions, choice from a grid, whitening.

Rows have ``path``, a vector column ``features``, ``kind``, ``grade``, ``kind_weight`` and ``grade_weight``. Any
``pyspark.ml`` classifier that gives probabilities and takes weights is an estimator.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.base import Estimator, Model
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.probability import JOINT, argmax, joint
from gradeloom.operators.vectors import place_statistics

#: model -> its label, its weight and the rows that it learns from.
LEVELS = {"k1": ("kind", "kind_weight", "true"), "g0": ("grade", "grade_weight", "kind = 0"), "g1": ("grade", "grade_weight", "kind = 1")}


def fit_hierarchical(df: DataFrame, estimator: Estimator) -> dict[str, Model]:
    """One model of the kind and one of the grade under each kind, from rows of positive weight; both classes must be there."""
    models = {}
    for name, (label, weight, rows) in LEVELS.items():
        part = df.filter(rows).filter(F.col(weight) > 0)
        if part.agg(F.countDistinct(label)).first()[0] != 2:
            raise ValueError(f"{name} needs rows of both classes")
        models[name] = estimator.copy({estimator.getParam("labelCol"): label, estimator.getParam("weightCol"): weight}).fit(part.withColumn(label, F.col(label).cast("double")))
    return models


def score_hierarchical(models: dict[str, Model], df: DataFrame) -> DataFrame:
    """Add ``k1, g0, g1``: the probability of class 1 by each model."""
    for name, model in models.items():
        scored = model.transform(df).withColumn(name, F.get(vector_to_array("probability"), 1))
        df = scored.select(*df.columns, name)
    return df


def fit_direct(df: DataFrame, estimator: Estimator, label: str = "class_id", weight: str = "weight") -> Model:
    """One model of all classes, from rows of positive weight."""
    return estimator.copy({estimator.getParam("labelCol"): label, estimator.getParam("weightCol"): weight}).fit(df.filter(F.col(weight) > 0).withColumn(label, F.col(label).cast("double")))


def oof_predict(df: DataFrame, folds: int, estimator: Estimator, fold: str = "fold") -> DataFrame:
    """``k1, g0, g1`` of every row with positive kind weight, from models that saw no row of its fold."""
    parts = []
    for n in range(folds):
        models = fit_hierarchical(df.filter(F.col(fold) != n), estimator)
        parts.append(score_hierarchical(models, df.filter((F.col(fold) == n) & (F.col("kind_weight") > 0))))
    return reduce(DataFrame.unionByName, parts)


def class_scores(pred: DataFrame) -> tuple[float, float]:
    """Macro F1 over the classes that occur as label, and accuracy, of predictions ``k1, g0, g1``."""
    cells = joint(pred).select((F.col("kind") * 2 + F.col("grade")).cast("int").alias("y"), argmax(*JOINT).alias("p")).groupBy("y", "p").count().collect()  # 16 cells at most
    total = sum(c["count"] for c in cells)
    right = {c.y: c["count"] for c in cells if c.y == c.p}
    f1 = [2 * right.get(k, 0) / sum(c["count"] * ((c.y == k) + (c.p == k)) for c in cells) for k in {c.y for c in cells}]
    return (sum(f1) / len(f1), sum(right.values()) / total) if total else (0.0, 0.0)


def grid_select(df: DataFrame, grid: list[tuple[str, Estimator]], folds: int, fold: str = "fold", eligible: str = "true") -> tuple[str, dict[str, Model], DataFrame]:
    """The best candidate by macro F1, accuracy and place, its fit on all rows, and the table of scores.

    Rows that are not ``eligible`` take no part in the choice and join the last fit only.
    """
    some = df.filter(eligible)
    scores = [(place, name, *class_scores(oof_predict(some, folds, e, fold))) for place, (name, e) in enumerate(grid)]
    best = max(scores, key=lambda s: (s[2], s[3], -s[0]))
    return best[1], fit_hierarchical(df, grid[best[0]][1]), df.sparkSession.createDataFrame(scores, "place int, name string, macro_f1 double, accuracy double")


def grid_over_seeds(df: DataFrame, grid: list[tuple[str, Estimator]], folds: int, group: str, seeds: list[int]) -> tuple[str, DataFrame]:
    """The best candidate by mean macro F1, mean accuracy and place over several seeded deals of groups into folds, and the table ``place, name, seeds, macro_f1, accuracy``."""
    scores: dict[int, list[tuple[float, float]]] = {}
    for seed in seeds:
        turn = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
        rows = df.withColumn("_fold", turn)
        for place, (_, estimator) in enumerate(grid):
            scores.setdefault(place, []).append(class_scores(oof_predict(rows, folds, estimator, "_fold")))
    table = [(place, grid[place][0], len(found), sum(f for f, _ in found) / len(found), sum(a for _, a in found) / len(found)) for place, found in scores.items()]
    best = max(table, key=lambda s: (s[3], s[4], -s[0]))
    return best[1], df.sparkSession.createDataFrame(table, "place int, name string, seeds int, macro_f1 double, accuracy double")


def pca_whiten(fit: DataFrame, apply: DataFrame, v: str, k: int) -> DataFrame:
    """``apply`` with the array ``v`` standardised, projected on ``k`` components and scaled to unit variance, all by ``fit``."""
    vectors = fit.select(array_to_vector(v).alias("_raw"))
    scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(vectors)
    pca = PCA(k=k, inputCol="_scaled", outputCol="_pca").fit(scaler.transform(vectors))
    project = lambda df: pca.transform(scaler.transform(df.withColumn("_raw", array_to_vector(v)))).withColumn(v, vector_to_array("_pca")).drop("_raw", "_scaled", "_pca")
    sd = place_statistics(project(fit.select(v)), v).agg(F.array_sort(F.collect_list(F.struct("place", "sd"))).alias("_sd"))
    rows = project(apply).crossJoin(F.broadcast(sd))  # one row with k entries
    return rows.withColumn(v, F.zip_with(v, "_sd", lambda x, s: F.when(s["sd"] > 1e-12, x / s["sd"]).otherwise(0.0))).drop("_sd")
