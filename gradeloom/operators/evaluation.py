"""Metrics of predictions, mixes of models, calibration and comparison of two models.

Rows have ``path``, ``group_id``, the true ``class_id`` (``kind * 2 + grade``) and probabilities. All metrics
of a table are sums over rows, so grids (of mixes, temperatures, biases) are rows times a short literal
list that partial aggregation folds before the shuffle.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.probability import FLOOR, JOINT, argmax, decompose, log_clipped, log_spaced, logit_bias, temperature
from gradeloom.operators.ranking import numbered
from gradeloom.plans.durable import written

CLASSES = range(4)


def judged(df: DataFrame) -> DataFrame:
    """Add the prediction, its confidence and what it gets right: ``pred, conf, right, kind_right, grade_right, nll``."""
    k = F.col("class_id").cast("int")
    own = F.when(k == 0, F.col("j0")).when(k == 1, F.col("j1")).when(k == 2, F.col("j2")).otherwise(F.col("j3"))
    kind = F.when(F.col("j2") + F.col("j3") > F.col("j0") + F.col("j1"), 1).otherwise(0)
    grade = F.when(F.when(k < 2, F.col("j1") > F.col("j0")).otherwise(F.col("j3") > F.col("j2")), 1).otherwise(0)
    df = df.withColumns({"pred": argmax(*JOINT), "conf": F.greatest(*JOINT)})
    return df.withColumns({"right": (F.col("pred") == k).cast("int"), "kind_right": (kind == F.floor(k / 2)).cast("int"), "grade_right": (grade == k % 2).cast("int"), "nll": -log_clipped(own)})


def confusion(df: DataFrame, predicted: str = "pred") -> DataFrame:
    """Dense ``truth, predicted, n``: one aggregate, then zeros for cells without rows."""
    cells = [F.count_if((F.col("class_id") == t) & (F.col(predicted) == p)).alias(f"c{t}{p}") for t in CLASSES for p in CLASSES]
    stack = ", ".join(f"{t}, {p}, c{t}{p}" for t in CLASSES for p in CLASSES)
    return df.agg(*cells).select(F.expr(f"stack(16, {stack}) as (truth, predicted, n)"))


def per_class_metrics(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class from a confusion table."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    one = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("class_id"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), hit.alias("t")), F.struct(F.col("predicted").alias("class_id"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("t")))).alias("x"))
    sums = one.groupBy("x.class_id").agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("_p"), F.sum("x.t").alias("_t"))
    out = sums.withColumns({"precision": F.col("_t") / F.greatest("_p", F.lit(1)), "recall": F.col("_t") / F.greatest("support", F.lit(1))})
    return out.select("class_id", "precision", "recall", (2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))).alias("f1"), "support")


def branch_metrics(df: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """All metrics for each value of ``keys`` (none: one row): two aggregates, first by group, then over groups.

    ``grade_accuracy`` reads the grade under the true kind; ``ece`` has equal bins of the confidence, the last one closed.
    """
    place = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1))
    sums = {"n": F.count(F.lit(1)), "right": F.sum("right"), "kind": F.sum("kind_right"), "grade": F.sum("grade_right"), "loss": F.sum("nll")}
    for c in CLASSES:
        sums |= {f"t{c}": F.count_if(F.col("class_id") == c), f"p{c}": F.count_if(F.col("pred") == c), f"h{c}": F.count_if((F.col("class_id") == c) & (F.col("pred") == c))}
    sums |= {f"e{b}": F.sum(F.when(place == b, F.col("right") - F.col("conf")).otherwise(0.0)) for b in range(bins)}
    groups = judged(df).groupBy(*keys, "group_id").agg(*[v.alias(f"_{k}") for k, v in sums.items()])
    total = groups.groupBy(*keys).agg(
        *[F.sum(f"_{k}").alias(f"_{k}") for k in sums],
        F.count(F.lit(1)).alias("groups"), F.avg(F.col("_right") / F.col("_n")).alias("group_accuracy"), F.min(F.col("_right") / F.col("_n")).alias("group_minimum"),
    )
    f1 = sum((2 * F.col(f"_h{c}") / F.greatest(F.col(f"_t{c}") + F.col(f"_p{c}"), F.lit(1)) for c in CLASSES), F.lit(0.0)) / len(CLASSES)
    share = lambda c: F.col(c) / F.col("_n")
    return total.select(
        *keys, F.col("_n").alias("samples"), "groups", share("_kind").alias("kind_accuracy"), share("_grade").alias("grade_accuracy"), share("_right").alias("accuracy"), f1.alias("macro_f1"),
        "group_accuracy", "group_minimum", share("_loss").alias("nll"), (sum((F.abs(f"_e{b}") for b in range(bins)), F.lit(0.0)) / F.col("_n")).alias("ece"),
    )


def ece(df: DataFrame, bins: int = 15) -> DataFrame:
    """Rows, accuracy, confidence and gap of each bin of the confidence that holds rows."""
    place = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).alias("bin")
    out = judged(df).groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.avg("right").alias("accuracy"), F.avg("conf").alias("confidence"))
    return out.withColumn("gap", F.abs(F.col("accuracy") - F.col("confidence")))


def weighted_binary_metrics(df: DataFrame, keys: list[str], truth: Column, predicted: Column, weight: Column) -> DataFrame:
    """Weighted accuracy and macro F1 of two classes."""
    cell = {(t, p): F.sum(F.when((truth == t) & (predicted == p), weight).otherwise(0.0)).alias(f"_{t}{p}") for t in (0, 1) for p in (0, 1)}
    out = df.groupBy(*keys).agg(*cell.values())
    c = {k: F.col(f"_{k[0]}{k[1]}") for k in cell}
    total = c[0, 0] + c[0, 1] + c[1, 0] + c[1, 1]
    f1 = lambda x: 2 * c[x, x] / F.greatest(2 * c[x, x] + c[0, 1] + c[1, 0], F.lit(1e-12))
    return out.select(*keys, ((c[0, 0] + c[1, 1]) / F.greatest(total, F.lit(1e-12))).alias("accuracy"), ((f1(0) + f1(1)) / 2).alias("macro_f1"))


def mix_models(pred: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the joint probabilities over the models of long rows (``path, model, j0..j3``), split into kind and grades.

    Models without a weight are left out; the mean is over the models that a path has.
    """
    w = F.coalesce(*[F.when(F.col("model") == m, F.lit(float(x))) for m, x in weights.items()], F.lit(0.0))
    rows = pred.withColumn("_w", w).filter("_w > 0")
    mixed = rows.groupBy("path").agg(*[(F.sum(F.col("_w") * F.col(j)) / F.sum("_w")).alias(j) for j in JOINT])
    return decompose(mixed)


def score_mixes(wide: DataFrame, models: list[str], grid: list[float]) -> DataFrame:
    """Metrics of every model, every weighted pair and the mean of all (three or more), best first.

    ``wide`` has the joint probabilities of model ``m`` in ``m_j0 .. m_j3``; the mixes are a literal list on every row.
    """
    mixes = {m: {m: 1.0} for m in models}
    for i, a in enumerate(models):
        for b in models[i + 1 :]:
            mixes |= {f"{a}:{x}+{b}:{round(1 - x, 6)}": {a: x, b: 1 - x} for x in grid}
    if len(models) > 2:
        mixes["mean"] = {m: 1 / len(models) for m in models}
    made = [F.struct(F.lit(name).alias("mix"), F.lit(n).alias("place"), *[sum((F.lit(float(x)) * F.col(f"{m}_{j}") for m, x in mix.items()), F.lit(0.0)).alias(j) for j in JOINT]) for n, (name, mix) in enumerate(mixes.items())]
    rows = wide.select("path", "group_id", "class_id", F.explode(F.array(*made)).alias("x")).select("path", "group_id", "class_id", "x.*")
    out = branch_metrics(rows, ["mix", "place"])
    return out.orderBy(F.desc(0.5 * F.col("macro_f1") + 0.5 * F.col("group_accuracy")), F.desc("accuracy"), "nll", "place")


def temperature_losses(df: DataFrame, grid: list[float]) -> DataFrame:
    """Mean NLL of the kind and of the grade under each true kind for every temperature: ``branch, temperature, nll``."""
    k = F.col("class_id").cast("int")
    kind, grade = F.floor(k / 2), k % 2
    branches = F.array(F.struct(F.lit("kind").alias("branch"), F.col("k1").alias("p"), kind.alias("y")), F.struct(F.concat(F.lit("grade"), kind.cast("string")).alias("branch"), F.when(kind == 0, F.col("g0")).otherwise(F.col("g1")).alias("p"), grade.cast("long").alias("y")))
    rows = df.select(F.explode(branches).alias("b")).select("b.*", F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("temperature"))
    p = temperature(F.col("p"), F.col("temperature"))
    return rows.groupBy("branch", "temperature").agg(F.avg(-log_clipped(F.when(F.col("y") == 1, p).otherwise(1 - p))).alias("nll"))


def fit_temperature(df: DataFrame, low: float = 0.05, high: float = 10.0, n: int = 25) -> dict[str, float]:
    """The best temperature of each branch: a coarse grid over the rows, then a finer one around each best. 1 always competes."""
    coarse = log_spaced(low, high, n)
    best = {r.branch: r.t for r in temperature_losses(df, coarse).groupBy("branch").agg(F.min_by("temperature", F.struct("nll", "temperature")).alias("t")).collect()}
    step = (high / low) ** (1 / (n - 1))
    fine = sorted({t for b in best.values() for t in log_spaced(max(low, b / step), min(high, b * step), n)})
    return {r.branch: r.t for r in temperature_losses(df, fine).groupBy("branch").agg(F.min_by("temperature", F.struct("nll", "temperature")).alias("t")).collect()}


def apply_temperature(df: DataFrame, kind: float, grade0: float, grade1: float) -> DataFrame:
    return df.withColumns({c: temperature(F.col(c), F.lit(float(t))) for c, t in (("k1", kind), ("g0", grade0), ("g1", grade1))})


def branch_hybrid(kind: DataFrame, grade0: DataFrame, grade1: DataFrame) -> DataFrame:
    """Kind of one model, grade under kind 0 of a second, under kind 1 of a third, by ``path``."""
    return kind.select("path", "group_id", "class_id", "k1").join(grade0.select("path", "g0"), "path").join(grade1.select("path", "g1"), "path")


def sweep_bias(df: DataFrame, grid: list[float], p: str, truth: Column, weight: Column) -> DataFrame:
    """Weighted metrics for each logit bias, best first (macro F1, accuracy, smaller place)."""
    made = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(float(b)).alias("bias")) for n, b in enumerate(grid)])
    rows = df.select(truth.alias("_t"), weight.alias("_w"), F.col(p).alias("_p"), F.explode(made).alias("x")).select("_t", "_w", "_p", "x.*")
    predicted = (logit_bias(F.col("_p"), F.col("bias")) > 0.5).cast("int")
    return weighted_binary_metrics(rows, ["place", "bias"], F.col("_t"), predicted, F.col("_w")).orderBy(F.desc("macro_f1"), F.desc("accuracy"), "place")


def group_bootstrap(df: DataFrame, right_a: Column, right_b: Column, repeats: int, seed: int) -> DataFrame:
    """Accuracy difference of two models with its 95% interval and tail share, resampling whole groups.

    Only the counts of each group are resampled; the draws are ``repeats`` times the number of groups.
    """
    counts = df.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum(right_a.cast("int") - right_b.cast("int")).alias("d"))
    ranked = written(numbered(counts.withColumn("_all", F.lit(0)), "_all", [F.col("group_id")], "place").withColumn("place", F.col("place") - 1).drop("_all"))
    size = ranked.count()
    draws = df.sparkSession.range(repeats * size).select(F.floor(F.col("id") / max(size, 1)).alias("repeat"), F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(max(size, 1))).cast("int").alias("place"))
    one = draws.join(ranked.hint("shuffle_hash"), "place").groupBy("repeat").agg((F.sum("d") / F.sum("n")).alias("x"))
    low = 2 * F.least(F.avg((F.col("x") <= 0).cast("double")), F.avg((F.col("x") >= 0).cast("double")))
    spread = one.agg(F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"), F.least(F.lit(1.0), low).alias("tail"))
    return ranked.agg((F.sum("d") / F.sum("n")).alias("difference")).crossJoin(spread)


def binomial_tail(b: int, c: int) -> float:
    """Exact two-sided binomial p of ``b`` against ``c``; terms too small to change the sum end it."""
    n, m = b + c, min(b, c)
    if n == 0:
        return 1.0
    total = 0.0
    for i in range(m, -1, -1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2))
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, 2 * total)


def mcnemar(df: DataFrame, right_a: Column, right_b: Column) -> DataFrame:
    """The four counts of right and wrong of two models and the exact p; the p is worked out on the one row of counts."""

    @F.pandas_udf("double")
    def tail(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(x), int(y)) for x, y in zip(b, c, strict=True)])

    counts = df.agg(F.count_if(right_a & right_b).alias("both"), F.count_if(right_a & ~right_b).alias("only_a"), F.count_if(~right_a & right_b).alias("only_b"), F.count_if(~right_a & ~right_b).alias("neither"))
    return counts.withColumn("p", tail("only_a", "only_b"))


def prediction_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """Truth, both predictions, whether each is right and whether they differ, by ``path``."""
    one, two = judged(a), judged(b)
    both = one.select("path", "class_id", F.col("pred").alias("pred_a"), F.col("conf").alias("conf_a")).join(two.select("path", F.col("pred").alias("pred_b"), F.col("conf").alias("conf_b")), "path")
    return both.withColumns({"right_a": F.col("pred_a") == F.col("class_id"), "right_b": F.col("pred_b") == F.col("class_id"), "changed": F.col("pred_a") != F.col("pred_b")})


def ordered_probability(df: DataFrame, classes: str, values: str, order: list[int]) -> DataFrame:
    """Add ``ordered``: the values in the given order of classes, absent ones 0, scaled to sum 1."""
    by = F.map_from_arrays(classes, values)
    raw = F.array(*[F.coalesce(F.try_element_at(by, F.lit(c)), F.lit(0.0)) for c in order])
    return df.withColumn("ordered", F.transform(raw, lambda v: v / F.greatest(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x), F.lit(FLOOR))))
