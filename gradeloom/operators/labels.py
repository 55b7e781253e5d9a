"""Label audit, relabelling, pairs of views and weights of training rows.

Out-of-fold rows are long (``path, model, view, k1, g0, g1``); ladders of decisions are one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.operators.hot_keys import look_up
from gradeloom.operators.ranking import beside_group, numbered
from gradeloom.plans.durable import written

#: Fixed limits of the audit ladder.
OPPOSITE, STABLE, SURE_KIND, AMBIGUOUS, MARGIN = 0.80, 0.80, 0.90, (0.40, 0.60), 0.005


def oof_summary(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each labelled path from its models' views.

    Means over views, then over models; ``kind_agreement`` and ``grade_agreement``: share of models that vote
    as the mean does; ``stability``: share of views that vote as their model, the least over models;
    ``all_opposite``: every model's grade contradicts the label. The grade is read under the labelled kind.
    """
    rows = pred.join(labels.select("path", "class_id").hint("merge"), "path")
    rows = rows.withColumn("g", F.when(F.col("class_id") < 2, F.col("g0")).otherwise(F.col("g1")))
    # the share of views that vote so, for each vote a model can have: one pass, its own vote is picked once the means are known
    share_of = lambda k, g: F.avg((((F.col("k1") > 0.5) == k) & ((F.col("g") > 0.5) == g)).cast("double"))
    shares = {f"_{k:d}{g:d}": share_of(k, g) for k in (False, True) for g in (False, True)}
    models = rows.groupBy("path", "class_id", "model").agg(F.avg("k1").alias("mk"), F.avg("g").alias("mg"), *[s.alias(n) for n, s in shares.items()])
    by_grade = lambda k: F.when(~(F.col("mg") > 0.5), F.col(f"_{k}0")).otherwise(F.col(f"_{k}1"))
    models = models.withColumn("st", F.when(~(F.col("mk") > 0.5), by_grade(0)).otherwise(by_grade(1)))
    kind, grade = F.floor(F.col("class_id") / 2), F.col("class_id") % 2
    votes = lambda c: F.count_if(F.col(c) > 0.5)
    out = models.groupBy("path", "class_id").agg(
        F.avg("mk").alias("p_kind"), F.avg("mg").alias("p_grade"), F.min("st").alias("stability"), F.count(F.lit(1)).alias("_n"), votes("mk").alias("_k"), votes("mg").alias("_g"),
        F.min(((F.col("mk") > 0.5).cast("int") != kind).cast("int")).alias("kind_opposite"), F.min(((F.col("mg") > 0.5).cast("int") != grade).cast("int")).alias("grade_opposite"),
    )
    share = lambda c, p: F.when(F.col(p) > 0.5, F.col(c)).otherwise(F.col("_n") - F.col(c)) / F.col("_n")
    return out.withColumns({"kind_agreement": share("_k", "p_kind"), "grade_agreement": share("_g", "p_grade")}).drop("_n", "_k", "_g")


def audit_labels(df: DataFrame) -> DataFrame:
    """Add ``status, priority, kind_weight, grade_weight`` to the rows of ``oof_summary`` with ``knn_grade`` and ``knn_margin``.

    The first rule that holds counts: contradicted kind, strictly contradicted grade, doubtful grade, other grade, agreed.
    """
    kind, grade = F.floor(F.col("class_id") / 2), F.col("class_id") % 2
    own_kind = F.when(kind == 1, F.col("p_kind")).otherwise(1 - F.col("p_kind"))
    own_grade = F.when(grade == 1, F.col("p_grade")).otherwise(1 - F.col("p_grade"))
    steady = F.col("stability") >= STABLE
    wrong_kind = (F.col("kind_opposite") == 1) & (own_kind <= 1 - OPPOSITE) & steady
    strict = (F.col("grade_opposite") == 1) & (1 - own_grade >= OPPOSITE) & steady & (own_kind >= SURE_KIND) & (F.col("kind_agreement") == 1) & (F.col("knn_grade") != grade) & (F.col("knn_margin") >= MARGIN)
    doubtful = F.col("p_grade").between(*AMBIGUOUS)
    other = (F.col("p_grade") > 0.5).cast("int") != grade
    ladder = [(wrong_kind, "kind_contradiction", 1, 0.0, 0.0), (strict, "grade_contradiction", 1, 0.0, 0.0), (doubtful, "ambiguous", 3, 1.0, 0.0), (other, "grade_differs", 2, 1.0, 0.0)]

    def pick(n: int, default) -> Column:
        out = F.lit(default)
        for step in reversed(ladder):
            out = F.when(step[0], F.lit(step[n])).otherwise(out)
        return out

    return df.withColumns({"status": pick(1, "agreed"), "priority": pick(2, 9), "kind_weight": pick(3, 1.0), "grade_weight": pick(4, 1.0)})


def relabel_ambiguous(df: DataFrame) -> DataFrame:
    """Add ``new_class`` and ``new_weight``: a doubtful grade that all models and views oppose is flipped."""
    grade = F.col("class_id") % 2
    doubtful, other = F.col("p_grade").between(*AMBIGUOUS), (F.col("p_grade") > 0.5).cast("int") != grade
    agreed = F.col("grade_agreement") == 1
    own_kind = F.greatest(F.col("p_kind"), 1 - F.col("p_kind"))
    flip = doubtful & other & agreed & (F.col("stability") >= 0.75) & (own_kind >= 0.60)
    weight = F.when(flip, 0.65).when(doubtful & other, 0.0).when(other & agreed, 0.30).otherwise(1.0)
    return df.withColumns({"new_class": F.when(flip, F.col("class_id") - grade + (1 - grade)).otherwise(F.col("class_id")), "new_weight": weight})


def pseudo_relabel(rows: DataFrame, audit: DataFrame, least: float, weight: float) -> DataFrame:
    """Flip the grade on all rows of each pair whose canonical row contradicts strictly with at least ``least``."""
    grade = F.col("class_id") % 2
    own = F.when(grade == 1, F.col("p_grade")).otherwise(1 - F.col("p_grade"))
    flip = audit.filter((F.col("status") == "grade_contradiction") & (1 - own >= least)).select(F.col("path").alias("pair_id")).distinct().withColumn("_flip", F.lit(True))
    out = rows.join(flip.hint("merge"), "pair_id", "left").withColumn("flipped", F.coalesce("_flip", F.lit(False))).drop("_flip")
    new = F.when(F.col("flipped"), F.col("class_id") - grade + (1 - grade)).otherwise(F.col("class_id"))
    return out.withColumns({"new_class": new, "weight": F.when(F.col("flipped"), weight).otherwise(1.0), "target": F.when(F.col("flipped"), F.when(new % 2 == 1, 0.96).otherwise(0.04)).otherwise((new % 2).cast("double"))})


def restore_zero_weight(df: DataFrame) -> DataFrame:
    """Rows with grade weight 0 get their label's one-hot target back and lose the consistency mark."""
    none = F.col("grade_weight") == 0
    return df.withColumns({"target": F.when(none, (F.col("class_id") % 2).cast("double")).otherwise(F.col("target")), "consistent": ~none & F.col("consistent")})


def pseudo_targets(df: DataFrame, chosen: Column, weight: float = 0.20) -> DataFrame:
    """Chosen rows take their out-of-fold grade as a soft target of low weight and are never consistent.

    ``violation`` marks a chosen row whose target does not contradict its label.
    """
    grade = F.col("class_id") % 2
    target = F.when(chosen, F.col("p_grade")).otherwise(grade.cast("double"))
    same = (F.col("p_grade") > 0.5).cast("int") == grade
    return df.withColumns({"target": target, "weight": F.when(chosen, weight).otherwise(1.0), "consistent": ~chosen, "violation": chosen & same})


def build_targets(rows: DataFrame, decisions: DataFrame, statuses: list[str]) -> DataFrame:
    """Rows after their decisions, with the grade of the class read again from the soft ``target``.

    ``consistent``: a decided row has one of ``statuses`` and a positive weight, another one a weight of 0.999 or more.
    """
    marks = decisions.groupBy("path").agg(F.min("target").alias("_target"), F.min("status").alias("_status"))
    out = apply_decisions(rows, decisions).join(marks.hint("merge"), "path", "left")
    out = out.withColumn("target", F.when(F.col("decided"), F.coalesce("_target", "target")).otherwise(F.col("target")))
    hard = F.coalesce((F.col("target") > 0.5).cast("int"), F.col("class_id") % 2)
    sure = F.when(F.col("decided"), F.col("_status").isin(statuses) & (F.col("weight") > 0)).otherwise(F.col("weight") >= 0.999)
    return out.withColumns({"class_id": F.floor(F.col("class_id") / 2) * 2 + hard, "consistent": F.coalesce(sure, F.lit(False))}).drop("_target", "_status")


def run_summary(df: DataFrame, group: str, review: Column, top: int = 20) -> DataFrame:
    """Rows and rows for review of each group, and the paths of the first ``top`` of these, as a report; the row of a null group has the totals."""
    df = df.filter(F.col(group).isNotNull())
    total = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(review).alias("n_review"))
    whole = df.filter(review).select("path").orderBy("path").limit(top).agg(F.array_sort(F.collect_list("path")).alias("review"))
    total = total.crossJoin(F.broadcast(whole)).select(F.lit(None).cast(df.schema[group].dataType).alias(group), "*")  # one row each
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(review).alias("n_review"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("path"))
    first = df.filter(review).select(group, "path").withColumn("_n", place).filter(F.col("_n") <= top)
    lists = first.groupBy(group).agg(F.array_sort(F.collect_list("path")).alias("review"))
    return counts.join(lists.hint("merge"), group, "left").withColumn("review", F.coalesce("review", F.array().cast("array<long>"))).unionByName(total)


def initial_reliability(df: DataFrame) -> DataFrame:
    """Add ``reliable``: the predicted class is the label, views are stable and the label's probability is at least 0.52."""
    kind, grade = F.floor(F.col("class_id") / 2), F.col("class_id") % 2
    same = ((F.col("p_kind") > 0.5).cast("int") == kind) & ((F.col("p_grade") > 0.5).cast("int") == grade)
    own = F.when(grade == 1, F.col("p_grade")).otherwise(1 - F.col("p_grade"))
    return df.withColumn("reliable", same & (F.col("stability") >= 0.8) & (own >= 0.52))


def training_safety(df: DataFrame, matches: DataFrame) -> DataFrame:
    """Add ``leak_safe, trainable, weight`` by matches (``path, exact``) and the row's ``status``."""
    hit = matches.groupBy("path").agg(F.max(F.col("exact").cast("int")).alias("_exact"))
    out = df.join(hit.hint("merge"), "path", "left")
    free = F.col("_exact").isNull() & (F.col("status") != "kind_contradiction")
    weight = F.when(~free, 0.0).when(F.col("status") == "agreed", 0.5).otherwise(0.25)
    return out.withColumns({"leak_safe": F.coalesce(F.col("_exact"), F.lit(0)) == 0, "trainable": free, "weight": weight}).drop("_exact")


def consensus_pseudo_labels(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Labels on which two teachers (``path, pred, conf``) agree with enough confidence, and their weight."""
    both = a.select("path", "pred", "conf").join(b.select("path", F.col("pred").alias("_p"), F.col("conf").alias("_c")).hint("merge"), "path")
    least = F.least("conf", "_c")
    kept = both.filter((F.col("pred") == F.col("_p")) & (least >= threshold))
    return kept.select("path", "pred", (0.5 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (least - threshold) / (1 - threshold)))).alias("weight"))


def soft_confidence_weight(df: DataFrame) -> DataFrame:
    """Weights by each class's own threshold: 1 above it, a Gauss tail below it, 0 under 0.50.

    ``df`` has ``path, pred, conf``; the threshold is the mean confidence times the class's mean over the best class's, within 0.62 and 0.92.
    """
    df = df.filter(F.col("pred").isNotNull())
    by = df.groupBy("pred").agg(F.avg("conf").alias("_class"), F.count(F.lit(1)).alias("_n"))
    best = by.agg(F.max("_class").alias("_best"), F.sum("_n").alias("_rows"))
    whole = df.agg(F.avg("conf").alias("_mu"), F.greatest(F.stddev_pop("conf"), F.lit(0.06)).alias("_sd"))
    few = written(by.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(whole)))  # one row each
    number = few.agg(F.max("_rows")).first()[0] or 0
    rows = look_up(df, few.drop("_rows"), "pred", number)
    limit = F.greatest(F.lit(0.62), F.least(F.lit(0.92), F.col("_mu") * F.col("_class") / F.col("_best")))
    gap = F.col("conf") - F.col("_mu")
    tail = F.when(gap >= 0, 1.0).otherwise(0.22 * F.exp(-(gap * gap) / (2 * F.col("_sd") * F.col("_sd"))))
    return rows.withColumn("weight", F.when(F.col("conf") < 0.5, 0.0).when(F.col("conf") >= limit, 1.0).otherwise(tail)).drop("_class", "_best", "_mu", "_sd")


def apply_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Class and weight by decision, else by row, else 1; a decision counts only for one training row and once."""
    legal = decisions.join(rows.filter("split = 'train'").select("path").hint("merge"), "path", "left_semi")
    once = legal.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.min("class_id").alias("_class"), F.min("weight").alias("_weight")).filter("_n = 1").drop("_n")
    out = rows.join(once.hint("merge"), "path", "left")
    return out.withColumns({"class_id": F.coalesce("_class", "class_id"), "weight": F.coalesce("_weight", "weight", F.lit(1.0)), "decided": F.col("_class").isNotNull()}).drop("_class", "_weight")


def illegal_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on other rows than training rows, and repeated ones, with the reason."""
    stray = decisions.join(rows.filter("split = 'train'").select("path").hint("merge"), "path", "left_anti").select("path", F.lit("not a training row").alias("reason"))
    twice = decisions.groupBy("path").count().filter("count > 1").select("path", F.lit("decided twice").alias("reason"))
    return stray.distinct().unionByName(twice)


def merge_views(canonical: DataFrame, views: DataFrame) -> DataFrame:
    """Canonical rows and their other views; a matched view takes label and group of its canonical row, an unmatched one is for review only."""
    own = canonical.select(F.col("path").alias("pair_id"), F.col("class_id").alias("_class"), F.col("group_id").alias("_group"))
    seen = views.join(own.hint("merge"), "pair_id", "left")
    matched = F.col("_class").isNotNull()
    seen = seen.select("path", "pair_id", F.coalesce("_class", "class_id").alias("class_id"), F.coalesce("_group", "group_id").alias("group_id"), "view_type", F.when(matched, F.lit("matched_view")).otherwise("review_only").alias("role"))
    base = canonical.select("path", F.col("path").alias("pair_id"), "class_id", "group_id", F.lit("canonical").alias("view_type"), F.lit("canonical").alias("role"))
    return base.unionByName(seen)


def ownership_conflicts(canonical: DataFrame, views: DataFrame) -> DataFrame:
    """``pair_id, reason`` of views without a canonical row, of rows claimed twice and of pairs that disagree in split, group or class."""
    own = canonical.select(F.col("path").alias("pair_id"), *[F.col(c).alias(f"_{c}") for c in ("split", "group_id", "class_id")])
    both = views.join(own.hint("merge"), "pair_id", "left")
    differs = F.lit(False)
    for c in ("split", "group_id", "class_id"):
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    absent = F.col("_split").isNull()
    reason = F.when(absent, "no canonical row").when(differs, "split, group or class differs")
    stray = both.select("pair_id", reason.alias("reason")).filter("reason IS NOT NULL").distinct()
    return stray.unionByName(views.groupBy("pair_id").count().filter("count > 1").select("pair_id", F.lit("claimed twice").alias("reason")))


def canonical_violations(df: DataFrame) -> DataFrame:
    """``pair_id, reason``: pairs without exactly one canonical row, with a class unlike the canonical one's, or with another view type."""
    own = F.max(F.when(F.col("view_type") == "canonical", F.col("class_id")))
    pairs = df.groupBy("pair_id").agg(F.count_if(F.col("view_type") == "canonical").alias("_c"), own.alias("_own"), F.min("class_id").alias("_low"), F.max("class_id").alias("_high"), F.count_if(~F.col("view_type").isin("canonical", "detector_aligned")).alias("_odd"))
    reason = F.when(F.col("_c") != 1, "not one canonical row").when((F.col("_low") != F.col("_own")) | (F.col("_high") != F.col("_own")), "classes differ").when(F.col("_odd") > 0, "unknown view type")
    return pairs.select("pair_id", reason.alias("reason")).filter("reason IS NOT NULL")


def propagate_canonical(df: DataFrame, fields: list[str]) -> DataFrame:
    """Give every row of a pair the fields of its canonical row; one aggregate on the pair (pairs have few rows) joined back.

    ``canonical_violations`` names the pairs that should not be propagated.
    """
    first = [F.first(F.when(F.col("view_type") == "canonical", F.col(f)), ignorenulls=True).alias(f"_{f}") for f in fields]
    own = df.groupBy("pair_id").agg(*first)
    return df.join(own.hint("merge"), "pair_id").withColumns({f: F.col(f"_{f}") for f in fields}).drop(*[f"_{f}" for f in fields])


def pair_consistency(df: DataFrame) -> DataFrame:
    """Pairs with several labels, groups or sources, unequal weights, a base mass other than one, or with other views than one canonical and at most one aligned view."""
    views = F.array_join(F.array_sort(F.collect_list("view_type")), ",")
    one = [F.countDistinct(c).alias(n) for c, n in (("class_id", "labels"), ("group_id", "groups"), ("source_id", "sources"))]
    out = df.groupBy("pair_id").agg(*one, (F.max("weight") - F.min("weight")).alias("spread"), F.sum("mass").alias("_mass"), views.alias("views"))
    wrong = (F.col("labels") != 1) | (F.col("groups") != 1) | (F.col("sources") != 1) | (F.col("spread") > 1e-12) | (F.abs(F.col("_mass") - 1) > 1e-12) | ~F.col("views").isin("canonical", "canonical,detector_aligned")
    return out.filter(wrong).select("pair_id", "labels", "groups", "sources", F.round("_mass", 6).alias("mass"), "views")


def paired_instances(df: DataFrame) -> DataFrame:
    """One row for each pair: class of its canonical row and its views in order."""
    own = F.max(F.when(F.col("view_type") == "canonical", F.col("class_id"))).alias("class_id")
    return df.groupBy("pair_id").agg(own, F.array_join(F.array_sort(F.collect_list("view_type")), ",").alias("views"))


def role_instances(df: DataFrame) -> DataFrame:
    """One row for each pair of the roles ``training`` and ``model_selection``; rows of other roles are left out before anything of them is read.

    Class, group and weights are those of the canonical row: kind and grade target (a pair's soft target in training, else one or zero), weights (1 in
    model selection), ``consistent`` (positive weight and a kept or relabelled status; always in model selection), and the views in order. Pairs that
    ``instance_violations`` lists have no row.
    """
    rows = df.filter(F.col("selection_role").isin("training", "model_selection"))
    bad = instance_violations(rows).select("pair_id").filter("pair_id IS NOT NULL").distinct()
    own = lambda c: F.max_by(F.col(c), F.when(F.col("view_type") == "canonical", 1))
    training = F.col("selection_role") == "training"
    out = rows.groupBy("selection_role", "pair_id").agg(
        own("class_id").alias("class_id"), own("group_id").alias("group_id"), own("grade_target").alias("_target"), own("kind_weight").alias("_kind"), own("grade_weight").alias("_grade"), own("status").alias("_status"),
        F.array_join(F.array_sort(F.collect_list("view_type")), ",").alias("views"), F.count(F.lit(1)).alias("n_views"),
    )
    grade = (F.col("class_id") % 2).cast("double")
    kept = F.coalesce(F.col("_grade") > 0, F.lit(False)) & F.coalesce(F.col("_status").isin("hard_label_retained", "auto_relabelled_high_conf"), F.lit(False))
    out = out.join(bad.hint("merge"), "pair_id", "left_anti").withColumns({
        "kind_target": F.floor(F.col("class_id") / 2).cast("double"), "grade_target": F.when(training, F.coalesce("_target", grade)).otherwise(grade),
        "kind_weight": F.when(training, F.coalesce(F.nullif("_kind", F.lit(0.0)), F.lit(1.0))).otherwise(1.0), "grade_weight": F.when(training, F.coalesce("_grade", F.lit(0.0))).otherwise(1.0),
        "consistent": ~training | kept,
    })
    return out.drop("_target", "_kind", "_grade", "_status")


def instance_violations(df: DataFrame) -> DataFrame:
    """``pair_id, group_id, reason``: pairs without or with several canonical rows, of views that disagree on the class, training rows that are not eligible, and groups in both roles."""
    rows = df.filter(F.col("selection_role").isin("training", "model_selection"))
    pairs = rows.groupBy("selection_role", "pair_id").agg(F.count_if(F.col("view_type") == "canonical").alias("_c"), F.countDistinct("class_id").alias("_k"), F.count_if((F.col("selection_role") == "training") & ~F.coalesce(F.col("eligible"), F.lit(False))).alias("_e"))
    reasons = F.array_compact(F.array(F.when(F.col("_c") == 0, "no canonical row"), F.when(F.col("_c") > 1, "several canonical rows"), F.when(F.col("_k") > 1, "views disagree"), F.when(F.col("_e") > 0, "not eligible")))
    own = pairs.select("pair_id", F.lit(None).cast(df.schema["group_id"].dataType).alias("group_id"), F.explode(reasons).alias("reason"))
    both = rows.groupBy("group_id").agg(F.countDistinct("selection_role").alias("_n")).filter("_n > 1 AND group_id IS NOT NULL")
    return own.unionByName(both.select(F.lit(None).cast(df.schema["pair_id"].dataType).alias("pair_id"), "group_id", F.lit("group in both roles").alias("reason")))


def source_balanced(df: DataFrame, group: str, label: str, weight: str) -> DataFrame:
    """Weights that are equal by group, then by class, with mean 1 over the rows of positive weight."""
    rows = df.groupBy(label, group).agg(F.sum(weight).alias("_mass"), F.count_if(F.col(weight) > 0).alias("_n")).filter("_mass > 0")
    classes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_groups"), F.sum("_n").alias("_rows"))
    whole = classes.agg(F.count(F.lit(1)).alias("_k"), F.sum("_rows").alias("_all"))
    scale = rows.join(classes.hint("merge"), label).crossJoin(F.broadcast(whole))
    scale = scale.select(label, group, (F.col("_all") / (F.col("_k") * F.col("_groups") * F.col("_mass"))).alias("_scale"))
    return df.join(scale.hint("merge"), [label, group], "left").withColumn("balanced", F.coalesce(F.col(weight) * F.col("_scale"), F.lit(0.0))).drop("_scale")


def balanced_sample(df: DataFrame, label: str, group: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn with replacement: every class equally often, then a group of the class, then a row of the group, each at a seeded place.

    Groups of a class and rows of a group are numbered in a seeded order, in ranges; the draws join on these numbers.
    """
    from gradeloom.operators.datasets import draw

    pair = F.concat_ws("\x1f", label, group)
    keys = df.select("path", label, group).filter(F.col(label).isNotNull() & F.col(group).isNotNull()).withColumn("_pair", pair)
    rows = numbered(keys, "_pair", [draw(seed, "path"), F.col("path")], "_row").select("path", "_pair", (F.col("_row") - 1).alias("_row"))
    groups = keys.groupBy(label, "_pair").agg(F.count(F.lit(1)).alias("_rows"))
    groups = written(numbered(groups, label, [draw(seed, "_pair"), F.col("_pair")], "_group").withColumn("_group", F.col("_group") - 1))
    classes = groups.groupBy(label).agg(F.count(F.lit(1)).alias("_groups")).withColumn("_rank", F.row_number().over(Window.orderBy(label)) - 1)  # one row a class
    k = F.broadcast(classes.agg(F.count(F.lit(1)).alias("_k")))  # one row
    code = lambda part: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{part}:"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(k).withColumn("_rank", F.col("draw") % F.col("_k"))
    of_class = draws.join(classes.hint("shuffle_hash"), "_rank").withColumn("_group", code("group") % F.col("_groups"))
    of_group = of_class.select("draw", label, "_group").join(groups.hint("merge"), [label, "_group"]).withColumn("_row", code("row") % F.col("_rows"))
    return of_group.select("draw", label, "_pair", "_row").join(rows.hint("merge"), ["_pair", "_row"]).select("draw", "path", label)


def inverse_frequency_sample(df: DataFrame, label: str, n: int, seed: int) -> DataFrame:
    """``draw, path, label``: exactly ``n`` rows drawn with replacement, each with a chance inverse to the rows of its class.

    That is: of all classes alike, then of its rows alike. Classes are few; a class's rows are numbered by ranges, and the draws, spread over the cluster, join on these numbers.
    """
    from gradeloom.operators.datasets import draw

    rows = written(numbered(df.filter(F.col(label).isNotNull()).select("path", label), label, [draw(seed, "path"), F.col("path")], "_row"))
    classes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_rank", F.row_number().over(Window.orderBy(label)) - 1)  # one row a class
    k = F.broadcast(classes.agg(F.count(F.lit(1)).alias("_k")))  # one row
    code = lambda part: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{part}:"), F.col("draw").cast("string"))), 1, 15), 16, 10).cast("long")
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(k).filter("_k > 0").withColumn("_rank", code("class") % F.col("_k"))
    chosen = draws.join(classes.hint("shuffle_hash"), "_rank").withColumn("_row", code("row") % F.col("_rows") + 1)
    return chosen.select("draw", label, "_row").join(rows.hint("merge"), [label, "_row"]).select("draw", "path", label)


def expand_views(df: DataFrame, views: str, weight: str) -> DataFrame:
    """One row for each view; the row's weight is shared equally."""
    return df.select("*", F.posexplode(views).alias("view_id", "view")).withColumn("view_weight", F.col(weight) / F.size(views))


def small_loss_select(df: DataFrame, label: str, rate: float) -> DataFrame:
    """The ``max(1, ceil(n * rate))`` rows of least ``loss`` of each class, ties by ``path``; numbers come by ranges, so that no task holds a class."""
    rows = numbered(df, label, [F.col("loss"), F.col("path")], "place")
    return beside_group(written(rows), label, _all=F.count(F.lit(1))).filter(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("_all") * F.lit(rate)))).drop("_all")


def review_queue(df: DataFrame, priority: int, per_page: int) -> DataFrame:
    """Rows of one priority by class, then probability, numbered (by ranges) and paged, with empty decision columns."""
    chosen = written(df.filter(F.col("priority") == priority))  # finding the ranges reads the rows once more
    rows = numbered(chosen, "class_id", [F.col("p_grade"), F.col("path")], "number")
    return rows.withColumns({"page": F.ceil(F.col("number") / per_page), "suggested": F.when(F.col("p_grade") > 0.5, 1).otherwise(0) + F.floor(F.col("class_id") / 2) * 2, "decision": F.lit(None).cast("string")})


def audit_summary(df: DataFrame) -> DataFrame:
    """Rows, mean agreement and weight sums by status and priority."""
    return df.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"), F.avg("grade_agreement").alias("agreement"), F.sum("kind_weight").alias("kind_mass"), F.sum("grade_weight").alias("grade_mass"))


def supervision_mass(df: DataFrame) -> DataFrame:
    """Rows, rows of full weight and the sum of grade weights by class."""
    return df.groupBy("class_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("grade_weight") >= 0.999).alias("consistent"), F.sum("grade_weight").alias("mass"))


def audit_counts(df: DataFrame) -> DataFrame:
    """``part, value, n, kind_agreement, grade_agreement, kind_mass, grade_mass`` by status, by priority, by resolution tier (column ``tier``) and of all rows: both agreement rates and weight sums."""
    cell = lambda part, value: F.struct(F.lit(part).alias("part"), value.cast("string").alias("value"))
    parts = F.array(cell("status", F.col("status")), cell("priority", F.col("priority")), cell("tier", F.col("tier")), cell("all", F.lit("all")))
    rows = df.select("kind_agreement", "grade_agreement", "kind_weight", "grade_weight", F.inline(parts))
    return rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("kind_agreement").alias("kind_agreement"), F.avg("grade_agreement").alias("grade_agreement"), F.sum("kind_weight").alias("kind_mass"), F.sum("grade_weight").alias("grade_mass"))


def realigned(df: DataFrame, p: str, classes: int) -> DataFrame:
    """Class balance: each class's probability times ``1 / classes`` over its mean, scaled to sum 1, as ``p``; a class that never has any stays 0."""
    cells = df.select(F.posexplode(p).alias("_place", "_x")).groupBy("_place").agg(F.avg("_x").alias("_mean"))
    means = cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_mean"))), lambda c: c["_mean"]).alias("_means"))  # one row with one entry a class
    rows = df.crossJoin(F.broadcast(means))
    raw = F.zip_with(p, "_means", lambda x, m: F.when(m > 0, x * F.lit(1.0 / classes) / m).otherwise(0.0))
    rows = rows.withColumn("_raw", raw)
    total = F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn(p, F.transform("_raw", lambda x: F.when(total > 0, x / total).otherwise(0.0))).drop("_raw", "_means")
