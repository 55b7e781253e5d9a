"""Scoring, grading, search and statistics of inspection records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.plans.durable import written

#: Fixed values of the scoring rule, used where a rule leaves a weight or limit empty.
SCORES = ("color_score", "integrity_score", "shape_score", "size_score", "defect_score")
DEFAULT_WEIGHTS = (0.30, 0.30, 0.15, 0.10, 0.15)
DEFAULT_A, DEFAULT_B = 85.0, 65.0
BUCKETS = (60, 70, 80, 90)


@dataclass(frozen=True)
class Rule:
    """Weights in the order of ``SCORES`` and the least scores of the grades A and B."""

    weights: tuple[float | None, ...] = DEFAULT_WEIGHTS
    a_min: float | None = DEFAULT_A
    b_min: float | None = DEFAULT_B


def weighted_score(weights: list[Column]) -> Column:
    """The score in exact decimals, rounded to one place."""
    parts = [F.col(c).cast("decimal(9,4)") * F.coalesce(w, F.lit(d)).cast("decimal(5,4)") for c, w, d in zip(SCORES, weights, DEFAULT_WEIGHTS, strict=True)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.round(total, 1).cast("double")


def grade_by(score: Column, severe: Column, a_min: Column, b_min: Column) -> Column:
    return F.when(severe, "C").when(score >= F.coalesce(a_min, F.lit(DEFAULT_A)), "A").when(score >= F.coalesce(b_min, F.lit(DEFAULT_B)), "B").otherwise("C")


def score_inspections(df: DataFrame, rule: Rule = Rule(), defects: str = "defects") -> DataFrame:  # noqa: B008
    """Add ``score``, ``grade`` and ``reason``. A severe defect forces C and the first one is named."""
    severe = F.filter(F.col(defects), lambda d: F.lower(F.coalesce(d["severity"], F.lit("mild"))) == "severe")
    has = F.coalesce(F.size(severe) > 0, F.lit(False))
    kind = F.coalesce(F.get(severe, F.lit(0))["type"], F.lit("unknown"))
    out = df.withColumn("score", weighted_score([F.lit(w) for w in rule.weights]))
    out = out.withColumn("grade", grade_by(F.col("score"), has, F.lit(rule.a_min), F.lit(rule.b_min)))
    return out.withColumn("reason", F.when(has, F.concat(F.lit("severe defect: "), kind)).otherwise(F.concat(F.lit("weighted score "), F.format_string("%.1f", "score"))))


def apply_model_grade(df: DataFrame) -> DataFrame:
    """A model's grade replaces grade and score; its score counts unless it is 0 or null."""
    has = F.col("model_grade").isNotNull()
    score = F.when(has, F.coalesce(F.nullif(F.col("model_score"), F.lit(0.0)), F.col("score"))).otherwise(F.col("score"))
    reason = F.when(has, F.concat(F.lit("model grade "), F.col("model_grade"))).otherwise(F.col("reason"))
    return df.withColumns({"reason": reason, "score": score, "grade": F.coalesce("model_grade", "grade")})


def reject_reasons(df: DataFrame) -> DataFrame:
    """Add ``reasons``: one entry for each broken rule, in a fixed order; empty for a valid record.

    The five scores are needed and lie in 0..100; where they are given, ``length`` and ``width`` are above 0,
    ``confidence`` in 0..1, ``processing_time`` not below 0, ``model_grade`` A, B or C, ``model_score`` in 0..100; each
    defect has a type and a name, a known severity, and confidence and area share in 0..1. Columns that the
    table lacks are not judged.
    """
    rules: list[tuple[Column, str]] = [((F.col(c) < 0) | (F.col(c) > 100) | F.col(c).isNull(), f"{c} outside 0..100") for c in SCORES]
    has = set(df.columns)
    rules += [(F.col(c) <= 0, f"{c} not above 0") for c in ("length", "width") if c in has]
    rules += [((F.col(c) < 0) | (F.col(c) > top), f"{c} outside 0..{top}") for c, top in (("confidence", 1), ("model_score", 100)) if c in has]
    if "processing_time" in has:
        rules.append((F.col("processing_time") < 0, "processing_time below 0"))
    if "model_grade" in has:
        rules.append((~F.col("model_grade").isin("A", "B", "C"), "model_grade unknown"))
    if "severity" in has:
        rules.append((~F.coalesce(F.col("severity"), F.lit("mild")).isin("mild", "moderate", "severe"), "severity unknown"))
    if "defects" in has:
        of = {f.name for f in df.schema["defects"].dataType.elementType.fields}
        some = lambda test: F.coalesce(F.exists("defects", test), F.lit(False))
        rules.append((some(lambda d: d["type"].isNull() | d["name"].isNull()), "defect without type or name"))
        rules.append((some(lambda d: ~F.coalesce(d["severity"], F.lit("mild")).isin("mild", "moderate", "severe")), "defect severity unknown"))
        outside = lambda c: lambda d: F.coalesce((d[c] < 0) | (d[c] > 1), F.lit(False))
        rules += [(some(outside(c)), f"defect {c} outside 0..1") for c in ("confidence", "area_ratio") if c in of]
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(test, text) for test, text in rules])))


def with_defaults(df: DataFrame, batch: str | int | None = None, variety: str | None = None) -> DataFrame:
    """Fill what a record may leave out: batch, variety, confidence 0.95, no defects, and mild severity and confidence 0.8 of a defect."""
    given = {"batch_id": batch, "variety": variety, "confidence": 0.95}
    df = df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in given.items() if c in df.columns and v is not None})
    if "defects" in df.columns:
        fill = {"severity": "mild", "confidence": 0.8}
        fields = [f.name for f in df.schema["defects"].dataType.elementType.fields]
        one = lambda d: F.struct(*[(F.coalesce(d[n], F.lit(fill[n])) if n in fill else d[n]).alias(n) for n in fields])
        df = df.withColumn("defects", F.coalesce(F.transform("defects", one), F.array().cast(df.schema["defects"].dataType)))
    return df


def validate(df: DataFrame, **defaults) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)``: records that keep all rules, with defaults filled in, and the others as they came with their ``reasons``."""
    judged = reject_reasons(df)
    return with_defaults(judged.filter(F.size("reasons") == 0).drop("reasons"), **defaults), judged.filter(F.size("reasons") > 0)


def mean_tenths(c: str) -> Column:
    """The mean of a column to one place, halves away from zero, by whole numbers of ten-thousandths: no order of the rows changes it."""
    total, n = F.sum((F.col(c).cast("decimal(18,4)") * 10_000).cast("long")), F.count(c)
    return F.sign(total) * tenths(F.abs(total), 10_000 * n)


def tenths(part: Column, whole: Column) -> Column:
    """``part / whole`` of whole numbers not below zero to one place, halves up."""
    doubled = 2 * whole
    above = 20 * part + whole
    return ((above - above % doubled) / doubled).cast("double") / 10


def batch_stats(df: DataFrame) -> DataFrame:
    """Per batch: total, means rounded to one place, counts and percentages of the grades. Scores and times count to four places; roundings are exact."""
    count = lambda g: F.count_if(F.col("grade") == g)
    columns = [F.count(F.lit(1)).alias("total"), mean_tenths("score").alias("mean_score"), mean_tenths("processing_time").alias("mean_time")]
    columns += [mean_tenths(c).alias(f"mean_{c}") for c in SCORES]
    columns += [count(g).alias(f"n_{g.lower()}") for g in "ABC"]
    out = df.groupBy("batch_id").agg(*columns)
    return out.withColumns({f"pct_{g}": tenths(100 * F.col(f"n_{g}"), F.col("total")) for g in "abc"})


def score_distribution(df: DataFrame) -> DataFrame:
    """Per batch: numbers of scores under each bound and from the last one on, zeros included."""
    s, low, out = F.col("score"), None, []
    for b in BUCKETS:
        cond = (s < b) if low is None else (s >= low) & (s < b)
        out.append(F.count_if(cond).alias(f"under_{b}"))
        low = b
    return df.groupBy("batch_id").agg(*out, F.count_if(s >= low).alias(f"from_{low}"))


def top_defects(df: DataFrame, k: int = 8, defects: str = "defects") -> DataFrame:
    """Per batch the ``k`` most frequent defects: name, else type, else ``unknown``; ties by name."""
    one = df.select("batch_id", F.explode(defects).alias("d")).select("batch_id", F.coalesce("d.name", "d.type", F.lit("unknown")).alias("defect"))
    counted = one.groupBy("batch_id", "defect").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("n"), "defect"))
    return counted.withColumn("place", place).filter(F.col("place") <= k)


def list_batches(batches: DataFrame, stats: DataFrame) -> DataFrame:
    """Every batch with its total and mean score; zeros for batches without records."""
    return batches.join(stats.select("batch_id", "total", "mean_score"), "batch_id", "left").select("batch_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"))


def matching(df: DataFrame, batch: int | None = None, text: str | None = None, variety: str | None = None, grade: str | None = None, source: str | None = None, model_only: bool = False) -> DataFrame:
    """Records that pass all given filters; ``text`` is part of the sample code or the variety, ASCII case ignored."""
    for value, column in ((batch, "batch_id"), (variety, "variety"), (grade, "grade"), (source, "source")):
        if value is not None:
            df = df.filter(F.col(column) == value)
    if text:
        df = df.filter(F.contains(F.lower("sample_code"), F.lit(text.lower())) | F.contains(F.lower("variety"), F.lit(text.lower())))
    return df.filter(F.startswith("reason", F.lit("model"))) if model_only else df


def search(df: DataFrame, page: int = 1, limit: int = 20, **filters) -> DataFrame:
    """One page of the records that pass all filters (see ``matching``), newest first, ties by id, with ``total`` and ``pages`` (of all that pass)."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    found = matching(df, **filters)
    part = found.orderBy(F.desc("ts"), "id").offset((page - 1) * limit).limit(limit)
    return part.crossJoin(F.broadcast(search_totals(found, limit)))  # one row


def search_totals(found: DataFrame, limit: int) -> DataFrame:
    """One row: ``total`` and ``pages`` (0 without records)."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("pages", F.ceil(F.col("total") / limit))


def score_as_of(df: DataFrame, versions: DataFrame, width: int = 86_400, most: int = 100_000) -> DataFrame:
    """Score each record by the rule version in force at its time.

    Versions (``valid_from``, ``w1`` to ``w5``, ``a_min``, ``b_min``) whose weights do not sum to 1 within
    0.001, or whose A limit is not above that of B, are refused. Spans of versions are cut into stretches of
    ``width`` seconds, on which records join by equality; the table of stretches is broadcast up to ``most`` rows.
    """
    good = versions.filter((F.abs(sum((F.col(f"w{k}") for k in range(1, 6)), F.lit(0.0)) - 1) <= 0.001) & (F.col("a_min") > F.col("b_min")))
    last = df.agg(F.max("ts").alias("_last"))
    stretch = lambda c: F.floor(F.unix_micros(c) / (width * 1_000_000))
    spans = good.withColumn("valid_to", F.lead("valid_from").over(Window.orderBy("valid_from"))).crossJoin(F.broadcast(last)).filter("valid_from <= _last")
    spans = spans.withColumn("_stretch", F.explode(F.sequence(stretch("valid_from"), stretch(F.least(F.coalesce("valid_to", "_last"), F.col("_last")))))).drop("_last")
    spans = written(spans)
    spans = F.broadcast(spans) if spans.count() <= most else spans.hint("merge")
    out = df.withColumn("_stretch", stretch("ts")).join(spans, "_stretch").filter((F.col("ts") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("ts") < F.col("valid_to")))).drop("_stretch")
    out = out.withColumn("score", weighted_score([F.col(f"w{k}") for k in range(1, 6)]))
    return out.withColumn("grade", grade_by(F.col("score"), F.lower("severity") == "severe", F.col("a_min"), F.col("b_min")))


def narrative(stats: DataFrame, defects: DataFrame) -> DataFrame:
    """A sentence on each batch: records, mean score, share of A, quality (good from half A, fair under a quarter C), and its two most frequent defects.

    ``defects`` is the result of ``top_defects``.
    """
    word = F.when(F.col("pct_a") >= 50, "good").when(F.col("pct_c") < 25, "fair").otherwise("needs attention")
    two = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 2, F.struct("place", "defect")))), lambda d: d["defect"]), ", ")
    rows = stats.join(defects.groupBy("batch_id").agg(two.alias("worst")).hint("merge"), "batch_id", "left")
    worst = F.coalesce(F.nullif("worst", F.lit("")), F.lit("no frequent defect"))
    text = F.concat(F.lit("Batch "), F.col("batch_id").cast("string"), F.lit(": "), F.col("total").cast("string"), F.lit(" items, mean score "), F.format_string("%.1f", "mean_score"), F.lit(", A "), F.format_string("%.1f", "pct_a"), F.lit(" %, quality "), word, F.lit("; "), worst)
    return rows.select("batch_id", text.alias("narrative"))


def live_summary(df: DataFrame, kind: str) -> DataFrame:
    """Records by kind and grade."""
    return df.groupBy(F.col(kind).alias("kind"), "grade").agg(F.count(F.lit(1)).alias("n"))


def ensure_batches(batches: DataFrame, records: DataFrame) -> DataFrame:
    """The batches with a row for each batch that only records name (source ``auto``)."""
    new = records.select("batch_id").filter("batch_id IS NOT NULL").distinct().join(batches, "batch_id", "left_anti")
    return batches.unionByName(new.withColumn("source", F.lit("auto")), allowMissingColumns=True)


def clear_batch(df: DataFrame, batch: int) -> DataFrame:
    """The records without those of one batch; a null batch stays."""
    return df.filter(~F.col("batch_id").eqNullSafe(F.lit(batch)))


def rate_per_window(df: DataFrame, width: str = "1 second") -> DataFrame:
    """Records in each tumbling window that has any."""
    return df.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
