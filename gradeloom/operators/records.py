"""Records around the operators: names, messages, legacy tables, guards, statistics of columns and series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.operators.ranking import beside_group


def labels_from_url(df: DataFrame, column: str) -> DataFrame:
    """Add ``host`` and ``label`` (the first path part) of an address; rows without a host have nulls."""
    host = F.nullif(F.regexp_extract(column, "^[a-z]+://([^/]+)", 1), F.lit(""))
    return df.withColumns({"host": host, "label": F.nullif(F.regexp_extract(column, "^[a-z]+://[^/]+/([^/?#]+)", 1), F.lit(""))})


def labels_from_path(df: DataFrame, path: str, suffixes: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(labelled, rejects)`` of files ``.../<kind>_<grade>/[<source>/]<file>`` with one of the suffixes (any case); other files go.

    Adds ``kind``, ``grade``, ``source`` (the folder in the class folder, else the file's stem) and ``item`` (the stem). Files
    without a class folder are rejects with a ``reason``.
    """
    files = df.filter(F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin([s.lower() for s in suffixes]))
    part = lambda k: F.regexp_extract(path, r"(?:^|/)([a-z0-9]+)_([a-z0-9]+)/(?:([^/]+)/)?([^/]+)\.[^./]*$", k)
    files = files.withColumns({"kind": part(1), "grade": part(2), "source": F.coalesce(F.nullif(part(3), F.lit("")), part(4)), "item": part(4)})
    rejects = files.filter("kind = ''").drop("kind", "grade", "source", "item").withColumn("reason", F.lit("no class folder"))
    return files.filter("kind <> ''"), rejects


def capture_time(df: DataFrame, name: str) -> DataFrame:
    """Add ``captured`` from ``camera-YYYYMMDD-HHMMSS-`` names; null where the name does not say."""
    digits = F.regexp_extract(name, "^camera-([0-9]{8}-[0-9]{6})-", 1)
    return df.withColumn("captured", F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd-HHmmss")))


def upgrade_legacy(df: DataFrame) -> DataFrame:
    """Old tables: ``id`` becomes ``sample_code`` and ``source`` is ``legacy``; upgraded tables stay as they are."""
    if "sample_code" not in df.columns:
        df = df.withColumnRenamed("id", "sample_code")
    return df if "source" in df.columns else df.withColumn("source", F.lit("legacy"))


def event_envelope(df: DataFrame, kind: str, data: list[str], stats: list[str] | None = None) -> DataFrame:
    """One JSON message ``{type, data, stats}`` for each record; ``stats`` is left out where it is not asked for."""
    parts = [F.lit(kind).alias("type"), F.struct(*data).alias("data"), *([F.struct(*stats).alias("stats")] if stats else [])]
    return df.withColumn("message", F.to_json(F.struct(*parts)))


#: Fixed value: how reasons of records that come from a model begin.
MODEL_REASON = "model"


def derive_result_columns(df: DataFrame) -> DataFrame:
    """Add ``result_type`` (``model`` by the reason's beginning, else ``legacy``), ``display`` (the text of each grade) and, for model results alone,
    ``grade_label`` (first or second level) and the three confidences: of kind, grade and detector, from the scores that carry them."""
    model = F.startswith("reason", F.lit(MODEL_REASON))
    share = lambda c: F.when(model, F.round(F.col(c) / 100, 4))
    return df.withColumns({
        "result_type": F.when(F.coalesce(model, F.lit(False)), "model").otherwise("legacy"),
        "grade_label": F.when(model, F.when(F.col("grade") == "A", "first").otherwise("second")),
        "kind_confidence": share("color_score"),
        "grade_confidence": share("integrity_score"),
        "detector_confidence": share("size_score"),
        "display": F.when(F.col("grade") == "A", "excellent").when(F.col("grade") == "B", "qualified").otherwise("to be handled"),
    })


def percent(share: Column) -> Column:
    """A share as a percentage with one place, exact halves up."""
    return F.concat(F.format_string("%.1f", F.floor(share * 1000 + 0.5) / 10), F.lit("%"))


def prediction_to_inspection(df: DataFrame) -> DataFrame:
    """A prediction as an inspection record.

    Takes ``pred`` (kind * 2 + grade; grade 1 is bad), ``conf`` (its joint probability), ``k1`` (of kind 1), ``g0`` and ``g1`` (of
    bad under each kind) and ``detector``. The five scores are the confidence in the kind, that in the grade, the
    probability of good, that of the detector, and of not bad, times 100; a bad item is grade C with one moderate defect.
    """
    kind, bad = F.floor(F.col("pred") / 2), F.col("pred") % 2 == 1
    p_kind = F.when(kind == 1, F.col("k1")).otherwise(1 - F.col("k1"))
    p_bad = F.when(kind == 1, F.col("g1")).otherwise(F.col("g0"))
    p_grade = F.when(bad, p_bad).otherwise(1 - p_bad)
    defect = F.struct(F.lit("model_bad_grade").alias("type"), F.lit("second level by the model").alias("name"), F.lit("moderate").alias("severity"), p_grade.alias("confidence"))
    return df.withColumns({
        "variety": F.concat(F.lit("kind "), kind.cast("string")),
        "color_score": p_kind * 100, "integrity_score": p_grade * 100, "shape_score": (1 - p_bad) * 100, "size_score": F.col("detector") * 100, "defect_score": (1 - p_bad) * 100,
        "confidence": F.col("conf"), "model_grade": F.when(bad, "C").otherwise("A"), "model_score": (1 - p_bad) * 100,
        "defects": F.when(bad, F.array(defect)).otherwise(F.array().cast("array<struct<type:string,name:string,severity:string,confidence:double>>")),
        "model_reason": F.concat(F.lit(MODEL_REASON + ": class "), F.col("pred").cast("string"), F.lit("; kind "), percent(p_kind), F.lit(", grade "), percent(p_grade), F.lit(", joint "), percent(F.col("conf"))),
    })


def resolve_defaults(*columns: str) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def check_roles(df: DataFrame, expected: dict[str, list]) -> DataFrame:
    """Rows that carry other values than expected, with all the columns at fault."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c).isin(v), F.lit(False)), c) for c, v in expected.items()]))
    return df.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def mentions_token(column: str | Column, token: str) -> Column:
    """Whether a path has the whole token in any of its parts."""
    return F.exists(F.split(F.lower(column), "[^a-z0-9]+"), lambda t: t == token)


def result_rows(df: DataFrame, key: str, order: list[Column], confidence: str) -> DataFrame:
    """Results numbered by key, confidences rounded to four places."""
    return df.withColumns({"number": F.row_number().over(Window.partitionBy(key).orderBy(*order)), confidence: F.round(confidence, 4)})


def cross_split_owners(df: DataFrame, key: str) -> DataFrame:
    """Values of a key that several splits own."""
    return df.groupBy(key).agg(F.countDistinct("split").alias("splits"), F.count(F.lit(1)).alias("n")).filter("splits > 1")


def known_hash_overlap(new: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """New rows whose well-formed SHA-256 is already known."""
    good = F.rlike(column, F.lit("^[0-9a-f]{64}$"))
    return new.filter(good).join(known.filter(good).select(column).hint("merge"), column, "left_semi")


def source_overlap(new: DataFrame, known: DataFrame, source: str, scope: str) -> DataFrame:
    """``scope, value, n`` of source identifiers of new rows that a known scope holds; null and empty ones are none."""
    clean = lambda df: df.filter(F.col(source).isNotNull() & (F.col(source).cast("string") != ""))
    mine = clean(new).groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    theirs = clean(known).select(scope, source).distinct()
    return theirs.join(mine.hint("merge"), source).select(scope, F.col(source).cast("string").alias("value"), "n")


def distribution_features(df: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """Per key: shares of equal bins of 0 to 1, mean, spread, median absolute deviation, entropy (1: uniform) and seven quantiles.

    Values are held inside 0 to 1. The deviation is a second pass against the medians, one row for each key.
    """
    df = df.withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value).cast("double"))))
    place = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))
    n = F.count(F.lit(1))
    out = df.groupBy(key).agg(n.alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), *[(F.count_if(place == b) / n).alias(f"bin{b}") for b in range(bins)], *[F.percentile(value, F.lit(q / 100)).alias(f"q{q}") for q in (5, 10, 25, 50, 75, 90, 95)])
    entropy = sum((-F.col(f"bin{b}") * F.log(F.col(f"bin{b}") + 1e-12) for b in range(bins)), F.lit(0.0)) / F.log(F.lit(float(bins)))
    far = beside_group(df.select(key, value), key, _median=F.percentile(value, F.lit(0.5))).groupBy(key).agg(F.percentile(F.abs(F.col(value) - F.col("_median")), F.lit(0.5)).alias("mad"))
    return out.withColumn("entropy", entropy).join(far.hint("merge"), key)


def threshold_shares(df: DataFrame, key: str, predicates: dict[str, Column]) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(p.cast("double")).alias(name) for name, p in predicates.items()])


def pairwise_correlation(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns by key; 0 where one hardly varies."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    flat = lambda a, b: (F.stddev_pop(a) < 1e-9) | (F.stddev_pop(b) < 1e-9)
    return df.groupBy(key).agg(*[F.when(flat(a, b), 0.0).otherwise(F.corr(a, b)).alias(f"{a}_{b}") for a, b in pairs])


def change_ratio(df: DataFrame, snapshot: str, cell: str, value: str, limit: float) -> DataFrame:
    """Per snapshot the share of cells that differ by more than ``limit`` from their snapshot before; first ones do not count."""
    before = F.lag(value).over(Window.partitionBy(cell).orderBy(snapshot))
    rows = df.withColumn("_d", F.abs(F.col(value) - before)).filter("_d IS NOT NULL")
    return rows.groupBy(snapshot).agg(F.count(F.lit(1)).alias("cells"), F.avg((F.col("_d") > limit).cast("double")).alias("ratio"))


def union_manifests(tables: list[DataFrame]) -> DataFrame:
    """All rows; columns in the order first seen, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def manifest_paths(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of several path columns, without nulls."""
    return df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("path")).filter("path IS NOT NULL").distinct()


def stable_id(prefix: str, columns: list[str], n: int = 20) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256), 1, n))


def dated_id(prefix: str, ts: str, columns: list[str], n: int = 6) -> Column:
    """``prefix-YYYYMMDD-`` and the first digits of a hash of the columns."""
    return F.concat(F.lit(prefix + "-"), F.date_format(ts, "yyyyMMdd"), F.lit("-"), stable_id("", columns, n))
