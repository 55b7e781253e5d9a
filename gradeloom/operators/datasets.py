"""Manifests: splits, folds, audits, set operations and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.operators.hot_keys import look_up
from gradeloom.operators.ranking import beside_group
from gradeloom.plans.durable import written


def draw(seed: int, key: str) -> Column:
    """A repeatable random order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def leakage_audit(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Values of any of the keys that more than one split holds, with the splits; one shuffle for all keys."""
    stack = ", ".join(f"'{k}', cast({k} as string)" for k in keys)
    long = df.select(split, F.expr(f"stack({len(keys)}, {stack}) as (key, value)")).filter("value IS NOT NULL AND value <> ''")
    return long.groupBy("key", "value").agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits")).filter(F.contains("splits", F.lit(",")))


def identity_conflicts(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Keys with more than one combination of the attributes (nulls count as a value)."""
    return df.groupBy(key).agg(F.countDistinct(row_code(attributes)).alias("variants")).filter("variants > 1")


def integrity_report(df: DataFrame, path: str, content: Column, group: str, label: str, pair: str | None = None, most_views: int = 2, role: str | None = None, split: str = "split", allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Repeated paths, repeated contents and groups with mixed labels, as ``check, key, n``.

    With ``pair`` also pairs of more than ``most_views`` rows; with ``role`` and ``allowed`` (the splits of each role) rows in a split that their role forbids,
    those of an unknown or no role too. Null pairs are no pair.
    """
    many = lambda name, key, most=1: df.groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.lit(name).alias("check"), "key", "n")
    mixed = df.groupBy(F.col(group).cast("string").alias("key")).agg(F.countDistinct(label).alias("n")).filter("n > 1").select(F.lit("mixed_labels").alias("check"), "key", "n")
    out = many("repeated_path", F.col(path)).unionByName(many("repeated_content", content)).unionByName(mixed)
    if pair is not None:
        out = out.unionByName(many("crowded_pair", F.col(pair), most_views).filter("key IS NOT NULL"))
    if role is not None:
        fits = F.lit(False)
        for name, splits in (allowed or {}).items():
            fits = fits | ((F.col(role) == name) & F.col(split).isin(splits))
        bad = df.filter(~F.coalesce(fits, F.lit(False)))
        out = out.unionByName(bad.groupBy(F.col(path).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("forbidden_split").alias("check"), "key", "n"))
    return out


def composition(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts by each dimension, as ``dimension, value, n``; ``a:b`` is the two columns together."""
    one = lambda d: F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in d.split(":")]) if ":" in d else F.col(d).cast("string")
    return df.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), one(d).alias("value")) for d in dimensions]))).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def stratified_group_split(df: DataFrame, group: str, label: str, val: float, test: float, seed: int) -> DataFrame:
    """Whole groups to ``train``, ``val`` or ``test``, per label: at least one group where a ratio is set and three exist."""
    groups = df.groupBy(label, group).agg(F.count(F.lit(1)).alias("rows"))
    by = Window.partitionBy(label)
    groups = groups.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("place", F.row_number().over(by.orderBy(draw(seed, group), group)))

    def share(ratio: float) -> Column:
        return F.when((F.lit(ratio) == 0) | (F.col("n") < 3), 0).otherwise(F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(ratio)).cast("int")))

    groups = groups.withColumn("n_test", share(test)).withColumn("n_val", F.least(share(val), F.col("n") - 1 - F.col("n_test")))
    where = F.when(F.col("place") <= F.col("n_test"), "test").when(F.col("place") <= F.col("n_test") + F.col("n_val"), "val").otherwise("train")
    return groups.select(label, group, "rows", where.alias("split"))


def group_kfold(df: DataFrame, group: str, label: str, k: int, seed: int) -> DataFrame:
    """Groups dealt to ``k`` folds, per label in a seeded order. Mixed-label groups or too few groups are errors."""
    groups = df.groupBy(group).agg(F.min(label).alias(label), F.max(label).alias("_high"))
    if not groups.filter(F.col(label) != F.col("_high")).isEmpty():
        raise ValueError("a group has several labels")
    if not groups.groupBy(label).count().filter(F.col("count") < k).isEmpty():
        raise ValueError("a label has fewer groups than folds")
    place = F.row_number().over(Window.partitionBy(label).orderBy(draw(seed, group), group)) - 1
    return groups.select(group, label, F.pmod(place, F.lit(k)).alias("fold"))


def fold_audit(rows: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """Rows and groups of each fold."""
    return rows.join(folds.select(group, "fold").hint("merge"), group).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(group).alias("groups"))


def fold_classes(rows: DataFrame, folds: DataFrame, group: str, label: str) -> DataFrame:
    """``fold, label, rows, groups`` of every fold and label."""
    own = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("rows"))
    met = own.join(folds.select(group, "fold").distinct().hint("merge"), group)
    return met.groupBy("fold", label).agg(F.sum("rows").alias("rows"), F.countDistinct(group).alias("groups"))


def fold_violations(rows: DataFrame, folds: DataFrame, group: str, pair: str, k: int) -> DataFrame:
    """``check, key, n``: groups and pairs that lie in several folds, groups without a fold, numbers that are no fold of ``k``, and folds without rows."""
    given = folds.select(group, "fold").distinct()
    own = rows.groupBy(group, pair).agg(F.count(F.lit(1)).alias("rows"))
    met = written(own.join(given.hint("merge"), group, "left"))
    several = lambda name, key: met.filter(F.col("fold").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.countDistinct("fold").alias("n")).filter("n > 1").select(F.lit(name).alias("check"), "key", "n")
    by = lambda name, key, test: met.filter(test).groupBy(F.col(key).cast("string").alias("key")).agg(F.sum("rows").alias("n")).select(F.lit(name).alias("check"), "key", "n")
    there = met.select("fold").distinct()
    absent = rows.sparkSession.range(k).select(F.col("id").cast("int").alias("fold")).join(there.hint("merge"), "fold", "left_anti").select(F.lit("absent_fold").alias("check"), F.col("fold").cast("string").alias("key"), F.lit(0).cast("long").alias("n"))
    out = several("group_in_folds", group).unionByName(several("pair_in_folds", pair))
    return out.unionByName(by("no_fold", group, F.col("fold").isNull())).unionByName(by("unknown_fold", "fold", ~F.col("fold").between(0, k - 1))).unionByName(absent)


def split_violations(rows: DataFrame, splits: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """``key, value, splits`` of values of ``keys`` that rows of several splits hold, once whole groups are split (``stratified_group_split``)."""
    met = rows.join(splits.select(group, "split").hint("merge"), group)
    return leakage_audit(met.select("split", *keys), keys)


def scene_split(df: DataFrame, label: str, scene: str, seed: int) -> DataFrame:
    """``label, scene, rows, split``: per label the last scene in a seeded order is ``test``, the second last of four or more ``val``, all others ``train``."""
    scenes = df.filter(F.col(scene).isNotNull()).groupBy(label, scene).agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy(label).orderBy(draw(seed, scene).desc(), F.col(scene).desc())
    placed = scenes.withColumns({"_back": F.row_number().over(order), "_n": F.count(F.lit(1)).over(Window.partitionBy(label))})
    where = F.when(F.col("_back") == 1, "test").when((F.col("_back") == 2) & (F.col("_n") >= 4), "val").otherwise("train")
    return placed.select(label, scene, "rows", where.alias("split"))


def sessionize(df: DataFrame, key: str, ts: str, order: str, gap_seconds: int) -> DataFrame:
    """Add ``session``, from 1 by key: a new one when the gap to the row before is longer than ``gap_seconds``."""
    by = Window.partitionBy(key).orderBy(ts, order)
    gap = F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(by)
    return df.withColumn("_new", F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)).withColumn("session", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def holdout_latest(df: DataFrame, key: str, n: int, pinned: Column | None = None) -> DataFrame:
    """Add ``pool``: the last ``n`` sessions of each key, and those with a ``pinned`` row, are ``holdout``, the others ``train``."""
    if pinned is None:
        rank = F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("session")))
        return df.withColumn("pool", F.when(rank <= n, "holdout").otherwise("train"))
    sessions = df.groupBy(F.col(key).alias("_key"), F.col("session").alias("_session")).agg(F.max(F.coalesce(pinned, F.lit(False))).alias("_pinned"))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("_session")))
    sessions = sessions.withColumn("pool", F.when((rank <= n) | F.col("_pinned"), "holdout").otherwise("train"))
    met = df.join(sessions.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("session") == F.col("_session")))
    return met.drop("_key", "_session", "_pinned")


def first_wins(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct values that both sides hold, without null and empty ones."""
    clean = lambda d: d.select(key).filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return clean(a).intersect(clean(b))


def row_code(columns: list[str]) -> Column:
    """A row as one text that no other row has: each value after its length, null as a mark of its own."""
    one = lambda c: F.when(F.col(c).isNull(), "-;").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    return F.concat(*[one(c) for c in columns])


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and an order-free content hash: the sum of the leading 60 bits of every row's SHA-256."""
    bits = F.conv(F.substring(F.sha2(row_code(columns), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("content"))


def verify_receipt(df: DataFrame, receipt: dict) -> DataFrame:
    """``df`` itself if its fingerprint over ``receipt["columns"]`` is the receipt's ``rows`` and ``content``; else an error."""
    found = table_fingerprint(df, receipt["columns"]).first()
    if (found["rows"], found["content"]) != (receipt["rows"], receipt["content"]):
        raise ValueError(f"the table has {found['rows']} rows and content {found['content']}, not {receipt['rows']} and {receipt['content']}")
    return df


def split_by_role(df: DataFrame, column: str, roles: list[str]) -> dict[str, DataFrame]:
    """The rows of each role; a row of any other role, or of none, is an error. Write them with ``partitionBy``."""
    strange = df.filter(~F.coalesce(F.col(column).isin(roles), F.lit(False))).select(column).limit(1).collect()
    if strange:
        raise ValueError(f"{strange[0][0]!r} is none of the roles {roles}")
    return {role: df.filter(F.col(column) == role) for role in roles}


def fold_complement(rows: DataFrame, folds: DataFrame, group: str, fold: int) -> DataFrame:
    """The rows of all groups but those of one fold; a group in several folds is an error."""
    one = folds.select(group, "fold").distinct()
    if not one.groupBy(group).count().filter(F.col("count") > 1).isEmpty():
        raise ValueError("a group is in several folds")
    return rows.join(one.filter(F.col("fold") != fold).select(group).hint("merge"), group, "left_semi")


def pair_mass(df: DataFrame, pair: str) -> DataFrame:
    """Each row weighs one over the number of rows of its pair."""
    return beside_group(df, pair, mass=F.lit(1.0) / F.count(F.lit(1)))


def balance_mass(df: DataFrame, label: str, weight: str) -> DataFrame:
    """Scale the weights so that all labels with a positive mass weigh the same and the total stays."""
    sums = df.groupBy(label).agg(F.sum(weight).alias("_m")).filter("_m > 0").agg(F.sum("_m").alias("_total"), F.count(F.lit(1)).alias("_k"))
    rows = beside_group(df, label, _mass=F.sum(weight)).crossJoin(F.broadcast(sums))  # one row
    return rows.withColumn("balanced", F.when(F.col("_mass") > 0, F.col(weight) * F.col("_total") / (F.col("_k") * F.col("_mass"))).otherwise(0.0)).drop("_mass", "_total", "_k")


def class_balanced(df: DataFrame, label: str, power: float) -> DataFrame:
    """Weights ``(n / (k * count)) ** power`` scaled to mean 1. Rows without label are left out; large labels are met where their rows lie."""
    counts = written(df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_c")))
    total = counts.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    raw = counts.crossJoin(F.broadcast(total)).withColumn("_w", F.pow(F.col("_n") / (F.col("_k") * F.col("_c")), F.lit(power)))
    mean = raw.agg((F.sum(F.col("_w") * F.col("_c")) / F.sum("_c")).alias("_mean"))
    table = raw.crossJoin(F.broadcast(mean)).select(label, (F.col("_w") / F.col("_mean")).alias("weight"), "_c")  # one row
    return look_up(df, table, label, counts.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0], "_c")


def group_balanced(df: DataFrame, label: str, group: str) -> DataFrame:
    """Weights ``1 / (groups of the label * rows of the group)`` scaled to mean 1. Rows without label or group are left out."""
    rows = written(df.filter(F.col(label).isNotNull() & F.col(group).isNotNull()).groupBy(label, group).agg(F.count(F.lit(1)).alias("_rows")))
    groups = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_groups"))
    raw = rows.join(groups.hint("merge"), label).withColumn("_w", 1.0 / (F.col("_groups") * F.col("_rows")))
    mean = raw.agg((F.sum(F.col("_w") * F.col("_rows")) / F.sum("_rows")).alias("_mean"))
    table = raw.crossJoin(F.broadcast(mean)).select(label, group, (F.col("_w") / F.col("_mean")).alias("weight"), "_rows")  # one row
    return look_up(df, table, [label, group], rows.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0], "_rows")
