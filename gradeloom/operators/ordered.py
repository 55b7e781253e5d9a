"""Ordered operators without a task for each key: scans, chains and states over ranges of rows that hand on what they end with.

A table is dealt into ranges of (key, order). Inside a range windows do the work; what a range ends with is a small table, and what
the ranges before it ended with is joined back to it. A key of any size so spreads over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.operators.hot_keys import look_up
from gradeloom.operators.ranking import numbered
from gradeloom.plans.durable import written


def in_ranges(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` written in ranges of ``key`` and ``order``, their number as ``_range``."""
    return written(df.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()))


def carried(ranged: DataFrame, key: str, order: list[str], value: Column, name: str, total: bool = False, before: bool = False) -> DataFrame:
    """Add ``name``: the last value that is not null up to the row (``before``: up to the row before it), or with ``total`` the sum so far.

    ``ranged`` comes from ``in_ranges`` of the same key and order, which is total.
    """
    rows = ranged.withColumn("_v", value)
    own = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    ranges = Window.partitionBy("_ckey").orderBy("_cof").rowsBetween(Window.unboundedPreceding, -1)
    end = F.sum("_v") if total else F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    ends = rows.groupBy(F.col(key).alias("_ckey"), F.col("_range").alias("_cof")).agg(end.alias("_end"))
    earlier = ends.select("_ckey", "_cof", (F.sum("_end") if total else F.last("_end", ignorenulls=True)).over(ranges).alias("_earlier"))
    here = (F.sum("_v") if total else F.last("_v", ignorenulls=True)).over(own)
    met = rows.withColumn("_here", here).join(earlier.hint("merge"), F.col(key).eqNullSafe(F.col("_ckey")) & (F.col("_range") == F.col("_cof")))
    both = F.coalesce("_here", F.lit(0)) + F.coalesce("_earlier", F.lit(0)) if total else F.coalesce("_here", "_earlier")
    return met.withColumn(name, both).drop("_v", "_here", "_ckey", "_cof", "_earlier")


def ema(df: DataFrame, key: str, order: list[str], value: str, alpha: float, start: float | None = None) -> DataFrame:
    """Add ``smooth``: ``(1 - alpha) * before + alpha * value`` along each key, from ``start`` or else from the first value itself.

    A step is an affine map of the state, and such maps compose. Rows are numbered by ranges and cut into blocks of equal size; in a block the maps
    are composed by one running sum, and the blocks' own maps by a parallel prefix scan in which each round joins every
    block with the one twice as far before it. A null value changes nothing; rows before the first value have null, or ``start``.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    keep = 1 - alpha
    block = max(1, min(1024, math.floor(100 / -math.log10(keep))))  # powers in a block stay above 1e-100
    x = F.col(value).cast("double")
    rows = numbered(df, key, [F.col(c) for c in order], "_n").withColumns({"_block": F.floor((F.col("_n") - 1) / block), "_x": x})
    so_far = Window.partitionBy(key, "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.count("_x").over(so_far))
    own = F.pow(F.lit(keep), F.col("_c")) * F.coalesce(F.sum(alpha * F.col("_x") * F.pow(F.lit(keep), -F.col("_c"))).over(so_far), F.lit(0.0))
    rows = written(rows.withColumn("_own", own))

    # one map for each block: state -> _m * state + _b; _seen values so far
    maps = rows.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_of")).agg(F.max("_c").alias("_seen"), F.max_by("_own", "_n").alias("_b"))
    maps = written(maps.withColumn("_m", F.pow(F.lit(keep), F.col("_seen"))))
    far, stride = maps.agg(F.coalesce(F.max("_of"), F.lit(0))).first()[0], 1
    while stride <= far:
        back = maps.select(F.col("_key").alias("_k"), (F.col("_of") + stride).alias("_o"), F.col("_seen").alias("_s2"), F.col("_b").alias("_b2"), F.col("_m").alias("_m2"))
        met = maps.join(back.hint("merge"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_of") == F.col("_o")), "left")
        maps = written(met.select("_key", "_of", (F.col("_seen") + F.coalesce("_s2", F.lit(0))).alias("_seen"), (F.col("_b") + F.col("_m") * F.coalesce("_b2", F.lit(0.0))).alias("_b"), (F.col("_m") * F.coalesce("_m2", F.lit(1.0))).alias("_m")))
        stride *= 2
    if start is None:
        first = rows.filter("_x IS NOT NULL").groupBy(F.col(key).alias("_k")).agg(F.min_by("_x", "_n").alias("_start"))
    else:
        first = maps.select(F.col("_key").alias("_k")).distinct().withColumn("_start", F.lit(float(start)))
    known = written(maps.join(first.hint("merge"), F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_k"))
    into = known.select("_key", (F.col("_of") + 1).alias("_of"), (F.col("_b") + F.col("_m") * F.col("_start")).alias("_state"), "_seen")
    into = into.unionByName(known.filter("_of = 0").select("_key", "_of", F.col("_start").alias("_state"), F.lit(0).cast("long").alias("_seen")))
    met = rows.join(into.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_of")))
    smooth = F.col("_own") + F.pow(F.lit(keep), F.col("_c")) * F.col("_state")
    if start is None:
        smooth = F.when(F.col("_c") + F.col("_seen") > 0, smooth)
    return met.withColumn("smooth", smooth).select(*df.columns, "smooth")


def adaptive_gamma(df: DataFrame, key: str, order: list[str], luminance: str, target: float = 0.46, smoothing: float = 0.12, least: float = 0.65, most: float = 1.45) -> DataFrame:
    """Add ``smooth``: the smoothed exponent that takes a frame's median luminance (0 to 1) to ``target``, held between ``least`` and ``most``, from 1.0."""
    asked = F.log(F.lit(min(0.85, max(0.15, target)))) / F.log(F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col(luminance).cast("double"))))
    held = F.least(F.lit(most), F.greatest(F.lit(least), asked))
    return ema(df.withColumn("_gamma", held), key, order, "_gamma", min(1.0, max(0.01, smoothing)), 1.0).drop("_gamma")


def throttle_events(df: DataFrame, key: str, micros: str, order: str, interval: int) -> DataFrame:
    """The rows that pass: the first of each key, then each at least ``interval`` microseconds after the last that passed.

    Each row points to the first row that may pass after it; the pointers come from a running count over rows and their ends of waiting.
    Pointer doubling marks the rows reached from the first one in as many rounds as the logarithm of their number.
    """
    rows = written(numbered(df, key, [F.col(micros), F.col(order)], "_n"))
    at = rows.select(F.col(key).alias("_key"), F.col(micros).alias("_at"), F.lit(1).alias("_row"), "_n")
    ends = rows.select(F.col(key).alias("_key"), (F.col(micros) + interval).alias("_at"), F.lit(0).alias("_row"), "_n")
    counted = carried(in_ranges(at.unionByName(ends), "_key", ["_at", "_row", "_n"]), "_key", ["_at", "_row", "_n"], F.col("_row"), "_rows", total=True)
    jumps = written(counted.filter("_row = 0").select("_key", "_n", (F.col("_rows") + 1).alias("_to")))
    reached, latest = written(jumps.filter("_n = 1").select("_key", "_n")), None
    while latest is None or not latest.isEmpty():
        met = jumps.withColumnsRenamed({"_key": "_k", "_n": "_m"})
        latest = written(reached.join(met.hint("merge"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_n") == F.col("_m"))).select("_key", F.col("_to").alias("_n")))
        reached = reached.unionByName(latest)
        jumps = written(jumps.join(met.withColumnRenamed("_to", "_far").hint("merge"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_to") == F.col("_m"))).select("_key", "_n", F.col("_far").alias("_to")))
    passed = reached.withColumnRenamed("_n", "_m")  # pointers past the last row meet none
    return rows.join(passed.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_n") == F.col("_m")), "left_semi").drop("_n")


def steady_labels(df: DataFrame, key: str, order: str, label: str, confidence: str, usable: str, confirm: int = 2, switch: int = 3) -> DataFrame:
    """Add ``shown``: the label that holds after each row; it changes only after ``switch`` usable rows in a line of one other label.

    The first label is that of the greatest summed confidence of the first ``confirm`` usable rows (ties: the label first in order);
    before it ``shown`` is null. Rows that are not usable change nothing. Usable rows of one label in a line are an island; the row in which an island
    reaches ``switch`` sets the label, and every row shows what was set last. ``order`` is total in a key.
    """
    good = written(numbered(df.filter(F.col(usable)), key, [F.col(order)], "_u").select(F.col(key).alias("_key"), F.col(order).alias("_at"), F.col(label).alias("_label"), F.col(confidence).cast("double").alias("_sure"), "_u"))
    ranged = in_ranges(good, "_key", ["_at"])
    rows = carried(ranged, "_key", ["_at"], F.col("_label"), "_last", before=True)
    new = F.col("_last").isNull() | (F.col("_last") != F.col("_label")) | (F.col("_u") == confirm + 1)
    rows = carried(rows, "_key", ["_at"], F.when(new, F.col("_u")), "_from")
    sets = rows.filter((F.col("_u") > confirm) & (F.col("_u") - F.col("_from") + 1 == switch)).select("_key", "_at", F.col("_label").alias("_set"))
    sums = good.filter(F.col("_u") <= confirm).groupBy("_key", "_label").agg(F.sum("_sure").alias("_sum"), F.max("_u").alias("_u"), F.max_by("_at", "_u").alias("_at"))
    first = sums.groupBy("_key").agg(F.min_by("_label", F.struct(-F.col("_sum"), F.col("_label"))).alias("_set"), F.max("_u").alias("_u"), F.max_by("_at", "_u").alias("_at"))
    sets = sets.unionByName(first.filter(F.col("_u") == confirm).select("_key", "_at", "_set"))
    met = df.join(sets.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_at")), "left").drop("_key", "_at")
    return carried(in_ranges(met, key, [order]), key, [order], F.col("_set"), "shown").drop("_set", "_range")


#: What ``balanced_group_folds`` keeps for the groups of one label and size.
_SEGMENTS = "array<struct<start:long,folds:array<int>>>"


def deal(loads: list[int], totals: list[int], ties: list[int], size: int, number: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """How ``number`` groups of one ``size`` go, each to the fold of least load, then total, then tie: segments and groups by fold.

    A fold's loads after t more groups are ``load + t * size``: the groups go in the order of these numbers over all folds. In units of ``size``
    they are levels that each fold joins at its own, and in every level the folds follow each other in one order. A segment
    is ``(first group, folds)``: from that group on these folds take turns.
    """
    level = [x // size for x in loads]
    order = sorted(range(len(loads)), key=lambda f: (loads[f] % size, totals[f] - level[f] * size, ties[f]))
    segments, taken, at = [], [0] * len(loads), 0
    for now, after in zip(sorted(set(level)), [*sorted(set(level))[1:], None], strict=True):
        if at >= number:
            break
        active = [f for f in order if level[f] <= now]
        segments.append((at, active))
        room = number - at if after is None else min(number - at, (after - now) * len(active))
        for k, f in enumerate(active):
            taken[f] += room // len(active) + (k < room % len(active))
        at += room
    return segments, taken


def balanced_group_folds(df: DataFrame, group: str, label: str, folds: int, seed: int) -> DataFrame:
    """``group, label, rows, fold``: whole groups to folds, label by label, larger groups first, each to the fold with the least rows of its label, then in all.

    Ties between groups follow a seeded order, ties between folds a seeded order for each label. Groups of one label and size are dealt together: only the numbers of groups by
    label and size (no more than the root of twice the rows for each label) pass through one task, as a fold over them; each group
    then finds its fold from its place among those of its size. Groups of several labels, and labels of fewer groups than folds, are errors.
    """
    if folds < 2:
        raise ValueError("there must be two folds at least")
    groups = written(df.groupBy(F.col(group).alias("_group")).agg(F.min(label).alias("_label"), F.max(label).alias("_high"), F.count(F.lit(1)).alias("_rows")))
    if not groups.filter("_label <> _high").isEmpty():
        raise ValueError("a group has several labels")
    if not groups.groupBy("_label").count().filter(F.col("count") < folds).isEmpty():
        raise ValueError("a label has fewer groups than folds")
    kind = df.schema[label].dataType.simpleString()
    tie = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: F.md5(F.concat(F.lit(f"{seed}:fold:"), F.col("_label").cast("string"), F.lit(":"), f.cast("string"))))
    sizes = groups.groupBy("_label", "_rows").agg(F.count(F.lit(1)).alias("_number"))

    def over_sizes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # in the order of labels, then of falling sizes
        totals, loads, now, ties = [0] * folds, [0] * folds, None, None
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if ties is None or r[0] != now:
                    now, loads, ties = r[0], [0] * folds, list(r[3])
                segments, taken = deal(loads, totals, ties, int(r[1]), int(r[2]))
                out.append((r[0], r[1], [{"start": a, "folds": f} for a, f in segments], r[2]))
                loads, totals = ([x + n * int(r[1]) for x, n in zip(old, taken, strict=True)] for old in (loads, totals))
            yield pd.DataFrame(out, columns=["_label", "_rows", "_segments", "_number"])

    table = written(sizes.withColumn("_ties", tie).select("_label", "_rows", "_number", "_ties").repartition(1).sortWithinPartitions("_label", F.desc("_rows")).mapInPandas(over_sizes, f"_label {kind}, _rows long, _segments {_SEGMENTS}, _number long"))
    placed = numbered(groups.select("_group", "_label", "_rows", F.struct("_label", "_rows").alias("_same")), "_same", [F.md5(F.concat(F.lit(f"{seed}:"), F.col("_group").cast("string"))), F.col("_group")], "_place")
    # sizes that many groups have are met where the groups lie
    met = look_up(written(placed.drop("_same")), table, ["_label", "_rows"], groups.count(), "_number")
    turn = F.col("_place") - 1
    segment = F.element_at(F.filter("_segments", lambda s: s["start"] <= turn), -1)
    fold = F.get(segment["folds"], ((turn - segment["start"]) % F.size(segment["folds"])).cast("int"))
    return met.select(F.col("_group").alias(group), F.col("_label").alias(label), F.col("_rows").alias("rows"), fold.alias("fold"))
