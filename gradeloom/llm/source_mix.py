"""Mixing sources to target weights by subset sums.

Targets follow the sources' weights up to a cap. A source gets every document as often as its target
allows in full; for the remaining budget, documents are counted by exact length, most of them are
taken in proportion, and a bounded knapsack over the lengths fills the last words exactly where that
can be done. Which documents of a length are taken is a seeded draw.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.plans.columns import packed, unpacked
from gradeloom.plans.durable import written

#: Fixed values of the mix: weights of the sources in turn, share of all words, and most copies of a document.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
COPIES = 2
SALTS = 64


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = COPIES) -> DataFrame:
    """``source``, ``source_size`` and ``target`` (double) of each source.

    Sources are ordered by code point, null last. A target stops at ``most`` times the source's size;
    the excess is shared by weight until none is above. That is one common level: sources are filled in
    the order of cap / weight, and the level is what is left over for those that are not full. The
    windows hold one row for each source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1
    one = total.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    level = one.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = level.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return level.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", common * F.col("weight"))).alias("target"))


def take_by_length(length: np.ndarray, number: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to the budget."""
    total = int((length * number).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(length), np.int64)
    if budget >= total:
        return number.copy()
    ends = (np.cumsum(number).astype(object) * budget) // total
    take = np.diff(np.array(ends, np.int64), prepend=0)
    rest = budget - int((length * take).sum())
    longest = int(length.max())
    room = max(4 * longest, 4096)
    # make room for the knapsack: give back some documents, the longest first, one of each length in turn
    while rest < room and take[length > 0].any():
        for k in np.flatnonzero((take > 0) & (length > 0))[::-1]:
            if rest >= room:
                break
            take[k] -= 1
            rest += int(length[k])
    free = number - take
    limit = rest + longest
    reach = np.zeros(limit + 1, bool)
    reach[0] = True
    by = np.full(limit + 1, -1, np.int64)
    pieces: list[tuple[int, int]] = []
    for k in np.flatnonzero((free > 0) & (length > 0)):
        left, size = min(int(free[k]), limit // int(length[k])), 1
        while left > 0 and not reach[rest]:
            count = min(size, left)
            step = count * int(length[k])
            new = np.zeros_like(reach)
            new[step:] = reach[: limit + 1 - step]
            new &= ~reach
            by[new] = len(pieces)
            reach |= new
            pieces.append((int(k), count))
            left, size = left - count, size * 2
        if reach[rest]:
            break
    sums = np.flatnonzero(reach)
    best = int(sums[np.argmin(np.abs(sums - rest))])
    while best > 0:
        k, count = pieces[by[best]]
        take[k] += count
        best -= count * int(length[k])
    return take


def plan(lengths: pd.DataFrame) -> pd.DataFrame:
    """The decision for one source: rows ``source, size, rows, whole, budget``; adds ``take``."""
    lengths = lengths.sort_values("size")
    take = take_by_length(lengths["size"].to_numpy(np.int64), lengths["rows"].to_numpy(np.int64), int(lengths["budget"].iloc[0]))
    return lengths.assign(take=take)[["source", "size", "whole", "take", "source_size", "target"]]


def quotas(rows: DataFrame, kind: str) -> DataFrame:
    """How many rows of each (source, size, salt) to take."""
    salted = written(rows.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("rows")))
    goal = targets(salted.select("source", (F.col("size") * F.col("rows")).alias("size")))
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("budget", (F.round("target") - F.col("whole") * F.col("source_size")).cast("long")).withColumnRenamed("source", "of")
    lengths = salted.groupBy("source", "size").agg(F.sum("rows").alias("rows"))
    lengths = lengths.join(goal.hint("merge"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    chosen = lengths.groupBy("source").applyInPandas(plan, f"source {kind}, size long, whole long, take long, source_size long, target double")
    chosen = written(chosen).select(F.col("source").alias("of"), F.col("size").alias("length"), "whole", "take", "source_size", "target")
    before = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    quota = salted.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    quota = quota.join(chosen.hint("merge"), F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("length")))
    return quota.select(F.col("source").alias("of"), F.col("size").alias("length"), F.col("salt").alias("grain"), "whole", "source_size", "target", (F.col("take") - F.col("before")).alias("quota"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Each row in a struct ``row`` with its ``id``, ``source``, ``size`` in words, a seeded ``draw`` and a ``salt``."""
    of = lambda c: F.col("row").getField(c)
    size = F.coalesce(F.regexp_count(of(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    draw = F.xxhash64(F.lit(seed), of(id_col).cast("string"), of(source_col))
    rows = packed(docs).select("row", of(id_col).alias("id"), of(source_col).alias("source"), size.alias("size"), draw.alias("draw"))
    return rows.withColumn("salt", F.pmod(F.shiftright("draw", 20), F.lit(SALTS)).cast("int"))


def with_copies(rows: DataFrame, quota: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("draw", "id"))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("length")) & (F.col("salt") == F.col("grain"))
    out = rows.withColumn("nth", nth).join(quota.hint("merge"), same)
    return out.withColumn("copies", F.col("whole") + (F.col("nth") <= F.col("quota")).cast("long"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5) -> DataFrame:
    """One row for each document: its id, source, ``size`` (words), ``source_size``, ``target`` (its source's), ``taken`` words and ``copies``.

    ``taken`` is the size times the copies in the mix: 0, 1 or 2. A null or blank text has size 0 and adds
    nothing. A null source is a source of its own, the last one. Rows alike in id, source and size
    count one by one; which of them is taken cannot be told apart. A table without words has targets 0.
    The knapsack's memory grows with the longest text's words (some 40 bytes each). Ids may be of any type.
    An empty table gives an empty result. Other columns are not read.
    """
    rows = written(sized(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, seed).drop("row"))
    out = with_copies(rows, quotas(rows, docs.schema[source_col].dataType.simpleString()))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns, whatever their names."""
    rows = sized(docs, id_col, text_col, source_col, seed)
    counted = written(rows.select("source", "size", "salt"))
    out = with_copies(rows, quotas(counted, docs.schema[source_col].dataType.simpleString()))
    return unpacked(out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))))
