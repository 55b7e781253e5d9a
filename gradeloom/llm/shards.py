"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

A uniform permutation sends from each part of the input a number of rows to each shard that follows
a multivariate hypergeometric law. The matrix of these numbers is drawn exactly; then each part
permutes its rows and deals them out by its line of the matrix, the rows are exchanged, and each shard
permutes what it got.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.plans.columns import packed
from gradeloom.plans.durable import written


def draw_matrix(lines: list[int], shards: int, seed: int) -> list[list[int]]:
    """Numbers of rows from every part to every shard; shard totals are at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(lines)
    left = np.array([total // shards + (k < total % shards) for k in range(shards)], np.int64)
    out = []
    for n in lines:
        line = rng.multivariate_hypergeometric(left, n, method="marginals") if n else np.zeros(shards, np.int64)
        left -= line
        out.append([int(x) for x in line])
    return out


def shuffle_into_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 20240601, rows_per_part: int = 250_000) -> DataFrame:
    """One row for each document: its id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    ``law`` is ``rows``: shards have numbers of rows at most one apart. ``size`` is the text's bytes plus
    16, a null text has none; ``slot`` counts from 0 without gaps in each shard; ``grown_shard`` is
    null, as it only has a meaning under a law by key. The permutation follows from the seed and the
    rows' ids and texts, so reruns agree; rows alike in all of these may change places with each other.
    Null ids are allowed. With fewer rows than shards the last shards are empty; an empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"))
    rows = written(rows)
    parts = max(64, rows.count() // rows_per_part)
    draw = lambda k: F.xxhash64(F.lit(seed + k), F.col("id").cast("string"), "size", "crc")
    rows = rows.withColumn("part", F.pmod(draw(0), F.lit(parts)).cast("int"))
    number = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    matrix = draw_matrix([number.get(k, 0) for k in range(parts)], shards, seed)
    lines = docs.sparkSession.createDataFrame([(k, np.cumsum(line).tolist()) for k, line in enumerate(matrix)], "part int, ends array<bigint>")
    # permute each part and deal by its line
    place = F.row_number().over(Window.partitionBy("part").orderBy(draw(1), "id", "crc"))
    dealt = rows.withColumn("n", place).join(lines.hint("merge"), "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda x: x < F.col("n"))))
    # permute each shard: order by (bucket, draw) with buckets small enough for one task each
    buckets = max(4, parts // shards)
    dealt = written(dealt.select("id", "size", "crc", "shard").withColumn("bucket", F.pmod(draw(2), F.lit(buckets)).cast("int")))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    slot = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(draw(3), "id", "crc")) - 1
    out = dealt.withColumn("slot", slot).join(offsets.hint("merge"), ["shard", "bucket"])
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        (F.col("slot") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 20240601) -> DataFrame:
    """All rows and columns of ``docs`` with their ``shard`` and ``slot``, which take the place of columns of these names.

    The rows travel once: decisions join them by id, checksum and the number among rows alike in both.
    Write the result with ``partitionBy("shard")``.
    """
    where = shuffle_into_shards(docs, shards, id_col, text_col, seed).select(F.col(id_col).alias("of"), F.col("text_crc32").alias("sum"), "shard", "slot")
    where = where.withColumn("turn", F.row_number().over(Window.partitionBy("of", "sum").orderBy("shard", "slot")))
    text = F.coalesce(F.col("row").getField(text_col), F.lit("")).cast("binary")
    marked = packed(docs).select("row", F.col("row").getField(id_col).alias("id"), F.crc32(text).alias("crc"))
    marked = marked.withColumn("nth", F.row_number().over(Window.partitionBy("id", "crc").orderBy(F.lit(0))))
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("crc") == F.col("sum")) & (F.col("nth") == F.col("turn"))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return marked.join(where.hint("merge"), same).select(*kept, "shard", "slot")
