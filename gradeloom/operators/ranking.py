"""Numbers and sums of groups where a few groups may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.operators.hot_keys import look_up
from gradeloom.plans.durable import written


def beside_group(df: DataFrame, key: str, **values: Column) -> DataFrame:
    """``df`` with aggregates of the row's group as columns; null is a group. Large groups are met where their rows lie."""
    table = written(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[v.alias(name) for name, v in values.items()]))
    number = table.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    known = look_up(df.filter(F.col(key).isNotNull()), table.filter(F.col(key).isNotNull()), key, number)
    none = table.filter(F.col(key).isNull()).drop("_n", key)  # one row at most
    return known.select(*df.columns, *values).unionByName(df.filter(F.col(key).isNull()).crossJoin(F.broadcast(none)))


def numbered(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the row's number in its group by a total ``order``, from 1.

    Rows are dealt into ranges of (key, order); numbers inside a range get the rows of the group's ranges before it,
    so that no task holds a whole group. There are at most as many offsets as groups and ranges together.
    """
    ranged = written(df.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()))
    sizes = written(ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = ranged.withColumn(name, F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)))
    out = own.join(offsets.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_key", "_of", "_before", "_range")
