"""Joins of many rows with one row for each key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys can each hold more than this share of the rows, so their table may be broadcast.
HOT_KEYS = 1000


def look_up(rows: DataFrame, table: DataFrame, key: str | list[str], number: int, count: str = "_n", small: bool = False) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key (of one column or several) and in ``count`` the number of rows that name it.

    ``number`` is at least the number of rows. Keys with over a thousandth of it (at most 1000 of them, whatever
    the data) meet their rows where these lie; all others are shuffled. Rows with a null key or one that
    the table lacks are left out. Both inputs are read more than once: give tables that are written out.
    A table of which ``plans.durable.is_small`` was asked (``small``) meets all rows where they lie.
    """
    keys = [key] if isinstance(key, str) else key
    if small:
        return rows.join(F.broadcast(table.drop(count)), keys)
    limit = max(256, number // HOT_KEYS)
    hot = table.filter(F.col(count) > limit).drop(count)
    cold = table.filter(F.col(count) <= limit).drop(count)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)
