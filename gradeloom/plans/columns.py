"""Working columns beside rows whose own column names are not known beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct ``row``, so that no name of theirs meets that of a working column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame) -> DataFrame:
    """The columns that ``packed`` put away."""
    return df.select("row.*")
