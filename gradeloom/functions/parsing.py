"""Values out of text columns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed words that mean true.
TRUE_WORDS = ["1", "true", "yes", "y"]


def parse_box(text: str) -> tuple[Column, Column]:
    """The box (an array of four doubles, or null) in a JSON text, and the reason where there is none."""
    box = F.from_json(F.col(text), "array<double>")
    bad = F.exists(box, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.when(box.isNull(), "not a list").when(F.size(box) != 4, "not four numbers").when(bad, "not finite")
    return F.when(reason.isNull(), box), reason


def parse_bool(text: str) -> Column:
    """True for the words of truth in any case and with spaces around; false for all else, null too."""
    return F.coalesce(F.lower(F.trim(text)).isin(TRUE_WORDS), F.lit(False))


def first_float(*columns: str) -> Column:
    """The first value that is not empty, as a number; null if it is none or all are empty."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns]).try_cast("double")


def normalise_pair(a: str, b: str) -> Column:
    """The second of two masses over their sum; null where one is negative or the sum is zero."""
    return F.when((F.col(a) >= 0) & (F.col(b) >= 0) & (F.col(a) + F.col(b) > 0), F.col(b) / (F.col(a) + F.col(b)))
