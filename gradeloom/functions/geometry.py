"""Measures of boxes ``x1, y1, x2, y2`` and of fingerprints as columns, and their SQL names."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}").cast("double") for c in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    """Zero where the corners are out of order."""
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def shared(a: Box, b: Box) -> Column:
    return area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))


def iou(a: Box, b: Box) -> Column:
    """Shared area over that of the union; 0 for two empty boxes."""
    return shared(a, b) / F.greatest(area(a) + area(b) - shared(a, b), F.lit(1e-9))


def inside_smaller(a: Box, b: Box) -> Column:
    """Shared area over that of the smaller box."""
    return shared(a, b) / F.greatest(F.least(area(a), area(b)), F.lit(1e-9))


def coverage(inner: Box, outer: Box) -> Column:
    """The share of ``inner`` that lies in ``outer``."""
    return shared(inner, outer) / F.greatest(area(inner), F.lit(1e-9))


def translate(b: Box, dx: Column | float, dy: Column | float) -> Box:
    dx, dy = (x if isinstance(x, Column) else F.lit(x) for x in (dx, dy))
    return b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy


def register_sql(spark: SparkSession) -> None:
    """Temporary SQL functions: ``hamming64``, ``box_iou``, ``first_argmax``, ``softmax_at`` (all plain SQL expressions)."""
    overlap = "greatest(least(ax2, bx2) - greatest(ax1, bx1), 0D) * greatest(least(ay2, by2) - greatest(ay1, by1), 0D)"
    size = "greatest({0}x2 - {0}x1, 0D) * greatest({0}y2 - {0}y1, 0D)"
    corners = ", ".join(f"{b}{c} DOUBLE" for b in "ab" for c in ("x1", "y1", "x2", "y2"))
    for text in (
        "hamming64(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)",
        f"box_iou({corners}) RETURNS DOUBLE RETURN {overlap} / greatest({size.format('a')} + {size.format('b')} - {overlap}, 1e-9D)",
        "first_argmax(p ARRAY<DOUBLE>) RETURNS BIGINT RETURN array_position(p, array_max(p)) - 1",
        "softmax_at(p ARRAY<DOUBLE>, t DOUBLE) RETURNS ARRAY<DOUBLE> RETURN transform(p, x -> power(greatest(x, 1e-15D), 1 / t) / aggregate(p, 0D, (s, y) -> s + power(greatest(y, 1e-15D), 1 / t)))",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
