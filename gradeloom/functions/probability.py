"""Probabilities of the four classes ``kind * 2 + grade`` as columns ``j0`` to ``j3``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOINT = ("j0", "j1", "j2", "j3")
#: Fixed floor of probabilities before a logarithm.
FLOOR = 1e-15


def joint(df: DataFrame, kind: str = "k1", grade0: str = "g0", grade1: str = "g1") -> DataFrame:
    """Add the joint probabilities from that of kind 1 and those of grade 1 under each kind."""
    k, g0, g1 = F.col(kind), F.col(grade0), F.col(grade1)
    return df.withColumns({"j0": (1 - k) * (1 - g0), "j1": (1 - k) * g0, "j2": k * (1 - g1), "j3": k * g1})


def decompose(df: DataFrame) -> DataFrame:
    """Add ``k1, g0, g1``: the kind and the grades under each kind that the joint probabilities hold."""
    zero, one = F.col("j0") + F.col("j1"), F.col("j2") + F.col("j3")
    return df.withColumns({"k1": one / F.greatest(zero + one, F.lit(FLOOR)), "g0": F.col("j1") / F.greatest(zero, F.lit(FLOOR)), "g1": F.col("j3") / F.greatest(one, F.lit(FLOOR))})


def argmax(*columns: str) -> Column:
    """Place of the greatest column, from 0; the first one wins ties."""
    top = F.greatest(*columns)
    out = F.when(F.col(columns[0]) >= top, 0)
    for place, c in enumerate(columns[1:], start=1):
        out = out.when(F.col(c) >= top, place)
    return out


def log_clipped(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(FLOOR)))


def temperature(p: Column, t: Column) -> Column:
    """The softmax of the two log probabilities of ``p`` and ``1 - p`` over ``t``, as the new ``p``."""
    return 1 / (1 + F.exp((log_clipped(1 - p) - log_clipped(p)) / t))


def logit_bias(p: Column, bias: Column) -> Column:
    """``p`` after ``bias`` is added to its log before the softmax."""
    return 1 / (1 + F.exp(log_clipped(1 - p) - log_clipped(p) - bias))


def log_spaced(low: float, high: float, n: int) -> list[float]:
    """``n`` values from ``low`` to ``high`` at equal ratios, and 1."""
    step = (math.log(high) - math.log(low)) / (n - 1)
    return sorted({round(math.exp(math.log(low) + i * step), 6) for i in range(n)} | {1.0})
