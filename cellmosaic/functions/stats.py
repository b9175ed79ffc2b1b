"""Statistics of paired predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mcnemar(b: Column, c: Column) -> Column:
    """Edwards' corrected statistic from the two kinds of disagreement; 0 without any."""
    return F.when(b + c == 0, F.lit(0.0)).otherwise(F.pow(F.abs(b - c) - 1, F.lit(2)).cast("double") / (b + c).cast("double"))


def mcnemar_p(statistic: float) -> float:
    """The chance of a larger statistic: chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(statistic / 2))


def purity_band(purity: Column) -> Column:
    return F.when(purity >= 1, "pure").when(purity >= 0.75, "0.75-1.0").otherwise("<0.75")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))
