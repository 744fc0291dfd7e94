"""Division that never fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def over_or(a: Column, b: Column, default: float) -> Column:
    """a / b, or the default where b is zero."""
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def ieee_over(a: Column, b: Column) -> Column:
    """a / b as floating point has it: infinite where b is zero, NaN where both are."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))
