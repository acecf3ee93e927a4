"""Number rules that differ from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_binary(x: Column, digits: int) -> Column:
    """A double rounded as C's ``round`` of x * 10 ** digits, halves away from zero; Spark's ``round`` goes by decimal digits and drops the sign of a zero.

    Zeros keep their sign, and small negative values become -0.0; values whose product isn't finite stay as they are.
    """
    scaled = x * float(10**digits)
    near = F.round(F.abs(scaled)) * F.signum(scaled) / float(10**digits)
    return F.when(F.abs(scaled) < float("inf"), near).otherwise(x)
