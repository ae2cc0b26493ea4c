"""The two decimal roundings the climate reports are defined with.

``round_array``  scales, rounds half to even and scales back (array-library rounding).
``round_scalar`` rounds the exact binary value, as Python's built-in ``round`` does.
Spark's own ``round`` works on the shortest decimal text of a double and rounds half up, which
gives other answers on ties such as 27.25 (27.2 here) or 1.005 (1.0 here).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2^27 + 1: splits a double into a 26-bit head and an exact tail.
SPLIT = 134217729.0


def _has_digits(c: Column, scale: Column) -> Column:
    """False from where a double is whole at this scale: rounding can't change it there."""
    return F.abs(c) < F.lit(2.0**52) / scale


def round_array(c: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    # Adding zero turns -0.0 into 0.0.
    return F.when(_has_digits(c, scale), F.rint(c * scale) / scale + 0.0).otherwise(c)


def round_scalar(c: Column, digits: int) -> Column:
    """Exact for up to six digits wherever a double has digits to round, else the value itself."""
    scale = F.lit(float(10**digits))
    head = c * SPLIT - (c * SPLIT - c)
    # floor gives a whole number of 64 bits, which is wide enough below 2^52.
    low = F.floor(c * scale).cast("double")
    # Signed distance of the exact product from the midpoint between low and low + 1.
    above_mid = (head * scale - (low + 0.5)) + (c - head) * scale
    up = (above_mid > 0) | ((above_mid == 0) & (low % 2 != 0))
    return F.when(_has_digits(c, scale), (low + F.when(up, 1.0).otherwise(0.0)) / scale).otherwise(c)
