from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    """A Column as it is, a string as a column name, anything else as a literal."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def long_col(value) -> Column:
    return as_col(value).cast("bigint")


def pow2(exponent) -> Column:
    """2**exponent as bigint, exact."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), as_col(exponent).cast("int"))


def intdiv(a, b) -> Column:
    """Floor of a / b for b > 0, in integers. `div` truncates, so negatives are shifted."""
    a, b = long_col(a), long_col(b)
    return F.call_function("div", a - F.pmod(a, b), b)
