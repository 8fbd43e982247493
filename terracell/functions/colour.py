"""Values to colours, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col

GREYSCALE = ["#000000ff", "#ffffffff"]


def _channel(colour: Column, start: int) -> Column:
    text = F.regexp_replace(colour, "^#", "")
    return F.conv(F.substring(text, start, 2), 16, 10).cast("double")


def color_ramp(value, low, high, ramp=None) -> Column:
    """RGBA by linear interpolation over evenly spaced stops between low and high.

    `ramp` is a list of #rrggbbaa stops or an array<string> column. Less than one stop's width above
    the range is the last colour; null and all else outside the range are transparent.
    """
    ramp = GREYSCALE if ramp is None else ramp
    stops = F.array(*[F.lit(c) for c in ramp]) if isinstance(ramp, (list, tuple)) else as_col(ramp)
    value, low, high = as_col(value), as_col(low), as_col(high)
    last = F.size(stops) - 1
    at = (value - low) / F.nullif(high - low, F.lit(0.0)) * last
    index = F.floor(at).cast("int")
    start = F.get(stops, index)
    end = F.get(stops, F.least(index + 1, last))
    share = at - index
    inside = at.isNotNull() & (index >= 0) & (index <= last)

    def mix(pos: int) -> Column:
        a, b = _channel(start, pos), _channel(end, pos)
        return F.when(inside, F.floor(b * share + a * (1.0 - share) + 0.5).cast("int")).otherwise(F.lit(0))

    return F.struct(mix(1).alias("r"), mix(3).alias("g"), mix(5).alias("b"), mix(7).alias("a"))


def class_of(value, low, high, steps) -> Column:
    """Class number 1..steps; 0 below the range, steps + 1 from its upper end."""
    return F.width_bucket(
        as_col(value).cast("double"),
        as_col(low).cast("double"),
        as_col(high).cast("double"),
        as_col(steps).cast("bigint"),
    ).cast("int")


def class_break(index, low, high, steps) -> Column:
    """Lower edge of class `index` (1-based)."""
    low, high = as_col(low).cast("double"), as_col(high).cast("double")
    return low + (high - low) * (as_col(index) - 1) / as_col(steps)


def to_byte(value, vmin=0.0, vmax=1.0) -> Column:
    """Scale vmin..vmax to 0..255, cut to int and clamp; null is 0."""
    scaled = F.floor(255.0 * (as_col(value) - as_col(vmin)) / (as_col(vmax) - as_col(vmin)))
    # least and greatest pass over nulls, so null is asked for first
    clamped = F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(255).cast("bigint"), scaled))
    return F.when(scaled.isNull(), F.lit(0)).otherwise(clamped.cast("int"))
