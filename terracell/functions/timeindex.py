"""Acquisition times: seconds since 1990-01-01 UTC, and the shapes they arrive in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col, long_col

EPOCH_1990 = 631152000  # 1990-01-01T00:00:00Z in unix seconds
DAY = 86400
STEP_DAYS = 10
STEPS_PER_YEAR = 36


def ts_to_time_index(ts, epoch: int = EPOCH_1990) -> Column:
    return F.unix_seconds(as_col(ts).cast("timestamp")) - F.lit(epoch).cast("bigint")


def millis_to_time_index(ms, epoch: int = EPOCH_1990) -> Column:
    """Epoch milliseconds to a time index; fractions are cut towards zero."""
    delta = long_col(ms) - F.lit(epoch * 1000).cast("bigint")
    return F.call_function("div", delta, F.lit(1000).cast("bigint"))


def time_index_to_ts(time_index, epoch: int = EPOCH_1990) -> Column:
    return F.timestamp_seconds(long_col(time_index) + F.lit(epoch))


def parse_day(text) -> Column:
    """`yyyy-MM-dd` to the start of that day; null when malformed."""
    return F.try_to_timestamp(as_col(text), F.lit("yyyy-MM-dd"))


def parse_instant(text) -> Column:
    """ISO instant such as 2018-12-13T04:30:04Z; null when malformed."""
    return F.try_to_timestamp(as_col(text))


def scene_time_from_mtl(date_acquired, scene_center_time) -> Column:
    """Scene time from the date and the first eight characters of the centre time."""
    text = F.concat_ws(" ", as_col(date_acquired), F.substring(as_col(scene_center_time), 1, 8))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def scene_time_from_filename(name) -> Column:
    """`a_b_c_YYYY_MM.tif` to the first of that month; null when the name does not fit."""
    parts = F.split(F.regexp_replace(as_col(name), r"\.tif$", ""), "_")
    year = F.get(parts, F.lit(3)).try_cast("int")
    month = F.get(parts, F.lit(4)).try_cast("int")
    ok = year.isNotNull() & month.between(1, 12)
    return F.when(ok, F.make_date(year, month, F.lit(1)).cast("timestamp"))


def year_from_path(path) -> Column:
    """Year in the name of a raster file. A raster written by Spark is a folder of part files, so
    a part file takes its folder's name."""
    name = F.regexp_extract(as_col(path), r"([^/]*)(?:/part-[^/]*)?$", 1)
    return F.regexp_extract(name, r"((?:19|20)\d{2})", 1).try_cast("int")


def year_start(year) -> Column:
    return F.make_date(as_col(year).cast("int"), F.lit(1), F.lit(1)).cast("timestamp")


def slot_before(time_index, latest, step_days: int = STEP_DAYS) -> Column:
    """Whole steps between a time and the latest time of its series."""
    return F.call_function(
        "div", long_col(latest) - long_col(time_index), F.lit(step_days * DAY).cast("bigint")
    ).cast("int")
