"""Per-value and per-array band arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col

#: Spark type of each raster cell type.
CELL_TYPES = {
    "int8": "tinyint",
    "uint8": "smallint",
    "int16": "smallint",
    "uint16": "int",
    "int32": "int",
    "float32": "float",
    "float64": "double",
}


def pick_bands(bands, numbers: list[int]) -> Column:
    """Pick and reorder entries of a bands array by 1-based number; a missing band is null."""
    if not numbers or min(numbers) < 1:
        raise ValueError("band numbers start at 1")
    bands = as_col(bands)
    return F.array(*[F.get(bands, F.lit(n - 1)) for n in numbers])


def nodata_to_null(value, nodata: float | None = None) -> Column:
    value = as_col(value).cast("double")
    bad = F.isnan(value)
    if nodata is not None:
        bad = bad | (value == F.lit(float(nodata)))
    return F.when(~bad, value)


def to_cell_type(value, cell_type: str) -> Column:
    """Cast a cell value; what does not fit the type becomes null."""
    return as_col(value).try_cast(CELL_TYPES[cell_type])


def normalized_difference(a, b) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0, null where a side is null."""
    a, b = as_col(a), as_col(b)
    total = a + b
    return F.when(total == 0, F.lit(0.0)).when(total.isNotNull(), (a - b) / total)


def normalized_percent(a, b, nodata: int = -99) -> Column:
    """100 * (a - b) / (a + b) cut to int; the NoData code where both are 0 or the sum is 0."""
    a, b = as_col(a), as_col(b)
    total = a + b
    return (
        F.when(total == 0, F.lit(nodata))
        .when(total.isNotNull(), (((a - b) / total) * 100.0).cast("int"))
    )


def scale_offset(value, scale, offset) -> Column:
    return as_col(value) * as_col(scale) + as_col(offset)


def rescale_16_to_8(value) -> Column:
    return F.floor(as_col(value) * 256 / 65536).cast("int")


def stretch(value, low, high) -> Column:
    """255 * (v - low) / (high - low) cut to int; null when the range is empty.

    A result within 1e-9 below a whole number counts as that number.
    """
    value, low, high = as_col(value), as_col(low), as_col(high)
    span = high - low
    return F.when(span != 0, F.floor(255.0 * (value - low) / span + 1e-9).cast("int"))
