"""Time series, mosaics, composites and second moments on stored tiles.

Tiles of one place are brought together as arrays, one row per tile and time, and worked on in numpy; cells are
never exploded. A group holds times x bands x cells values of one tile: 36 times of 7 bands of 256 x 256 cells are
132 MB, so choose bands first where the time axis is long.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import scale_offset
from ..functions.colour import to_byte
from ..functions.kernels import savgol_weights
from ..schema import TILES
from .render import composite_bands

PLACE = ["layer", "zoom", "tile_x", "tile_y"]


def stack_of(bands: pa.ChunkedArray) -> np.ndarray:
    """Band arrays of several tiles of one shape as (tile, band, cell), NaN where there is no value."""
    whole = pa.concat_arrays(bands.chunks) if bands.num_chunks else pa.array([], bands.type)
    count = len(whole[0]) if len(whole) else 0
    flat = whole.flatten().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(whole), count, -1 if len(flat) else 0)


def bands_of(stack: np.ndarray) -> pa.Array:
    """The reverse of stack_of."""
    tiles, bands, cells = stack.shape
    flat = stack.ravel()
    inner = pa.ListArray.from_arrays(np.arange(tiles * bands + 1, dtype="int32") * cells, pa.array(flat, mask=np.isnan(flat)))
    return pa.ListArray.from_arrays(np.arange(tiles + 1, dtype="int32") * bands, inner)


def in_time_order(table: pa.Table) -> pa.Table:
    return table.sort_by("time_index")


def with_bands(table: pa.Table, stack: np.ndarray) -> pa.Table:
    at = table.column_names.index("bands")
    return table.set_column(at, "bands", bands_of(stack))


def compacted(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each series with its values first, in time order; the order taken, and how many values there are."""
    empty = np.isnan(stack)
    order = np.argsort(empty, axis=0, kind="stable")
    return np.take_along_axis(stack, order, axis=0), order, (~empty).sum(axis=0)


def smooth(stack: np.ndarray, window: int, degree: int) -> np.ndarray:
    """Savitzky-Golay along the first axis, by rank among the values that are there; the ends stay."""
    values, order, count = compacted(stack)
    half, steps = window // 2, len(values)
    total = np.zeros_like(values)
    for offset, weight in sorted(savgol_weights(window, degree).items()):
        total += weight * values[np.clip(np.arange(steps) + offset, 0, max(0, steps - 1))]
    rank = np.arange(steps).reshape(-1, 1, 1)
    inner = (rank >= half) & (rank < count - half)
    out = np.empty_like(values)
    np.put_along_axis(out, order, np.where(inner, total, values), axis=0)
    return out


def tile_savgol(tiles: DataFrame, window: int = 5, degree: int = 2) -> DataFrame:
    """Savitzky-Golay smoothing of every cell along time, as series.savgol on cells."""
    if window < 3 or degree >= window:
        raise ValueError("need window >= 3 and degree < window")

    def run(table: pa.Table) -> pa.Table:
        table = in_time_order(table)
        return with_bands(table, smooth(stack_of(table.column("bands")), window, degree))

    return _grouped(tiles, PLACE, run)


def tile_latest(tiles: DataFrame, from_time: int | None = None, to_time: int | None = None) -> DataFrame:
    """One tile per place with the most recent value of every cell; `times` has when that was, band by band."""
    from .series import time_range

    def run(table: pa.Table) -> pa.Table:
        table = in_time_order(table)
        stack = stack_of(table.column("bands"))
        values, order, count = compacted(stack)
        last = np.maximum(count - 1, 0)[None]
        time = table.column("time_index").to_numpy()[np.take_along_axis(order, last, axis=0)].astype(float)
        time[0][count == 0] = np.nan
        newest = with_bands(table.slice(table.num_rows - 1, 1), np.take_along_axis(values, last, axis=0))
        return newest.append_column("times", bands_of(time))

    return _grouped(time_range(tiles, from_time, to_time), PLACE, run, TILES + ", times array<array<double>>")


def tile_mosaic(tiles: DataFrame, priority: str, ascending: bool = True, name: str = "merged") -> DataFrame:
    """Overlapping tiles of one key and time as one: each cell has the value of the best priority that has one.

    priority is an integer column of tiles; ties go by layer name.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_p", "ascending" if ascending else "descending"), ("layer", "ascending")])
        stack = stack_of(table.column("bands"))
        first = np.argmax(~np.isnan(stack), axis=0)[None]
        merged = with_bands(table.slice(0, 1).drop_columns(["_p"]), np.take_along_axis(stack, first, axis=0))
        return merged.set_column(0, "layer", pa.array([name]))

    return _grouped(tiles.withColumn("_p", F.col(priority).cast("bigint")), ["zoom", "tile_x", "tile_y", "time_index"], run, extra=["_p"])


def tile_rgb_composite(
    tiles: DataFrame, bands: list[int] | None = None, no_of_bands: int = 7, scale=1.0, offset=0.0, vmin=0.0, vmax=1.0
) -> DataFrame:
    """Three bands of every tile to byte arrays r, g, b and alpha; no shuffle."""

    def byte(n: int) -> Column:
        return F.transform(F.get("bands", F.lit(n - 1)), lambda v: to_byte(scale_offset(v, scale, offset), vmin, vmax))

    r, g, b = (byte(n) for n in composite_bands(bands, no_of_bands))
    out = tiles.select(*PLACE, "time_index", "cols", "rows", r.alias("r"), g.alias("g"), b.alias("b"))
    some = F.zip_with(F.zip_with("r", "g", lambda x, y: x + y), "b", lambda x, y: F.when(x + y > 0, 255).otherwise(0))
    return out.withColumn("a", some)


def tile_fpca_gram(tiles: DataFrame, steps: list[int], band: int = 1) -> DataFrame:
    """Upper triangle of the second moments (i, j, g) of one band over `steps`, as fpca.fpca_gram on cells.

    Every place gives one small matrix; only those are added up. Steps that are not listed are left out, and several tiles of
    a step count with the mean of each cell.
    """
    order = np.array(sorted(set(steps)))
    n = len(order)

    def run(table: pa.Table) -> pa.Table:
        stack = stack_of(table.column("bands"))[:, 0]
        where = np.searchsorted(order, table.column("time_index").to_numpy())
        there = ~np.isnan(stack)
        total, times = np.zeros((n, stack.shape[1])), np.zeros((n, stack.shape[1]))
        np.add.at(total, where, np.where(there, stack, 0.0))
        np.add.at(times, where, there)
        m = total / np.maximum(times, 1)
        i, j = np.triu_indices(n)
        pixels = int((times.sum(axis=0) > 0).sum())
        return pa.table({"i": i.astype("int32"), "j": j.astype("int32"), "g": (m @ m.T)[i, j], "t": np.full(len(i), pixels)})

    picked = tiles.filter(F.col("time_index").isin([int(s) for s in order])).withColumn(
        "bands", F.array(F.get("bands", F.lit(band - 1)))
    )
    parts = picked.select(*PLACE, "time_index", "bands").groupBy(*PLACE).applyInArrow(run, "i int, j int, g double, t bigint")
    return parts.groupBy("i", "j").agg((F.sum("g") / F.sum("t")).alias("g"))


def _grouped(
    tiles: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table], schema: str = TILES, extra: list[str] | None = None
) -> DataFrame:
    columns = [c.split()[0] for c in TILES.split(", ")]
    return tiles.select(*columns, *(extra or [])).groupBy(*keys).applyInArrow(run, schema)
