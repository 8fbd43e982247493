"""Resampling, reprojection and enlarging.

Values sit at cell centres. Interpolation to another grid runs on blocks of cells and exchanges their borders (see halo); nearest sends
each source cell to the target cells it is nearest to, without a shuffle. Pyramids are in levels.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._col import pow2
from ..functions.grid import (
    EARTH_RADIUS,
    MAX_ZOOM,
    ancestor,
    mercator_lat,
    mercator_lon,
    mercator_x,
    mercator_y,
)
from ..functions.kernels import SUPPORT
from ..plans.joins import small_join
from .halo import blocks_of_cells, blocks_of_tiles, exchanged, resampling, weighted
from .layout import Grid


@dataclass(frozen=True)
class Axis:
    """One target axis: number of cells, index -> source coordinate, coordinate -> fractional index."""

    size: int
    coord: Callable[[Column], Column]
    index: Callable[[Column], Column]


def _axes(dst: Grid, cols: int, rows: int, mercator: bool) -> tuple[Axis, Axis]:
    """Target axes in the source's degrees; a mercator target has its grid in metres."""
    to_x, to_y = (mercator_x, mercator_y) if mercator else (lambda v: v, lambda v: v)
    from_x, from_y = (mercator_lon, mercator_lat) if mercator else (lambda v: v, lambda v: v)
    x = Axis(cols, lambda i: from_x(dst.x(i)), lambda lon: (to_x(lon) - dst.x0) / dst.dx - 0.5)
    y = Axis(rows, lambda j: from_y(dst.y(j)), lambda lat: (F.lit(dst.y0) - to_y(lat)) / dst.dy - 0.5)
    return x, y


def _clamped_range(low: Column, high: Column, size: int) -> Column:
    """Indices low..high (one spare on each side) inside 0..size-1; empty when outside."""
    a = F.greatest(F.floor(low).cast("int") - 1, F.lit(0))
    b = F.least(F.ceil(high).cast("int") + 1, F.lit(size - 1))
    return F.when(a <= b, F.sequence(a, b))


def _scatter(cells: DataFrame, src: Grid, x: Axis, y: Axis) -> DataFrame:
    """Every source cell at the target cells i, j whose centres it is nearest to."""
    left, right = src.x(F.col("col") - 0.5), src.x(F.col("col") + 0.5)
    top, bottom = src.y(F.col("row") - 0.5), src.y(F.col("row") + 0.5)
    at_i = cells.filter(F.col("value").isNotNull()).withColumn(
        "i", F.explode(_clamped_range(x.index(left), x.index(right), x.size))
    )
    at_i = at_i.filter(F.floor((x.coord(F.col("i")) - src.x0) / src.dx) == F.col("col"))
    at_j = at_i.withColumn("j", F.explode(_clamped_range(y.index(top), y.index(bottom), y.size)))
    return at_j.filter(F.floor((F.lit(src.y0) - y.coord(F.col("j"))) / src.dy) == F.col("row"))


def resample(
    cells: DataFrame, src: Grid, dst: Grid, cols: int, rows: int, method: str = "bilinear", mercator: bool = False, fill_cancelled: bool = False
) -> DataFrame:
    """Cells on another grid, layer by layer; method is nearest, bilinear or cubic.

    Nearest sends each cell to its targets. The others bring the cells together in blocks, once, and interpolate on
    arrays; only partial sums along the blocks' borders are exchanged (see halo). Missing neighbours drop out and the weights
    are renormalised; where the weights that are left cancel there is no value, or, with fill_cancelled, the mean of the values by the
    size of their weights, so that every target cell that a weight reaches has one. Two values for a cell are an error.
    """
    if method == "nearest":
        x, y = _axes(dst, cols, rows, mercator)
        out = _scatter(cells, src, x, y).select("layer", "time_index", "i", "j", "band", "value")
        return _as_cells(out)
    return _interpolated(blocks_of_cells(cells), src, dst, cols, rows, method, mercator, fill_cancelled)


def resample_tiles(
    tiles: DataFrame, src: Grid, dst: Grid, cols: int, rows: int, method: str = "bilinear", mercator: bool = False, fill_cancelled: bool = False
) -> DataFrame:
    """resample for stored tiles, bilinear or cubic: the tiles' arrays stay where they are and only border sums are shuffled."""
    return _interpolated(blocks_of_tiles(tiles), src, dst, cols, rows, method, mercator, fill_cancelled)


def _interpolated(
    blocks: DataFrame, src: Grid, dst: Grid, cols: int, rows: int, method: str, mercator: bool, fill_cancelled: bool = False
) -> DataFrame:
    if method not in SUPPORT:
        raise ValueError(f"unknown resampling method {method}")
    x, y = dst.x0 + (np.arange(cols) + 0.5) * dst.dx, dst.y0 - (np.arange(rows) + 0.5) * dst.dy
    if mercator:  # places of the target's rows and columns in degrees
        x, y = np.degrees(x / EARTH_RADIUS), np.degrees(np.arctan(np.sinh(y / EARTH_RADIUS)))
    kernel = resampling((x - src.x0) / src.dx - 0.5, (src.y0 - y) / src.dy - 0.5, method, fill_cancelled)
    found = exchanged(blocks, kernel, ("a",) if fill_cancelled else ())
    value = weighted(F.col("s"), F.col("w"), F.col("size"))
    return _as_cells(found.withColumn("value", F.coalesce(value, F.col("a") / F.col("size")) if fill_cancelled else value))


def _as_cells(out: DataFrame) -> DataFrame:
    return out.filter(F.col("value").isNotNull()).select(
        "layer", "time_index", F.col("i").alias("col"), F.col("j").alias("row"), "band", "value"
    )


def reproject_webmercator(cells: DataFrame, src: Grid, dst: Grid, cols: int, rows: int, method: str = "bilinear") -> DataFrame:
    """Degrees to a Web Mercator grid given in metres."""
    return resample(cells, src, dst, cols, rows, method, mercator=True)


def overzoom(requests: DataFrame, tile_cells: DataFrame, max_zoom: int = MAX_ZOOM, size: int = 256) -> DataFrame:
    """Requested tiles beyond the stored zoom: the matching window of the ancestor, blown up.

    requests: request_id, z, x, y, and `layer` where each asks for one. tile_cells: layer, zoom, tile_x, tile_y, time_index,
    band, col, row, value. Output: request_id, layer, time_index, band, col, row, value. A tile at or below max_zoom is
    returned as it is stored.
    """
    dz = F.greatest(F.col("z") - max_zoom, F.lit(0))
    asked = ["layer"] if "layer" in requests.columns else []
    up = requests.withColumn("_dz", dz).withColumn("_a", ancestor("x", "y", F.col("_dz")))
    keyed = up.select(
        "request_id",
        *asked,
        F.col("_dz"),
        (F.col("z") - F.col("_dz")).cast("int").alias("zoom"),
        F.col("_a.tile_x").alias("tile_x"),
        F.col("_a.tile_y").alias("tile_y"),
        (F.col("_a.off_x") * size).alias("_ox"),
        (F.col("_a.off_y") * size).alias("_oy"),
    )
    # a request meets up to a tile of cells for each time and band
    hits = small_join(tile_cells, keyed, [*asked, "zoom", "tile_x", "tile_y"], ["request_id"], meets=size * size)
    n = pow2("_dz")

    def targets(cell: str, origin: str) -> Column:
        low = F.greatest(F.col(cell) * n - F.col(origin), F.lit(0).cast("bigint"))
        high = F.least((F.col(cell) + 1) * n - 1 - F.col(origin), F.lit(size - 1).cast("bigint"))
        return F.when(low <= high, F.sequence(low, high))

    return (
        hits.withColumn("_i", F.explode(targets("col", "_ox")))
        .withColumn("_j", F.explode(targets("row", "_oy")))
        .select(
            "request_id", "layer", "time_index", "band", F.col("_i").cast("int").alias("col"), F.col("_j").cast("int").alias("row"), "value"
        )
    )
