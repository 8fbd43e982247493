"""Cells and tiles: conversion, re-cutting, metadata, windows.

Tile arrays are bounded by tile size times bands, strips by their segment length, so no
collect_list here grows with the layer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._col import as_col, intdiv
from ..functions.bands import to_cell_type
from ..functions.grid import MAX_LAT, cell_x, cell_y, lat_to_tile_y, tile_lat, tile_lon
from ..schema import TILES


@dataclass(frozen=True)
class Grid:
    """Geometry of a layer: top left corner and cell size, in degrees."""

    x0: float
    y0: float
    dx: float
    dy: float

    def x(self, col="col") -> Column:
        return cell_x(as_col(col), self.x0, self.dx)

    def y(self, row="row") -> Column:
        return cell_y(as_col(row), self.y0, self.dy)

    def col_of(self, lon) -> Column:
        return F.floor((as_col(lon) - self.x0) / self.dx).cast("int")

    def row_of(self, lat) -> Column:
        return F.floor((F.lit(self.y0) - as_col(lat)) / self.dy).cast("int")

    def rows_between(self, high, low) -> tuple[Column, Column]:
        """First and last row whose centre may lie between two latitudes."""
        at = [(F.lit(self.y0) - as_col(lat)) / self.dy - 0.5 for lat in (high, low)]
        return F.floor(at[0]).cast("int"), F.ceil(at[1]).cast("int")


@dataclass(frozen=True)
class SlippyGrid:
    """Geometry of one level of slippy tiles with `cols` x `rows` cells, numbered through: tile number times tile size plus offset.

    Within a tile the cells are even in longitude and latitude, as everywhere here.
    """

    zoom: int
    cols: int
    rows: int

    @property
    def x0(self) -> float:
        return -180.0

    @property
    def dx(self) -> float:
        return 360.0 / (2**self.zoom * self.cols)

    def x(self, col="col") -> Column:
        tile, at = intdiv(col, self.cols), F.pmod(as_col(col), F.lit(self.cols))
        left, right = tile_lon(tile, F.lit(self.zoom)), tile_lon(tile + 1, F.lit(self.zoom))
        return left + (at + 0.5) * (right - left) / self.cols

    def y(self, row="row") -> Column:
        tile, at = intdiv(row, self.rows), F.pmod(as_col(row), F.lit(self.rows))
        top, bottom = tile_lat(tile, F.lit(self.zoom)), tile_lat(tile + 1, F.lit(self.zoom))
        return top - (at + 0.5) * (top - bottom) / self.rows

    def rows_between(self, high, low) -> tuple[Column, Column]:
        """First and last row whose centre may lie between two latitudes."""

        def at(lat):
            lat = F.greatest(F.lit(-MAX_LAT), F.least(as_col(lat), F.lit(MAX_LAT)))
            tile = lat_to_tile_y(lat, F.lit(self.zoom))
            top, bottom = tile_lat(tile, F.lit(self.zoom)), tile_lat(tile + 1, F.lit(self.zoom))
            return tile * self.rows + (top - lat) / (top - bottom) * self.rows - 0.5

        end = 2**self.zoom * self.rows - 1
        return F.greatest(F.floor(at(high)) - 1, F.lit(0)).cast("int"), F.least(F.ceil(at(low)) + 1, F.lit(end)).cast("int")


def wide_to_cells(wide: DataFrame, bands: list[str], keys: list[str] | None = None) -> DataFrame:
    """One column per band to one row per band; band numbers follow the list, from 1."""
    keys = keys or ["layer", "time_index", "col", "row"]
    values = F.array(*[F.col(b).cast("double") for b in bands])
    return wide.select(*keys, F.posexplode(values).alias("pos", "value")).select(
        *keys, (F.col("pos") + 1).alias("band"), "value"
    )


def cells_to_wide(cells: DataFrame, bands: list[int], keys: list[str] | None = None) -> DataFrame:
    """One row per pixel and time with a column b<n> per band: one shuffle, partial aggregation."""
    keys = keys or ["layer", "time_index", "col", "row"]
    picks = [F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"b{b}") for b in bands]
    return cells.filter(F.col("band").isin(bands)).groupBy(*keys).agg(*picks)


def select_bands(cells: DataFrame, numbers: list[int], renumber: bool = True, no_of_bands: int | None = None) -> DataFrame:
    """Keep the listed 1-based bands; with renumber they become 1..n in list order.

    With the dataset's no_of_bands, a number beyond it is an error instead of an empty layer.
    """
    if not numbers or min(numbers) < 1:
        raise ValueError("band numbers start at 1")
    if no_of_bands is not None:
        check_bands(numbers, no_of_bands)
    kept = cells.filter(F.col("band").isin(numbers))
    if not renumber:
        return kept
    place = F.element_at(F.create_map(*[F.lit(v) for i, n in enumerate(numbers) for v in (n, i + 1)]), F.col("band"))
    return kept.withColumn("band", place)


def check_bands(numbers: list[int], no_of_bands: int) -> list[int]:
    """Band numbers a request may use; raises on numbers outside 1..no_of_bands."""
    bad = [n for n in numbers if not 1 <= n <= no_of_bands]
    if bad:
        raise ValueError(f"bands {bad} are outside 1..{no_of_bands}")
    return numbers


def convert_cell_type(cells: DataFrame, cell_type: str) -> DataFrame:
    return cells.withColumn("value", to_cell_type("value", cell_type))


def cells_to_tiles(cells: DataFrame, size: int, bands: int, zoom: int | None = 0) -> DataFrame:
    """Cut cells into size x size tiles of dense row-major arrays, null where no cell is.

    Cells are shuffled once, by tile, and each tile is filled in one numpy step; a group is at
    most size * size * bands values. With zoom None the cells have a column `zoom`. A cell has one value per time and band:
    two values, or a band outside 1..bands, are an error, since either would lose a value.
    """
    n = size * size
    place = F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))
    outside = F.raise_error(F.concat(F.lit("band "), F.col("band").cast("string"), F.lit(f" is outside 1..{bands}")))
    slot = F.when(F.col("band").between(1, bands), ((F.col("band") - 1) * n + place).cast("int")).otherwise(outside)
    tagged = cells.filter(F.col("value").isNotNull()).select(
        "layer",
        F.col("zoom") if zoom is None else F.lit(zoom).alias("zoom"),
        intdiv("col", size).cast("int").alias("tile_x"),
        intdiv("row", size).cast("int").alias("tile_y"),
        "time_index",
        slot.alias("slot"),
        F.col("value").cast("double").alias("value"),
    )

    def fill(table):
        import numpy as np
        import pyarrow as pa

        values, empty = np.zeros(bands * n), np.ones(bands * n, dtype=bool)
        slots = table.column("slot").to_numpy()
        values[slots], empty[slots] = table.column("value").to_numpy(), False
        key = table.slice(0, 1).select(["layer", "zoom", "tile_x", "tile_y", "time_index"])
        if len(slots) > bands * n - empty.sum():
            raise ValueError(f"a cell of tile {key.to_pylist()[0]} has two values for one band: mosaic first")
        arrays = pa.ListArray.from_arrays(np.arange(bands + 1, dtype="int32") * n, pa.array(values, mask=empty))
        shape = pa.array([size], pa.int32())
        whole = pa.ListArray.from_arrays(np.array([0, bands], dtype="int32"), arrays)
        return key.append_column("cols", shape).append_column("rows", shape).append_column("bands", whole)

    return tagged.groupBy("layer", "zoom", "tile_x", "tile_y", "time_index").applyInArrow(fill, TILES)


def tiles_to_cells(tiles: DataFrame, keep_null: bool = False, with_zoom: bool = False) -> DataFrame:
    """One row per cell; col and row are global (tile key times tile size plus offset)."""
    zoom = ["zoom"] if with_zoom else []
    banded = tiles.select(
        "layer", *zoom, "time_index", "tile_x", "tile_y", "cols", "rows", F.posexplode("bands").alias("b", "data")
    )
    cells = banded.select("*", F.posexplode("data").alias("p", "value"))
    out = cells.select(
        "layer",
        *zoom,
        "time_index",
        (F.col("tile_x") * F.col("cols") + F.pmod("p", "cols")).cast("int").alias("col"),
        (F.col("tile_y") * F.col("rows") + intdiv("p", "cols")).cast("int").alias("row"),
        (F.col("b") + 1).cast("int").alias("band"),
        "value",
    )
    return out if keep_null else out.filter(F.col("value").isNotNull())


def retile(tiles: DataFrame, size: int, bands: int, zoom: int | None = None) -> DataFrame:
    """Re-cut the tiles of every zoom, or of one, to another tile size; edge tiles are padded with nulls."""
    kept = tiles if zoom is None else tiles.filter(F.col("zoom") == zoom)
    return cells_to_tiles(tiles_to_cells(kept, with_zoom=True), size, bands, None)


def stitch(tiles: DataFrame) -> DataFrame:
    """Tiles as one raster: cells under global coordinates."""
    return tiles_to_cells(tiles)


def transpose(cells: DataFrame) -> DataFrame:
    swap = {"col": "row", "row": "col"}
    return cells.select(*[F.col(swap.get(c, c)).alias(c) for c in cells.columns])


def strips(cells: DataFrame, along: str = "row", segment: int = 4096) -> DataFrame:
    """One strip per raster row (or column), time and band, cut into segments of bounded length.

    A strip is a sorted array of (position, value) pairs.
    """
    if along not in ("row", "col"):
        raise ValueError("along is row or col")
    across = "col" if along == "row" else "row"
    return (
        cells.withColumn("segment", intdiv(across, segment).cast("int"))
        .groupBy("layer", "time_index", "band", along, "segment")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(across).alias("pos"), "value"))).alias("strip"))
    )


def row_lists(cells: DataFrame, bands: list[int], segment: int = 4096) -> DataFrame:
    """Per raster row: the list of per-cell band vectors, in column order."""
    wide = cells_to_wide(cells, bands)
    vector = F.array(*[F.col(f"b{b}") for b in bands])
    return (
        wide.withColumn("segment", intdiv("col", segment).cast("int"))
        .groupBy("layer", "time_index", "row", "segment")
        .agg(F.sort_array(F.collect_list(F.struct("col", vector.alias("vector")))).alias("cells"))
    )


def crop_window(cells: DataFrame, grid: Grid, xmin, ymin, xmax, ymax) -> DataFrame:
    """Cells whose centre lies in the window (closed).

    The window is also given as plain col/row ranges, which a Parquet scan can prune on.
    """
    coarse = F.lit(True)
    if all(isinstance(v, (int, float)) for v in (xmin, ymin, xmax, ymax)):
        c0, c1 = int((xmin - grid.x0) // grid.dx), int((xmax - grid.x0) // grid.dx)
        r0, r1 = int((grid.y0 - ymax) // grid.dy), int((grid.y0 - ymin) // grid.dy)
        coarse = F.col("col").between(c0, c1) & F.col("row").between(r0, r1)
    exact = grid.x().between(F.lit(xmin), F.lit(xmax)) & grid.y().between(F.lit(ymin), F.lit(ymax))
    return cells.filter(coarse & exact)


def layer_metadata(tiles: DataFrame, grid: Grid | None = None) -> DataFrame:
    """Key bounds, time bounds and, with a grid, the extent of every layer and zoom."""
    meta = tiles.groupBy("layer", "zoom").agg(
        F.min("tile_x").alias("min_x"),
        F.min("tile_y").alias("min_y"),
        F.max("tile_x").alias("max_x"),
        F.max("tile_y").alias("max_y"),
        F.min("time_index").alias("min_t"),
        F.max("time_index").alias("max_t"),
        F.max("cols").alias("tile_cols"),
        F.max("rows").alias("tile_rows"),
        F.count(F.lit(1)).alias("tiles"),
    )
    return meta if grid is None else with_extent(meta, grid)


def with_extent(meta: DataFrame, grid: Grid) -> DataFrame:
    w, h = F.col("tile_cols") * F.lit(grid.dx), F.col("tile_rows") * F.lit(grid.dy)
    return meta.select(
        "*",
        F.lit(grid.dx).alias("cell_w"),
        F.lit(grid.dy).alias("cell_h"),
        (F.lit(grid.x0) + w * F.col("min_x")).alias("xmin"),
        (F.lit(grid.y0) - h * (F.col("max_y") + 1)).alias("ymin"),
        (F.lit(grid.x0) + w * (F.col("max_x") + 1)).alias("xmax"),
        (F.lit(grid.y0) - h * F.col("min_y")).alias("ymax"),
    )


def merge_metadata(meta: DataFrame, by: list[str]) -> DataFrame:
    """Union of bounds over several layers' metadata rows."""
    low = [c for c in ("min_x", "min_y", "min_t", "xmin", "ymin") if c in meta.columns]
    high = [c for c in ("max_x", "max_y", "max_t", "xmax", "ymax") if c in meta.columns]
    return meta.groupBy(*by).agg(
        *[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high], F.sum("tiles").alias("tiles")
    )


def union_layers(*layers: DataFrame) -> DataFrame:
    out = layers[0]
    for other in layers[1:]:
        out = out.unionByName(other)
    return out
