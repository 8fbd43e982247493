"""Pyramids on blocks of cells: halved levels as a cascade, slippy levels from the target tiles back to the source.

A block is a stored tile, or a square of cells brought together once (see halo). Every level is worked out on the block's arrays, so
no cell is copied for a level. What a block settles alone is final there; the rest goes out as partial results that
merge with those of the neighbouring blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import MAX_LAT, MAX_ZOOM, MIN_ZOOM
from ..functions.kernels import SUPPORT
from ..schema import TILES
from .halo import KEY, ROUNDING, block_arrays, blocks_of_cells, blocks_of_tiles, kernel_weights, weighted
from .layout import Grid, cells_to_tiles

#: a place behind every cell's
NOWHERE = np.iinfo(np.int64).max

HALVED = "layer string, time_index long, band int, level int, col int, row int, s double, n long, place long, first double"
PARTS = (
    "layer string, time_index long, band int, zoom int, tile_x int, tile_y int, "
    "at array<int>, s array<double>, w array<double>, size array<double>, whole array<boolean>"
)


def _halve(a: np.ndarray, empty: float, x0: int, y0: int) -> np.ndarray:
    """The four children of every cell of the next level, as 4 x rows x cols in row, column order; x0, y0 is a's corner."""
    rows, cols = a.shape
    top, left = y0 & 1, x0 & 1
    padded = np.full(((rows + top + 1) // 2 * 2, (cols + left + 1) // 2 * 2), empty, a.dtype)
    padded[top : top + rows, left : left + cols] = a
    return np.stack([padded[i::2, j::2] for i in (0, 1) for j in (0, 1)])


def _cascade(values: np.ndarray, present: np.ndarray, x0: int, y0: int, levels: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of every level from 1: level, col, row, sum, count, place and value of the first, whether the block holds all of the cell's source."""
    rows, cols = values.shape
    ys, xs = np.arange(y0, y0 + rows, dtype=np.int64), np.arange(x0, x0 + cols, dtype=np.int64)
    place = np.where(present, (ys[:, None] << 32) + xs[None, :], NOWHERE)
    s, n, first = np.where(present, values, 0.0), present.astype(np.int64), values
    x, y = x0, y0
    for level in range(1, levels + 1):
        places = _halve(place, NOWHERE, x, y)
        pick = places.argmin(axis=0)[None]
        s, n = _halve(s, 0.0, x, y).sum(axis=0), _halve(n, 0, x, y).sum(axis=0)
        first = np.take_along_axis(_halve(first, 0.0, x, y), pick, 0)[0]
        place = np.take_along_axis(places, pick, 0)[0]
        x, y = x >> 1, y >> 1
        r, c = np.nonzero(n)
        col, row = x + c, y + r
        inside = (col << level >= x0) & ((col + 1) << level <= x0 + cols) & (row << level >= y0) & ((row + 1) << level <= y0 + rows)
        yield np.full(len(r), level), col, row, s[r, c], n[r, c], place[r, c], first[r, c], inside


def _halved(blocks: DataFrame, levels: int, final: bool) -> DataFrame:
    """Cells of levels 1..levels that a block settles alone, or what it knows of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in HALVED.split(", ")]
        types = [pa.int32()] * 3 + [pa.float64(), pa.int64(), pa.int64(), pa.float64()]
        for batch in batches:
            for k in range(len(batch)):
                values, present = block_arrays(batch, k)
                found = _cascade(values, present, batch.column("x0")[k].as_py(), batch.column("y0")[k].as_py(), levels)
                *columns, inside = (np.concatenate(c) for c in zip(*found))
                chosen = inside == final
                n = int(chosen.sum())
                if n:
                    keys = [pa.array([batch.column(c)[k].as_py()] * n, batch.schema.field(c).type) for c in KEY]
                    arrays = [pa.array(c[chosen], t) for c, t in zip(columns, types)]
                    yield pa.RecordBatch.from_arrays([*keys, *arrays], names=names)

    return blocks.mapInArrow(run, HALVED)


def _pyramid(blocks: DataFrame, levels: int, how: str) -> DataFrame:
    if how not in ("nearest", "avg"):
        raise ValueError("how is nearest or avg")
    if levels < 1:
        raise ValueError("a pyramid has at least one level")
    keys = ["layer", "level", "time_index", "col", "row", "band"]
    whole, parts = _halved(blocks, levels, True), _halved(blocks, levels, False)
    if how == "avg":
        return whole.select(*keys, (F.col("s") / F.col("n")).alias("value")).unionByName(
            parts.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("value"))
        )
    return whole.select(*keys, F.col("first").alias("value")).unionByName(
        parts.groupBy(*keys).agg(F.min_by("first", "place").alias("value"))
    )


def pyramid(cells: DataFrame, levels: int, how: str = "nearest") -> DataFrame:
    """Levels 1..n of halved resolution in one job; adds `level`.

    nearest keeps the first non-null cell of each block in row, column order; avg averages. Each level comes from the one
    before within a block's arrays: a partial cell carries its sum and count, and its first value with that value's place, so four
    of them merge to one. Cells are shuffled once, narrow; after that only cells that several blocks have a part of. Two
    values for a cell are an error.
    """
    return _pyramid(blocks_of_cells(cells), levels, how)


def pyramid_tiles(tiles: DataFrame, levels: int, how: str = "nearest") -> DataFrame:
    """pyramid for stored tiles of any size: their arrays stay where they are, only cells that reach over a tile's edge are shuffled."""
    return _pyramid(blocks_of_tiles(tiles), levels, how)


def pyramid_layers(tiles: DataFrame, zoom: int, levels: int, size: int, bands: int, how: str = "nearest") -> DataFrame:
    """Stored tiles of one zoom to the tiles of the `levels` zooms below it, ready to be written."""
    at = tiles.filter(F.col("zoom") == zoom)
    cells = pyramid_tiles(at, levels, how).withColumn("zoom", (F.lit(zoom) - F.col("level")).cast("int"))
    return cells_to_tiles(cells, size, bands, zoom=None)


def _tile_x(lon: float, z: int) -> int:
    return min(max(math.floor((lon + 180.0) / 360.0 * 2**z), 0), 2**z - 1)


def _tile_y(lat: float, z: int) -> int:
    lat = min(max(lat, -MAX_LAT), MAX_LAT)
    return min(max(math.floor((1.0 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2.0 * 2**z), 0), 2**z - 1)


def _centres(low: float, high: float, size: int) -> np.ndarray:
    return low + (np.arange(size) + 0.5) * ((high - low) / size)


def _columns(tile_x: int, z: int, size: int, src: Grid) -> np.ndarray:
    """Places of a tile's columns among the source's."""
    lon = _centres(tile_x / 2**z * 360.0 - 180.0, (tile_x + 1) / 2**z * 360.0 - 180.0, size)
    return (lon - src.x0) / src.dx - 0.5


def _rows(tile_y: int, z: int, size: int, src: Grid) -> np.ndarray:
    """Places of a tile's rows, evenly spaced in latitude, among the source's."""
    north, south = (math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 2**z)))) for y in (tile_y, tile_y + 1))
    return (src.y0 - _centres(north, south, size)) / src.dy - 0.5


#: targets of a tile that a block reaches, the first source cell they need, their weights from there on, whether the block has all of them
Reach = tuple[np.ndarray, int, np.ndarray, np.ndarray]


def _reached(u: np.ndarray, first: int, n: int, method: str) -> Reach | None:
    """What a block's cells first..first + n - 1 give to targets at the ascending places u."""
    if method == "nearest":
        cell = np.floor(u + 0.5).astype(np.int64) - first
        near = np.flatnonzero((cell >= 0) & (cell < n))
        low, base = (cell[near].min() if len(near) else 0), cell[near]
        weights = (base[:, None] == np.arange(low, base.max() + 1 if len(near) else 0)[None, :]).astype(float)
        return (near, int(low), weights, np.ones(len(near), bool)) if len(near) else None
    reach = int(SUPPORT[method])
    near = np.flatnonzero((u > first - reach) & (u < first + n - 1 + reach))
    if not len(near):
        return None
    base = np.floor(u[near]).astype(np.int64) - first
    low, high = max(int(base.min()) - reach + 1, 0), min(int(base.max()) + reach, n - 1)
    weights = kernel_weights(u[near][:, None] - np.arange(first + low, first + high + 1)[None, :], method)
    return near, low, weights, (base - reach + 1 >= 0) & (base + reach <= n - 1)


def _slippy_parts(blocks: DataFrame, src: Grid, levels: list[int], size: int, method: str) -> DataFrame:
    """Of every tile that a block reaches: places of its cells, weighted sum, weight, weight size, and whether no other block adds to it."""
    if method != "nearest" and method not in SUPPORT:
        raise ValueError(f"unknown resampling method {method}")
    wide = 0.5 if method == "nearest" else SUPPORT[method]

    def reached(first: int, n: int, z: int, along_x: bool) -> list[tuple[int, Reach]]:
        if along_x:
            low, high = (_tile_x(src.x0 + (c + 0.5) * src.dx, z) for c in (first - wide, first + n - 1 + wide))
        else:
            low, high = (_tile_y(src.y0 - (r + 0.5) * src.dy, z) for r in (first - wide, first + n - 1 + wide))
        at = _columns if along_x else _rows
        found = [(tile, _reached(at(tile, z, size, src), first, n, method)) for tile in range(low, high + 1)]
        return [(tile, part) for tile, part in found if part is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PARTS.split(", ")]
        for batch in batches:
            for k in range(len(batch)):
                values, present = block_arrays(batch, k)
                there = present.astype(float)
                keys = [pa.array([batch.column(c)[k].as_py()], batch.schema.field(c).type) for c in KEY]
                for z in levels:
                    columns = reached(batch.column("x0")[k].as_py(), values.shape[1], z, True)
                    rows = reached(batch.column("y0")[k].as_py(), values.shape[0], z, False)
                    for tile_x, (i, left, wx, in_x) in columns:
                        for tile_y, (j, top, wy, in_y) in rows:
                            part = slice(top, top + wy.shape[1]), slice(left, left + wx.shape[1])
                            s, w = wy @ values[part] @ wx.T, wy @ there[part] @ wx.T
                            weight = np.abs(wy) @ there[part] @ np.abs(wx).T
                            chosen = weight > 0
                            n = int(chosen.sum())
                            if not n:
                                continue
                            at = (j[:, None] * size + i[None, :])[chosen]
                            whole = (in_y[:, None] & in_x[None, :])[chosen]
                            place = [pa.array([v], pa.int32()) for v in (z, tile_x, tile_y)]
                            flat = [pa.array(at, pa.int32()), *(pa.array(v[chosen]) for v in (s, w, weight)), pa.array(whole)]
                            ends = pa.array([0, n], pa.int32())
                            yield pa.RecordBatch.from_arrays([*keys, *place, *(pa.ListArray.from_arrays(ends, v) for v in flat)], names=names)

    return blocks.mapInArrow(run, PARTS)


def ingest_pyramid(cells: DataFrame, src: Grid, levels: list[int] | None = None, size: int = 256, method: str = "cubic") -> DataFrame:
    """Slippy tiles of every level, each resampled from the source scene.

    Every block of cells looks up the tiles it reaches, level by level, and interpolates their cells from its own
    arrays; a cell is not copied for a level. Cells of a tile that need several blocks are summed up, and only those are shuffled.
    Missing neighbours drop out and the weights are renormalised; two values for a cell are an error. Within a tile, rows are evenly spaced
    in latitude. Output: layer, zoom, tile_x, tile_y, time_index, band, col, row (inside the tile), value.
    """
    parts = _slippy_parts(blocks_of_cells(cells), src, levels or list(range(MIN_ZOOM, MAX_ZOOM + 1)), size, method)
    tile = ["layer", "zoom", "tile_x", "tile_y", "time_index", "band"]
    each = parts.select(*tile, F.explode(F.arrays_zip("at", "s", "w", "size", "whole")).alias("p")).select(*tile, "p.*")
    borders = each.filter(~F.col("whole")).groupBy(*tile, "at").agg(*(F.sum(c).alias(c) for c in ("s", "w", "size")))
    found = each.filter("whole").drop("whole").unionByName(borders)
    out = found.select(
        *tile,
        (F.col("at") % size).cast("int").alias("col"),
        F.floor(F.col("at") / size).cast("int").alias("row"),
        weighted(F.col("s"), F.col("w"), F.col("size")).alias("value"),
    )
    return out.filter(F.col("value").isNotNull())


def ingest_tiles(
    cells: DataFrame, src: Grid, bands: int, levels: list[int] | None = None, size: int = 256, method: str = "cubic"
) -> DataFrame:
    """ingest_pyramid as tiles that are ready to be written: one row per tile and time with an array per band.

    What blocks know of a tile meets as arrays, one row per block and band, and is added up in one numpy step. A tile's group is a few
    times size * size * bands numbers, since only cells along the blocks' borders come more than once. A band outside 1..bands is an error.
    """
    n = size * size
    parts = _slippy_parts(blocks_of_cells(cells), src, levels or list(range(MIN_ZOOM, MAX_ZOOM + 1)), size, method)

    def merge(table: pa.Table) -> pa.Table:
        sums = np.zeros((3, bands, n))
        for k in range(table.num_rows):
            band = table.column("band")[k].as_py()
            if not 1 <= band <= bands:
                raise ValueError(f"band {band} is outside 1..{bands}")
            at = table.column("at")[k].values.to_numpy()
            for total, name in zip(sums, ("s", "w", "size")):
                total[band - 1, at] += table.column(name)[k].values.to_numpy()
        s, w, weight = sums.reshape(3, -1)
        empty = ~(np.abs(w) > weight * ROUNDING)
        key = table.slice(0, 1).select(["layer", "zoom", "tile_x", "tile_y", "time_index"])
        if empty.all():
            return pa.Table.from_arrays([*(c.slice(0, 0) for c in key.columns), *(pa.array([], t) for t in (pa.int32(), pa.int32(), pa.list_(pa.list_(pa.float64()))))], names=[*key.column_names, "cols", "rows", "bands"])
        values = pa.array(np.divide(s, w, out=np.zeros_like(s), where=~empty), mask=empty)
        arrays = pa.ListArray.from_arrays(np.arange(bands + 1, dtype="int32") * n, values)
        shape = pa.array([size], pa.int32())
        whole = pa.ListArray.from_arrays(np.array([0, bands], dtype="int32"), arrays)
        return key.append_column("cols", shape).append_column("rows", shape).append_column("bands", whole)

    return parts.drop("whole").groupBy("layer", "zoom", "tile_x", "tile_y", "time_index").applyInArrow(merge, TILES)
