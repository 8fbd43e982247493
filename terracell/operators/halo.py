"""Kernels on blocks of cells, with what crosses a block's border exchanged.

A block is a tile of a stored layer, or a square of cells brought together once. Inside a task the kernel runs on the block's
arrays. Results that need nothing of a neighbour are final there. The others, a strip along the borders as wide as the kernel
reaches, go out as partial sums and meet those of the neighbouring blocks: what is shuffled beside the cells
themselves grows with the borders, not with the area.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._col import intdiv
from ..functions.kernels import SUPPORT

#: side of the blocks that cells are brought together in
BLOCK = 128
#: weights that cancel to less than this share of their size are taken for zero: what is left is rounding
ROUNDING = 1e-9

KEY = ["layer", "time_index", "band"]
PARTS = "layer string, time_index long, band int, i int, j int, s double, w double, size double, own boolean"

#: (values, present, first column, first row) to (i, j, s, w, size, own, final), each as flat arrays, and after them what else is to be summed
Kernel = Callable[[np.ndarray, np.ndarray, int, int], tuple[np.ndarray, ...]]


def blocks_of_cells(cells: DataFrame, size: int = BLOCK) -> DataFrame:
    """layer, time_index, band, x0, y0, cols, rows and the block's cells as (at, value), one shuffle of narrow rows."""
    at = (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int")
    keyed = cells.filter(F.col("value").isNotNull()).select(
        F.col("layer").cast("string").alias("layer"),
        F.col("time_index").cast("long").alias("time_index"),
        F.col("band").cast("int").alias("band"),
        (intdiv("col", size) * size).cast("long").alias("x0"),
        (intdiv("row", size) * size).cast("long").alias("y0"),
        F.struct(at.alias("at"), F.col("value").cast("double").alias("value")).alias("cell"),
    )
    grouped = keyed.groupBy(*KEY, "x0", "y0").agg(F.collect_list("cell").alias("cells"))
    return grouped.select(*KEY, "x0", "y0", F.lit(size).alias("cols"), F.lit(size).alias("rows"), "cells")


def blocks_of_tiles(tiles: DataFrame) -> DataFrame:
    """The same from stored tiles, whose arrays already lie in one row: no shuffle."""
    banded = tiles.select("layer", "time_index", "tile_x", "tile_y", "cols", "rows", F.posexplode("bands").alias("b", "data"))
    return banded.select(
        F.col("layer").cast("string").alias("layer"),
        F.col("time_index").cast("long").alias("time_index"),
        (F.col("b") + 1).cast("int").alias("band"),
        (F.col("tile_x").cast("long") * F.col("cols")).alias("x0"),
        (F.col("tile_y").cast("long") * F.col("rows")).alias("y0"),
        "cols",
        "rows",
        "data",
    )


def block_arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where there is none) and presence of block k, both rows x cols."""
    cols, rows = batch.column("cols")[k].as_py(), batch.column("rows")[k].as_py()
    if "data" in batch.schema.names:
        data = batch.column("data")[k].values
        present = np.asarray(data.is_valid()).reshape(rows, cols)
        return data.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(rows, cols), present
    cells = batch.column("cells")[k].values
    at, values = cells.field("at").to_numpy(), cells.field("value").to_numpy()
    whole, present = np.zeros(rows * cols), np.zeros(rows * cols, bool)
    whole[at], present[at] = values, True
    if present.sum() < len(at):
        raise ValueError(f"two values for one cell, time and band of layer {batch.column('layer')[k].as_py()}: mosaic first")
    return whole.reshape(rows, cols), present.reshape(rows, cols)


def _parts(blocks: DataFrame, kernel: Kernel, final: bool, more: tuple[str, ...] = ()) -> DataFrame:
    """The final results of each block, or the partial sums along its borders."""
    schema = ", ".join([PARTS, *(f"{c} double" for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for k in range(len(batch)):
                values, present = block_arrays(batch, k)
                i, j, s, w, size, own, whole, *sums = kernel(values, present, batch.column("x0")[k].as_py(), batch.column("y0")[k].as_py())
                chosen = (size > 0) & (whole == final)
                n = int(chosen.sum())
                if not n:
                    continue
                keys = [pa.array([batch.column(c)[k].as_py()] * n, batch.schema.field(c).type) for c in KEY]
                columns = [pa.array(i[chosen].astype(np.int32)), pa.array(j[chosen].astype(np.int32)), *(pa.array(v[chosen]) for v in (s, w, size, own, *sums))]
                yield pa.RecordBatch.from_arrays([*keys, *columns], names=names)

    return blocks.mapInArrow(run, schema)


def exchanged(blocks: DataFrame, kernel: Kernel, more: tuple[str, ...] = ()) -> DataFrame:
    """layer, time_index, band, i, j, s, w, size, own of every target cell that a weight other than 0 reaches, and the kernel's further sums `more`."""
    whole = _parts(blocks, kernel, True, more)
    borders = _parts(blocks, kernel, False, more).groupBy(*KEY, "i", "j").agg(
        *(F.sum(c).alias(c) for c in ("s", "w", "size")), F.max("own").alias("own"), *(F.sum(c).alias(c) for c in more)
    )
    return whole.unionByName(borders)


def weighted(s: Column, w: Column, size: Column) -> Column:
    """The weighted mean over the neighbours that are there; null where their weights cancel."""
    return F.when(F.abs(w) > size * ROUNDING, s / w)


def kernel_weights(distance: np.ndarray, method: str) -> np.ndarray:
    """kernels.kernel_weight for numpy."""
    d = np.abs(distance)
    if method == "bilinear":
        return np.maximum(1.0 - d, 0.0)
    near, far = (1.5 * d - 2.5) * d * d + 1.0, ((-0.5 * d + 2.5) * d - 4.0) * d + 2.0
    return np.where(d <= 1, near, np.where(d < 2, far, 0.0))


def _axis(u: np.ndarray, order: np.ndarray, first: int, size: int, method: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets that a block's cells first..first + size - 1 reach, their weights per cell, and whether all of their neighbours are among these.

    `order` sorts the places u, so that a block looks its targets up and does not go through the whole axis.
    """
    reach = int(SUPPORT[method])
    start = np.searchsorted(u, first - reach, "right", sorter=order)
    end = np.searchsorted(u, first + size - 1 + reach, "left", sorter=order)
    near = np.sort(order[start:end])
    base = np.floor(u[near]).astype(np.int64)
    inside = (base - reach + 1 >= first) & (base + reach <= first + size - 1)
    return near, kernel_weights(u[near][:, None] - np.arange(first, first + size)[None, :], method), inside


def resampling(u: np.ndarray, v: np.ndarray, method: str, sizes: bool = False) -> Kernel:
    """Separable interpolation: u and v are the target columns' and rows' places among the source's cells.

    With sizes, the sum of the values by the size of their weights is the one further sum.
    """
    order_u, order_v = np.argsort(u, kind="stable"), np.argsort(v, kind="stable")

    def kernel(values: np.ndarray, present: np.ndarray, x0: int, y0: int) -> tuple[np.ndarray, ...]:
        rows, cols = values.shape
        i, wx, in_x = _axis(u, order_u, x0, cols, method)
        j, wy, in_y = _axis(v, order_v, y0, rows, method)
        there = present.astype(float)
        s, w, size = wy @ values @ wx.T, wy @ there @ wx.T, np.abs(wy) @ there @ np.abs(wx).T
        whole = in_y[:, None] & in_x[None, :]
        jj, ii = np.meshgrid(j, i, indexing="ij")
        more = [np.abs(wy) @ values @ np.abs(wx).T] if sizes else []
        return tuple(a.ravel() for a in (ii, jj, s, w, size, np.zeros(s.shape, bool), whole, *more))

    return kernel


def window(kernel: list[tuple[int, int, float]]) -> Kernel:
    """Moving-window sums: the target is the cell itself, offset (dx, dy) its neighbour with that weight."""
    offsets = [(dx, dy, float(w)) for dx, dy, w in kernel if w]
    margin = max([0, *(max(abs(dx), abs(dy)) for dx, dy, _ in offsets)])

    def run(values: np.ndarray, present: np.ndarray, x0: int, y0: int) -> tuple[np.ndarray, ...]:
        rows, cols = values.shape
        shape = rows + 2 * margin, cols + 2 * margin
        s, w, size, own = (np.zeros(shape) for _ in range(4))
        there = present.astype(float)
        for dx, dy, weight in offsets:
            part = slice(margin - dy, margin - dy + rows), slice(margin - dx, margin - dx + cols)
            s[part] += weight * values
            w[part] += weight * there
            size[part] += abs(weight) * there
        core = slice(margin, margin + rows), slice(margin, margin + cols)
        own[core] = there
        size += own  # a cell that only its own place reaches is a result, too
        whole = np.zeros(shape, bool)
        whole[2 * margin : rows, 2 * margin : cols] = True
        jj, ii = np.meshgrid(np.arange(y0 - margin, y0 + rows + margin), np.arange(x0 - margin, x0 + cols + margin), indexing="ij")
        return tuple(a.ravel() for a in (ii, jj, s, w, size, own > 0, whole))

    return run
