"""Time series, mosaics, composites and moments on stored tiles, against the same SQL as their cell versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.operators import layout
from terracell.operators import tilestack as stack

from . import algebra as cell_algebra
from .fixture import STEP, TILE
from .registry import ORACLES, check, micro


def _same_sql(name: str) -> str:
    return ORACLES[name]


@check("tile_savgol", _same_sql("savgol"))
def tile_savgol(fx):
    out = layout.tiles_to_cells(stack.tile_savgol(fx.tiles))
    return out.select("time_index", "col", "row", "band", micro("value", "value"))


@check("tile_latest", _same_sql("latest_per_cell"))
def tile_latest(fx):
    newest = stack.tile_latest(fx.tiles, 864000, 4320000)
    values = layout.tiles_to_cells(newest).drop("time_index")
    times = layout.tiles_to_cells(newest.withColumn("bands", F.col("times")).drop("times"))
    place = ["layer", "col", "row", "band"]
    return values.join(times.select(*place, F.col("value").cast("bigint").alias("time_index")), place)


@check("tile_mosaic", _same_sql("mosaic"))
def tile_mosaic(fx):
    first = layout.cells_to_tiles(layout.select_bands(cell_algebra._shifted(fx), [1]), TILE, 1).withColumn("rank", F.lit(0))
    second = layout.cells_to_tiles(layout.select_bands(fx.cells, [1]), TILE, 1).withColumn("rank", F.lit(1))
    return layout.tiles_to_cells(stack.tile_mosaic(first.unionByName(second), "rank"))


@check("tile_rgb_composite", _same_sql("rgb_composite"))
def tile_rgb_composite(fx):
    out = stack.tile_rgb_composite(fx.tiles, [1, 4, 5], 5, 0.0078125, 0.125)
    # a cell that is stored has a second band, its number of lines
    there = fx.tiles.select("zoom", "tile_x", "tile_y", "time_index", F.get("bands", F.lit(1)).alias("stored"))
    both = out.join(there, ["zoom", "tile_x", "tile_y", "time_index"])
    cells = both.select("time_index", "tile_x", "tile_y", F.posexplode(F.arrays_zip("r", "g", "b", "a", "stored")).alias("p", "c"))
    col, row = F.col("tile_x") * TILE + F.col("p") % TILE, F.col("tile_y") * TILE + F.floor(F.col("p") / TILE)
    return cells.filter("c.stored is not null").select(
        "time_index", col.cast("int").alias("col"), row.cast("int").alias("row"), "c.r", "c.g", "c.b", "c.a"
    )


@check("tile_fpca_gram", _same_sql("fpca_gram"))
def tile_fpca_gram(fx):
    return stack.tile_fpca_gram(fx.tiles, [k * STEP for k in range(7)])
