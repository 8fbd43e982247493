"""A scene to its stored pyramid and its catalog rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import MAX_ZOOM, MIN_ZOOM, TILE_SIZE, tile_path, z_index
from ..operators.layout import Grid
from ..operators.levels import ingest_tiles
from ..plans.storage import cut
from .catalog import write_tile_catalog
from .layers import upsert_layer


def scene_tile_refs(tiles: DataFrame, dataset_id: int, ingest_id: int, sensor: str) -> DataFrame:
    """Catalog rows of stored tiles."""
    return tiles.select(
        F.lit(ingest_id).cast("bigint").alias("ingest_id"),
        F.lit(dataset_id).cast("bigint").alias("dataset_id"),
        F.col("zoom").alias("zoom_level"),
        "time_index",
        F.col("tile_x").alias("spatial_index_x"),
        F.col("tile_y").alias("spatial_index_y"),
        z_index("time_index", "tile_y", "tile_x").alias("z_index"),
        tile_path(F.lit(sensor), "zoom", "tile_x", "tile_y", "time_index").alias("file_path"),
    )


def ingest_scene(
    cells: DataFrame,
    src: Grid,
    bands: int,
    dataset_id: int,
    ingest_id: int,
    sensor: str,
    layer_path: str,
    catalog_path: str,
    levels: list[int] | None = None,
    size: int = TILE_SIZE,
    method: str = "cubic",
) -> None:
    """Resample a scene to the slippy tiles of every level, store them, and add the stored tiles to the catalog.

    The tiles are resampled once and kept. They are written first and replace those of their layer, zoom and key; catalog rows of keys that are
    there already are left out. A call that was cut short can be repeated.
    """
    tiles = cut(ingest_tiles(cells, src, bands, levels or list(range(MIN_ZOOM, MAX_ZOOM + 1)), size, method))
    upsert_layer(tiles, layer_path)
    write_tile_catalog(scene_tile_refs(tiles, dataset_id, ingest_id, sensor), catalog_path)
