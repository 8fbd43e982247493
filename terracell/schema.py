"""Column layouts shared by all operators."""

from __future__ import annotations

CELL_KEY = ["layer", "time_index", "col", "row", "band"]
PIXEL_KEY = ["layer", "time_index", "col", "row"]
TILE_KEY = ["layer", "zoom", "tile_x", "tile_y", "time_index"]

CELLS = "layer string, time_index bigint, col int, row int, band int, value double"
TILES = (
    "layer string, zoom int, tile_x int, tile_y int, time_index bigint, "
    "cols int, rows int, bands array<array<double>>"
)
SCENES = (
    "ingest_id bigint, dataset_id bigint, time_index bigint, "
    "xmin double, ymin double, xmax double, ymax double"
)
TILE_REFS = (
    "ingest_id bigint, dataset_id bigint, zoom_level int, time_index bigint, "
    "spatial_index_x int, spatial_index_y int, z_index decimal(38,0), file_path string"
)
RING = "array<struct<x:double,y:double>>"
BAND_META = "array<struct<name:string,description:string,min:double,max:double>>"
