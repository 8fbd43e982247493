"""Raster scans. A raster file becomes rows of tiles; the file codec is the caller's.

A decoder takes (path, bytes) and yields dicts with tile_x, tile_y, cols, rows and bands
(list of flat row-major lists). Files are spread over tasks by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeindex import (
    scene_time_from_filename,
    scene_time_from_mtl,
    ts_to_time_index,
    year_from_path,
    year_start,
)
from ..operators.layout import strips, tiles_to_cells
from ..operators.series import band_to_timestep

Decoder = Callable[[str, bytes], Iterable[dict]]

DECODED = "path string, tile_x int, tile_y int, cols int, rows int, bands array<array<double>>"


def decode_files(spark: SparkSession, path: str, decoder: Decoder, glob: str | None = None) -> DataFrame:
    """Raw files under a path through a decoder: (path, tile_x, tile_y, cols, rows, bands).

    A file is one row, so it must stay under 2 GB; Arrow batches are bounded in bytes by the session.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = [
                    {"path": path, **{k: t[k] for k in ("tile_x", "tile_y", "cols", "rows", "bands")}}
                    for t in decoder(path, content)
                ]
                if rows:
                    yield pd.DataFrame(rows)

    return reader.load(path).select("path", "content").mapInPandas(run, DECODED)


def as_tiles(decoded: DataFrame, layer: str, time_index: Column | int = 0, zoom: int = 0) -> DataFrame:
    t = time_index if isinstance(time_index, Column) else F.lit(time_index)
    return decoded.select(
        F.lit(layer).alias("layer"),
        F.lit(zoom).alias("zoom"),
        "tile_x",
        "tile_y",
        t.cast("bigint").alias("time_index"),
        "cols",
        "rows",
        "bands",
    )


def scan_multiband(spark: SparkSession, path: str, decoder: Decoder | None = None, layer: str = "scan") -> DataFrame:
    """Multi-band tiles: stored Parquet tiles, or raw files when a decoder is given."""
    if decoder is None:
        return spark.read.parquet(path)
    return as_tiles(decode_files(spark, path, decoder), layer)


def scan_singleband(tiles: DataFrame, band: int = 1) -> DataFrame:
    """Tiles with one band only; the other arrays are dropped before any shuffle."""
    return tiles.withColumn("bands", F.array(F.get("bands", F.lit(band - 1))))


def scan_glob_timestamped(spark: SparkSession, path: str, decoder: Decoder, glob: str = "*", layer: str = "scan") -> DataFrame:
    """Files of a glob, each at the start (UTC) of the year named in its file name."""
    decoded = decode_files(spark, path, decoder, glob)
    return as_tiles(decoded, layer, ts_to_time_index(year_start(year_from_path("path"))))


def with_path_time(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds time_index from the year in a file path; `_metadata.file_path` works too."""
    return df.withColumn("time_index", ts_to_time_index(year_start(year_from_path(path))))


def scan_year_bands(cells: DataFrame, steps: int | None = None) -> DataFrame:
    """Year files whose bands are 10-day steps to one band over time."""
    return band_to_timestep(cells, steps=steps)


def scan_dated_scene(tiles: DataFrame, iso_time: str) -> DataFrame:
    """Tiles of one scene at a time given by the caller."""
    return tiles.withColumn("time_index", ts_to_time_index(F.lit(iso_time).cast("timestamp")))


def scan_row_strips(cells: DataFrame, segment: int = 4096) -> DataFrame:
    return strips(cells, "row", segment)


def scan_col_strips(cells: DataFrame, segment: int = 4096) -> DataFrame:
    return strips(cells, "col", segment)


def scan_pixels(tiles: DataFrame) -> DataFrame:
    return tiles_to_cells(tiles)


def stack_bands(bands: DataFrame, numbers: list[int], scene: str = "layer") -> DataFrame:
    """Single-band rasters of a scene (rows with a band number) to one row per cell with an
    ordered `bands` array; a band that is missing is null."""
    picks = [F.max(F.when(F.col("band") == n, F.col("value"))) for n in numbers]
    return (
        bands.filter(F.col("band").isin(numbers))
        .groupBy(scene, "time_index", "col", "row")
        .agg(F.array(*picks).alias("bands"))
    )


MTL_SCHEMA = (
    "LANDSAT_METADATA_FILE struct<IMAGE_ATTRIBUTES:struct<DATE_ACQUIRED:string,SCENE_CENTER_TIME:string>>"
)


def scene_metadata(texts: DataFrame, json_column: str = "json") -> DataFrame:
    """Adds `scene_time` from Landsat MTL JSON text; malformed text gives null."""
    attributes = F.from_json(json_column, MTL_SCHEMA)["LANDSAT_METADATA_FILE"]["IMAGE_ATTRIBUTES"]
    return texts.withColumn(
        "scene_time", scene_time_from_mtl(attributes["DATE_ACQUIRED"], attributes["SCENE_CENTER_TIME"])
    )


def read_scene_metadata(spark: SparkSession, path: str) -> DataFrame:
    """MTL JSON files to (path, scene_time)."""
    raw = spark.read.option("multiLine", True).schema(MTL_SCHEMA).json(path)
    attributes = F.col("LANDSAT_METADATA_FILE.IMAGE_ATTRIBUTES")
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        scene_time_from_mtl(attributes["DATE_ACQUIRED"], attributes["SCENE_CENTER_TIME"]).alias("scene_time"),
    )


def scenes_from_filenames(names: DataFrame, column: str = "name") -> DataFrame:
    """Adds `scene_time` and time_index from `a_b_c_YYYY_MM.tif` names."""
    at = scene_time_from_filename(column)
    return names.withColumn("scene_time", at).withColumn("time_index", ts_to_time_index("scene_time"))
