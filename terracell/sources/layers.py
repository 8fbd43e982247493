"""Stored layers: Parquet partitioned by layer and zoom, clustered by Z key.

Cells of neighbouring tiles land in the same files, so tile ranges prune row groups and the
partition columns prune whole folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions._col import intdiv
from ..functions.grid import z_index, z_parts
from ..functions.timeindex import DAY
from ..functions.zcurve import BITS, in_z_ranges, z_ranges
from ..operators.layout import tiles_to_cells
from ..operators.series import time_range
from ..plans.joins import rebalance
from ..plans.storage import cut, path_exists
from ..schema import TILE_KEY


#: tiles per side of the blocks kept together in a file, and the time span of a block
BLOCK_TILES, BLOCK_DAYS = 8, 30


def _clustered(tiles: DataFrame, lead: list[str], time) -> DataFrame:
    """Blocks of neighbouring tiles and times to the same task, in Z order within it.

    A rebalance needs no sampling pass over what may be an expensive plan, splits blocks that turn
    out too large and merges small ones into files of an even size.
    """
    high, low = z_parts(time, "tile_y", "tile_x")
    blocks = [
        intdiv("tile_x", BLOCK_TILES),
        intdiv("tile_y", BLOCK_TILES),
        intdiv("time_index", BLOCK_DAYS * DAY),
    ]
    named = tiles.withColumns({"_z_high": high, "_z_low": low, **{f"_b{i}": b for i, b in enumerate(blocks)}})
    spread = rebalance(named, *lead, "_b0", "_b1", "_b2")
    return spread.sortWithinPartitions(*lead, "_z_high", "_z_low").drop("_z_high", "_z_low", "_b0", "_b1", "_b2")


def write_layer(tiles: DataFrame, path: str, mode: str = "append") -> None:
    """Spatial layer: partitioned by layer and zoom, files in Z order of (y, x), which is the stored z_index."""
    keyed = tiles.withColumn("z_index", z_index(F.lit(0).cast("bigint"), "tile_y", "tile_x"))
    _clustered(keyed, ["layer", "zoom"], F.lit(0)).write.mode(mode).partitionBy("layer", "zoom").parquet(path)


def write_layer_temporal(tiles: DataFrame, path: str, step_days: int = 10, mode: str = "append") -> None:
    """Space-time layer: the Z key uses time in whole steps, kept as t_bucket."""
    bucket = intdiv("time_index", step_days * DAY)
    keyed = tiles.withColumn("t_bucket", bucket).withColumn("z_index", z_index("t_bucket", "tile_y", "tile_x"))
    _clustered(keyed, ["layer", "zoom"], F.col("t_bucket")).write.mode(mode).partitionBy("layer", "zoom").parquet(path)


def upsert_layer(tiles: DataFrame, path: str) -> None:
    """Create the layer, or replace the tiles with the keys being written.

    Only the (layer, zoom, time_index) folders that a written tile lies in are rewritten; their other tiles are carried over.
    Of several tiles with one key in a call, the one whose other columns sort last (bands first) stays, so a call repeated stores the same.
    """
    folder = ["layer", "zoom", "time_index"]
    spark = tiles.sparkSession
    others = ["bands", *(c for c in tiles.columns if c not in ("bands", *TILE_KEY))]
    last = F.max(F.struct(*others)).alias("_last")
    keyed = tiles.groupBy(*TILE_KEY).agg(last).select(*TILE_KEY, "_last.*").select(*tiles.columns)
    keyed = keyed.withColumn("z_index", z_index("time_index", "tile_y", "tile_x"))
    if path_exists(spark, path):
        keyed = cut(keyed)
        stored = spark.read.schema(keyed.schema).parquet(path)
        others = stored.join(keyed.select(*folder).distinct(), folder, "left_semi").join(keyed.select(*TILE_KEY), TILE_KEY, "left_anti")
        # computed before the folders it comes from are replaced
        keyed = cut(keyed.unionByName(others))
    (
        _clustered(keyed, folder, F.lit(0))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folder)
        .parquet(path)
    )


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def layer_query(
    tiles: DataFrame,
    layer: str,
    zoom: int,
    keys: tuple[int, int, int, int] | None = None,
    start=None,
    end=None,
    z_time: str | None = "stored",
    step_days: int = 10,
    max_ranges: int = 32,
) -> DataFrame:
    """Part of a stored layer: tile keys (min_x, min_y, max_x, max_y) and a closed time range (time indexes).

    Where the layer has its z_index, the box becomes ranges of that key, which files are sorted by: a row group holds a
    piece of the curve, so comparisons of z_index skip those that the box's ranges leave out, also where x and y alone span wide. The
    plain comparisons of tile keys and time stay and decide what is returned.

    z_time says which time is in the key: `t_bucket` (layers of write_layer_temporal, steps of step_days), `time_index` (upsert_layer), or
    None (write_layer). `stored` takes t_bucket where the layer has that column and else leaves time out of the ranges, which holds
    for the other two: any time is then in range. Places with a key outside the curve's bits (negative ones) have no z_index and are kept for the
    plain comparisons wherever the box reaches there.
    """
    found = tiles.filter((F.col("layer") == layer) & (F.col("zoom") == zoom))
    if keys is not None:
        min_x, min_y, max_x, max_y = keys
        found = found.filter(F.col("tile_x").between(min_x, max_x) & F.col("tile_y").between(min_y, max_y))
    found = time_range(found, start, end)
    if "z_index" in tiles.columns and keys is not None:
        found = found.filter(_on_curve(tiles.columns, keys, start, end, z_time, step_days, max_ranges))
    return found


def _on_curve(columns: list[str], keys: tuple[int, int, int, int], start, end, z_time: str | None, step_days: int, max_ranges: int):
    """Ranges of the stored key for a box and, where both ends are numbers, a time range."""
    if z_time == "stored":
        z_time = "t_bucket" if "t_bucket" in columns else "any"
    last = (1 << BITS[0]) - 1
    times = (0, 0) if z_time is None else (0, last)
    outside = z_time == "any" and not (isinstance(start, int) and start >= 0)
    if z_time in ("t_bucket", "time_index"):
        plain = [v if isinstance(v, int) else None for v in (start, end)]
        unit = step_days * DAY if z_time == "t_bucket" else 1
        low, high = (None if v is None else v // unit for v in plain)
        outside = low is None or low < 0 or high is None or high > last
        times = max(0, 0 if low is None else low), min(last, last if high is None else high)
    min_x, min_y, max_x, max_y = keys
    outside = outside or min(min_x, min_y) < 0 or max(max_x, max_y) >= 1 << BITS[1]
    near = in_z_ranges("z_index", z_ranges(times, (min_y, max_y), (min_x, max_x), max_ranges))
    return near | F.col("z_index").isNull() if outside else near


def layer_intersects(tiles: DataFrame, grid, tile_cols: int, tile_rows: int, extent: tuple[float, float, float, float]) -> DataFrame:
    """Tiles whose key extent meets an extent, half-open, as a key range a scan can prune on."""
    import math

    xmin, ymin, xmax, ymax = extent
    w, h = grid.dx * tile_cols, grid.dy * tile_rows
    x0, x1 = math.floor((xmin - grid.x0) / w), math.ceil((xmax - grid.x0) / w) - 1
    y0, y1 = math.floor((grid.y0 - ymax) / h), math.ceil((grid.y0 - ymin) / h) - 1
    return tiles.filter(F.col("tile_x").between(x0, max(x0, x1)) & F.col("tile_y").between(y0, max(y0, y1)))


def layer_catalog(tiles: DataFrame) -> DataFrame:
    """Layers with their largest zoom and tile count; only partition columns are read."""
    return tiles.groupBy("layer").agg(F.max("zoom").alias("max_zoom"), F.count(F.lit(1)).alias("tiles"))


def stitch_export(tiles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One raster as cells under global coordinates, globally sorted by time, band, row, column.

    Written by range-sorted tasks, never through the driver.
    """
    order = ["time_index", "band", "row", "col"]
    tiles_to_cells(tiles).repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).parquet(path)


def reingest_output(
    tiles: DataFrame, layer_path: str, catalog_path: str, time_index: int, dataset_id: int, ingest_id: int, name: str
) -> None:
    """Store a result as a new dataset at one time: its layer and its catalog rows.

    Results of other ingests at the same time keep their tiles where the keys differ; the result's plan runs once.
    """
    from ..operators.cover import tile_refs_of
    from .catalog import write_tile_catalog

    out = cut(tiles.withColumn("layer", F.lit(name)).withColumn("time_index", F.lit(time_index).cast("bigint")))
    upsert_layer(out, layer_path)
    cover = out.select(
        F.lit(ingest_id).cast("bigint").alias("ingest_id"),
        F.lit(dataset_id).cast("bigint").alias("dataset_id"),
        "zoom",
        "tile_x",
        "tile_y",
        "time_index",
        F.col("layer").alias("sensor"),
    ).distinct()
    write_tile_catalog(tile_refs_of(cover), catalog_path)
