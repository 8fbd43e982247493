"""Scans, sinks and the streaming ingest: written tables are read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions.timeindex import ts_to_time_index
from terracell.operators import layout
from terracell.sources import catalog, layers, rasters
from terracell.streaming.ingest import stream_scene_ingest as start_ingest

from .fixture import GRID, TILE
from .registry import check

_CELLS = "select layer, time_index, col, row, band, value from {{cells}}"


def _json_decoder():
    """Raster codec of the checks: one JSON tile per line. A local function, so that it travels to
    the workers by value."""

    def decode(path, content):
        import json

        for line in content.decode().splitlines():
            t = json.loads(line)
            yield {k: t[k] for k in ("tile_x", "tile_y", "cols", "rows", "bands")}

    return decode


def _raw_tiles(fx, name):
    """The tiles as raw files, one folder per year: year 1995 + step."""
    path = fx.scratch(name)
    year = (F.lit(1995) + F.col("time_index") / 864000).cast("int")
    named = fx.tiles.withColumn("scene", F.concat(F.lit("Test"), year.cast("string"), F.lit("-99.json")))
    named.drop("layer", "zoom", "time_index").write.partitionBy("scene").json(path, ignoreNullFields=False)
    return path


@check("scan_multiband", "select time_index, col, row, band, value from {{cells}}")
def scan_multiband(fx):
    path = fx.scratch("tiles")
    fx.tiles.write.parquet(path)
    return layout.tiles_to_cells(rasters.scan_multiband(fx.spark, path)).drop("layer")


@check("scan_multiband_decoded", "select col, row, band, count(*) as n, sum(value) as total from {{cells}} group by 1, 2, 3")
def scan_multiband_decoded(fx):
    tiles = rasters.scan_multiband(fx.spark, _raw_tiles(fx, "raw"), _json_decoder())
    return layout.tiles_to_cells(tiles).groupBy("col", "row", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@check("scan_singleband", "select time_index, col, row, 1 as band, value from {{cells}} where band = 4")
def scan_singleband(fx):
    return layout.tiles_to_cells(rasters.scan_singleband(fx.tiles, 4)).drop("layer")


@check(
    "scan_glob_timestamped",
    """select cast(epoch(make_timestamp(1995 + time_index // 864000, 1, 1, 0, 0, 0)) as bigint) - 631152000 as time_index, col, row, band, value from {{cells}}""",
)
def scan_glob_timestamped(fx):
    tiles = rasters.scan_glob_timestamped(fx.spark, _raw_tiles(fx, "glob"), _json_decoder(), "part-*")
    return layout.tiles_to_cells(tiles).drop("layer")


@check("scan_year_bands", "select time_index + (band - 1) * 864000 as time_index, col, row, 1 as band, value from {{cells}}")
def scan_year_bands(fx):
    return rasters.scan_year_bands(fx.cells).drop("layer")


@check("scan_dated_scene", "select 913523404 :: bigint as time_index, col, row, band, value from {{cells}}")
def scan_dated_scene(fx):
    return layout.tiles_to_cells(rasters.scan_dated_scene(fx.tiles, "2018-12-13T04:30:04Z")).drop("layer")


@check("scan_row_strips", "select time_index, band, row, col as pos, value, cast(col // 16 as integer) as segment from {{cells}}")
def scan_row_strips(fx):
    strips = rasters.scan_row_strips(fx.cells, 16)
    return strips.select("time_index", "band", "row", "segment", F.inline("strip"))


@check("scan_col_strips", "select time_index, band, col, row as pos, value, cast(row // 16 as integer) as segment from {{cells}}")
def scan_col_strips(fx):
    strips = rasters.scan_col_strips(fx.cells, 16)
    return strips.select("time_index", "band", "col", "segment", F.inline("strip"))


@check(
    "row_lists",
    """select time_index, row, col, cast(row_number() over (partition by time_index, row order by col) as integer) as pos,
              cast(b1 as double) as v1, cast(b5 as double) as v2 from {{wide}}""",
)
def row_lists(fx):
    rows = layout.row_lists(fx.cells, [1, 5])
    return rows.select("time_index", "row", F.posexplode("cells").alias("p", "c")).select(
        "time_index", "row", "c.col", (F.col("p") + 1).alias("pos"), F.col("c.vector")[0].alias("v1"), F.col("c.vector")[1].alias("v2")
    )


@check(
    "stack_bands",
    "select time_index, col, row, cast(b5 as double) as v1, cast(b1 as double) as v2, cast(null as double) as v3 from {{wide}}",
)
def stack_bands(fx):
    out = rasters.stack_bands(fx.cells, [5, 1, 7])
    return out.select("time_index", "col", "row", *[F.col("bands")[i].alias(f"v{i + 1}") for i in range(3)])


@check("write_layer", _CELLS)
def write_layer(fx):
    path = fx.scratch("layer")
    layers.write_layer(fx.tiles, path)
    return layout.tiles_to_cells(layers.read_layer(fx.spark, path))


@check("write_layer_temporal", _CELLS)
def write_layer_temporal(fx):
    path = fx.scratch("layer")
    layers.write_layer_temporal(fx.tiles, path, 10)
    return layout.tiles_to_cells(layers.read_layer(fx.spark, path))


@check(
    "upsert_layer",
    """select layer, time_index, col, row, band, case when time_index = 864000 then value * 2 else value end as value from {{cells}}""",
)
def upsert_layer(fx):
    path = fx.scratch("layer")
    layers.upsert_layer(fx.tiles, path)
    double = F.transform("bands", lambda band: F.transform(band, lambda v: v * 2))
    layers.upsert_layer(fx.tiles.filter("time_index = 864000").withColumn("bands", double), path)
    return layout.tiles_to_cells(layers.read_layer(fx.spark, path)).withColumn("time_index", F.col("time_index").cast("bigint"))


def _stored(fx):
    path = fx.scratch("layer")
    layers.write_layer(fx.tiles, path)
    return layers.read_layer(fx.spark, path)


@check(
    "layer_query",
    """select time_index, col, row, band, value from {{cells}}
       where col // 16 between 1 and 2 and row // 16 between 0 and 1 and time_index between 864000 and 2592000""",
)
def layer_query(fx):
    found = layers.layer_query(_stored(fx), "lineitem", 0, (1, 0, 2, 1), 864000, 2592000)
    return layout.tiles_to_cells(found).drop("layer")


@check("layer_intersects", "select time_index, col, row, band, value from {{cells}} where col // 16 in (1, 2) and row // 16 in (0, 1)")
def layer_intersects(fx):
    found = layers.layer_intersects(_stored(fx), GRID, TILE, TILE, (68.5, 35.0, 69.25, 35.75))
    return layout.tiles_to_cells(found).drop("layer")


@check("layer_catalog", "select layer, 0 as max_zoom, count(distinct (col // 16, row // 16, time_index)) as tiles from {{wide}} group by 1")
def layer_catalog(fx):
    return layers.layer_catalog(_stored(fx))


@check("stitch_export", "select layer, time_index, col, row, band, value from {{cells}}")
def stitch_export(fx):
    path = fx.scratch("stitched")
    layers.stitch_export(fx.tiles, path)
    return fx.spark.read.parquet(path)


_REF_ROWS = """select ingest_id, dataset_id, zoom as zoom_level, time_index, tile_x as spatial_index_x, tile_y as spatial_index_y,
              'S' || dataset_id || '/' || zoom || '/' || tile_x || '/' || tile_y || '/' || time_index || '.tif' as file_path
       from {{cover}}"""
_REF_COLUMNS = ["ingest_id", "dataset_id", "zoom_level", "time_index", "spatial_index_x", "spatial_index_y", "file_path"]


@check("write_tile_catalog", _REF_ROWS)
def write_tile_catalog(fx):
    path = fx.scratch("tile_refs")
    half = fx.tile_refs.filter(F.col("ingest_id") % 2 == 0)
    catalog.write_tile_catalog(half.unionByName(half.filter("zoom_level < 8")), path)  # some keys twice in a batch
    catalog.write_tile_catalog(fx.tile_refs, path)  # the first half again: adds only what is missing
    return fx.spark.read.parquet(path).select(*_REF_COLUMNS)


@check("write_scenes", "select ingest_id, dataset_id, time_index, xmin, ymin, xmax, ymax from {{scenes}}")
def write_scenes(fx):
    path = fx.scratch("scenes")
    catalog.write_scenes(fx.scenes.filter(F.col("ingest_id") % 2 == 0), path)
    catalog.write_scenes(fx.scenes, path)
    return fx.spark.read.parquet(path)


@check(
    "reingest_output",
    """select 'SingleRasterBand' as layer, col, row, value, 'SingleRasterBand/0/' || (col // 16) || '/' || (row // 16) || '/1050755451.tif' as file_path
       from {{cells}} where band = 1 and time_index = 0""",
)
def reingest_output(fx):
    layer_path, catalog_path = fx.scratch("layer"), fx.scratch("tile_refs")
    result = rasters.scan_singleband(fx.tiles.filter("time_index = 0"), 1)
    layers.reingest_output(result, layer_path, catalog_path, 1050755451, 3, 5, "SingleRasterBand")
    cells = layout.tiles_to_cells(layers.read_layer(fx.spark, layer_path))
    refs = fx.spark.read.parquet(catalog_path).select("spatial_index_x", "spatial_index_y", "file_path")
    at = cells.withColumns(
        {"spatial_index_x": (F.col("col") / TILE).cast("int"), "spatial_index_y": (F.col("row") / TILE).cast("int")}
    )
    return at.join(refs, ["spatial_index_x", "spatial_index_y"]).select("layer", "col", "row", "value", "file_path")


@check(
    "stream_scene_ingest",
    """select event_id as ingest_id, event_id % 7 as dataset_id, cast(z as integer) as zoom_level, time_index,
              cast(x as integer) as spatial_index_x, cast(y as integer) as spatial_index_y,
              'events/' || z || '/' || x || '/' || y || '/' || time_index || '.tif' as file_path from (
        select *, x / pow(2, z) * 360e0 - 180e0 as tx0, (x + 1) / pow(2, z) * 360e0 - 180e0 as tx1,
               degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, z))))) as ty1, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2, z))))) as ty0
        from (select event_id, cast(floor(epoch(ts)) as bigint) - 631152000 as time_index,
                     67.5e0 + (event_id * 37 % 160) / 64e0 as xmin, 35.75e0 - event_id % 16384 / 8192e0 as ymin,
                     67.75e0 + (event_id * 37 % 160) / 64e0 as xmax, 36e0 - event_id % 16384 / 8192e0 as ymax from events) s,
             unnest(generate_series(4, 12)) g(z),
             unnest(generate_series(cast(floor((xmin + 180) / 360 * pow(2, z)) as bigint) - 1, cast(floor((xmax + 180) / 360 * pow(2, z)) as bigint) + 1)) gx(x),
             unnest(generate_series(cast(floor((1 - asinh(tan(radians(ymax))) / pi()) / 2 * pow(2, z)) as bigint) - 1,
                                    cast(floor((1 - asinh(tan(radians(ymin))) / pi()) / 2 * pow(2, z)) as bigint) + 1)) gy(y))
       where tx0 <= xmax and tx1 >= xmin and ty0 <= ymax and ty1 >= ymin""",
)
def stream_scene_ingest(fx):
    """All levels, several scenes a dataset, and acquisition times in no order."""
    path, checkpoint = fx.scratch("tile_refs"), fx.scratch("stream")
    schema = fx.table("events").schema
    arriving = fx.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(fx.sf_dir)
    xmin = 67.5 + F.pmod(F.col("event_id") * 37, F.lit(160)) / 64
    ymin = 35.75 - F.pmod("event_id", F.lit(16384)) / 8192
    scenes = arriving.select(
        F.col("event_id").alias("ingest_id"),
        F.pmod("event_id", F.lit(7)).alias("dataset_id"),
        ts_to_time_index("ts").alias("time_index"),
        xmin.alias("xmin"),
        ymin.alias("ymin"),
        (xmin + 0.25).alias("xmax"),
        (ymin + 0.25).alias("ymax"),
        F.lit("events").alias("sensor"),
    )
    start_ingest(scenes, path, checkpoint, scenes_path=fx.scratch("scenes")).awaitTermination()
    return fx.spark.read.parquet(path).select(*_REF_COLUMNS)
