"""Scalar projections over rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions import bands as B
from terracell.functions import geom, grid, timeindex
from terracell.operators import layout, series
from terracell.sources import catalog, rasters

from .fixture import GRID, TILE
from .registry import check, micro
from .sql import micro as sql_micro

_Z = "cast(4 + event_id % 12 as integer)"


def _tile_of(lon: str, lat: str, z: str) -> tuple[str, str]:
    return (
        f"cast(floor(({lon} + 180) / 360 * pow(2, {z})) as integer)",
        f"cast(floor((1 - asinh(tan(radians({lat}))) / pi()) / 2 * pow(2, {z})) as integer)",
    )


def _points_with_tile(fx):
    """Points with a zoom 4..15 and the tile they fall in."""
    z = (4 + F.col("point_id") % 12).cast("int")
    return fx.points.withColumn("z", z).withColumn("t", grid.point_to_tile("lon", "lat", "z"))


_TX, _TY = _tile_of("lon", "lat", "z")
_POINT_TILES = f"""(select point_id, lon, lat, z, {_TX} as tile_x, {_TY} as tile_y
    from (select *, cast(4 + point_id % 12 as integer) as z from {{{{points}}}}))"""


@check("ts_to_time_index", "select o_orderkey, cast(epoch(o_orderdate) as bigint) - 631152000 as time_index from orders")
def ts_to_time_index(fx):
    return fx.table("orders").select("o_orderkey", timeindex.ts_to_time_index("o_orderdate").alias("time_index"))


@check(
    "time_index_to_ts",
    """select event_id, cast(floor(epoch(ts)) as bigint) - 631152000 as time_index,
              strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as ts_text from events""",
)
def time_index_to_ts(fx):
    at = timeindex.ts_to_time_index("ts")
    back = F.date_format(timeindex.time_index_to_ts("time_index"), "yyyy-MM-dd HH:mm:ss")
    return fx.table("events").select("event_id", at.alias("time_index")).withColumn("ts_text", back)


_Z_KEY = " + ".join(
    f"((({arg}) >> {i}) & 1)::hugeint * {2 ** (3 * i + d)}::hugeint"
    for d, (arg, bits) in enumerate([("time_index", 31), ("tile_y", 16), ("tile_x", 16)])
    for i in range(bits)
)


@check(
    "z_index",
    f"""select point_id, cast({_Z_KEY} as varchar) as z_index from
        (select p.*, cast(floor(epoch(ts)) as bigint) - 631152000 as time_index
         from {_POINT_TILES} p join events e on e.event_id = p.point_id)""",
)
def z_index(fx):
    at = fx.table("events").select(F.col("event_id").alias("point_id"), timeindex.ts_to_time_index("ts").alias("time_index"))
    key = grid.z_index("time_index", F.col("t.tile_y"), F.col("t.tile_x")).cast("string")
    return _points_with_tile(fx).join(at, "point_id").select("point_id", key.alias("z_index"))


_BBOX = [
    sql_micro("tile_x / pow(2, z) * 360e0 - 180e0", "xmin"),
    sql_micro("degrees(atan(sinh(pi() * (1 - 2 * (tile_y + 1) / pow(2, z)))))", "ymin"),
    sql_micro("(tile_x + 1) / pow(2, z) * 360e0 - 180e0", "xmax"),
    sql_micro("degrees(atan(sinh(pi() * (1 - 2 * tile_y / pow(2, z)))))", "ymax"),
]


@check("tile_bbox", f"select point_id, {', '.join(_BBOX)} from {_POINT_TILES}")
def tile_bbox(fx):
    box = grid.tile_bbox("z", F.col("t.tile_x"), F.col("t.tile_y"))
    return _points_with_tile(fx).select("point_id", *[micro(box[k], k) for k in ("xmin", "ymin", "xmax", "ymax")])


@check("point_to_tile", f"select point_id, z, tile_x, tile_y from {_POINT_TILES}")
def point_to_tile(fx):
    return _points_with_tile(fx).select("point_id", "z", "t.tile_x", "t.tile_y")


@check(
    "tile_geometry",
    f"""select point_id, pos, {sql_micro("x", "x")}, {sql_micro("y", "y")} from
        (select point_id, unnest([1, 2, 3, 4, 5]) as pos,
                unnest([w, w, e, e, w]) as x, unnest([s, n, n, s, s]) as y from
          (select point_id, tile_x / pow(2, z) * 360e0 - 180e0 as w, (tile_x + 1) / pow(2, z) * 360e0 - 180e0 as e,
                  degrees(atan(sinh(pi() * (1 - 2 * (tile_y + 1) / pow(2, z))))) as s,
                  degrees(atan(sinh(pi() * (1 - 2 * tile_y / pow(2, z))))) as n from {_POINT_TILES}))""",
)
def tile_geometry(fx):
    ring = grid.tile_ring("z", F.col("t.tile_x"), F.col("t.tile_y"))
    return _points_with_tile(fx).select("point_id", F.posexplode(ring).alias("p", "v")).select(
        "point_id", (F.col("p") + 1).alias("pos"), micro("v.x", "x"), micro("v.y", "y")
    )


@check(
    "key_extent",
    """select distinct tile_x, tile_y, 68e0 + tile_x * 0.5e0 as xmin, 36e0 - (tile_y + 1) * 0.5e0 as ymin,
              68e0 + (tile_x + 1) * 0.5e0 as xmax, 36e0 - tile_y * 0.5e0 as ymax
       from (select cast(col // 16 as integer) as tile_x, cast(row // 16 as integer) as tile_y from {{wide}})""",
)
def key_extent(fx):
    ext = grid.key_extent(GRID.x0, GRID.y0, GRID.dx, GRID.dy, TILE, TILE, "tile_x", "tile_y")
    return fx.tiles.select("tile_x", "tile_y").distinct().withColumn("e", ext).select("tile_x", "tile_y", "e.*")


@check(
    "raster_extent",
    """select ingest_id, xmin, ymax - 0.0078125e0 * h as ymin, xmin + 0.0078125e0 * w as xmax, ymax
       from (select *, 10 + ingest_id % 50 as w, 20 + ingest_id % 30 as h from {{scenes}})""",
)
def raster_extent(fx):
    w, h = 10 + F.col("ingest_id") % 50, 20 + F.col("ingest_id") % 30
    ext = grid.raster_extent("xmin", 0.0078125, "ymax", -0.0078125, w, h)
    return fx.scenes.select("ingest_id", ext.alias("e")).select("ingest_id", "e.*")


_RAD = "6378137e0"


@check(
    "reproject_extent",
    f"""select ingest_id, {sql_micro(f"radians(xmin) * {_RAD} / 1e3", "xmin")},
               {sql_micro(f"asinh(tan(radians(ymin))) * {_RAD} / 1e3", "ymin")},
               {sql_micro(f"radians(xmax) * {_RAD} / 1e3", "xmax")},
               {sql_micro(f"asinh(tan(radians(ymax))) * {_RAD} / 1e3", "ymax")},
               {sql_micro("xmin", "lon")}, {sql_micro("ymin", "lat")} from {{{{scenes}}}}""",
)
def reproject_extent(fx):
    ext = F.struct("xmin", "ymin", "xmax", "ymax")
    there = fx.scenes.select("ingest_id", grid.reproject_extent(ext, 4326, 3857).alias("m"))
    back = there.withColumn("b", grid.reproject_extent(F.col("m"), 3857, 4326))
    corners = [micro(F.col(f"m.{k}") / 1e3, k) for k in ("xmin", "ymin", "xmax", "ymax")]  # kilometres
    return back.select("ingest_id", *corners, micro("b.xmin", "lon"), micro("b.ymin", "lat"))


@check(
    "pixel_offset",
    """select point_id, cast(floor((lon - 68e0) / 0.03125e0) as integer) as col,
              cast(floor((36e0 - lat) / 0.03125e0) as integer) as row from {{points}}""",
)
def pixel_offset(fx):
    at = grid.pixel_offset("lon", "lat", GRID.x0, GRID.y0, GRID.dx, GRID.dy)
    return fx.points.select("point_id", at.alias("p")).select("point_id", "p.col", "p.row")


@check(
    "select_bands",
    """select layer, time_index, col, row, case band when 4 then 1 else 2 end as band, value
       from {{cells}} where band in (4, 2)""",
)
def select_bands(fx):
    return layout.select_bands(fx.cells, [4, 2])


@check(
    "convert_cell_type",
    """select layer, time_index, col, row, band, case when value between -32768 and 32767 then cast(value as bigint) end as value
       from {{cells}}""",
)
def convert_cell_type(fx):
    cells = layout.convert_cell_type(fx.cells, "int16")
    return cells.withColumn("value", F.col("value").cast("bigint"))


@check("parse_tile_id", f"select point_id, z as zoom, tile_x, tile_y, z as gzoom, tile_x as gx, tile_y as gy from {_POINT_TILES}")
def parse_tile_id(fx):
    p = _points_with_tile(fx).select("point_id", "z", "t.*")
    texts = p.select(
        "point_id",
        F.concat_ws("#", "z", "tile_x", "tile_y").alias("a"),
        F.format_string("(%d, %d, %d)", "tile_x", "tile_y", "z").alias("b"),
    )
    a, b = grid.parse_tile_id("a"), grid.parse_grid_id("b")
    return texts.select(
        "point_id", a["zoom"].alias("zoom"), a["tile_x"].alias("tile_x"), a["tile_y"].alias("tile_y"),
        b["zoom"].alias("gzoom"), b["tile_x"].alias("gx"), b["tile_y"].alias("gy"),
    )


@check("clamp_zoom", "select event_id, cast(least(greatest(event_id % 19, 4), 12) as integer) as zoom from events")
def clamp_zoom(fx):
    return fx.table("events").select("event_id", grid.clamp_zoom(F.col("event_id") % 19).alias("zoom"))


@check(
    "tile_path",
    f"""select point_id, 'S' || (point_id % 10) || '/' || z || '/' || tile_x || '/' || tile_y || '/' || point_id || '.tif' as path
        from {_POINT_TILES}""",
)
def tile_path(fx):
    p = _points_with_tile(fx).withColumn("sensor", F.concat(F.lit("S"), (F.col("point_id") % 10).cast("string")))
    return p.select("point_id", grid.tile_path("sensor", "z", F.col("t.tile_x"), F.col("t.tile_y"), "point_id").alias("path"))


@check(
    "band_to_timestep",
    """select layer, time_index + (band - 1) * 864000 as time_index, col, row, 1 as band, value
       from {{cells}} where time_index = 0 or band <= 36""",
)
def band_to_timestep(fx):
    return series.band_to_timestep(fx.cells)


@check(
    "timestep_slot",
    """select layer, time_index, col, row, band, value,
              cast(((select max(time_index) from {{wide}}) - time_index) // 864000 as integer) as slot from {{cells}}""",
)
def timestep_slot(fx):
    return series.timestep_slots(fx.cells)


@check(
    "parse_dates",
    """select o_orderkey, cast(epoch(o_orderdate) as bigint) as day_start, cast(epoch(o_orderdate) as bigint) + 16204 as instant,
              cast(null as bigint) as malformed from orders""",
)
def parse_dates(fx):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return fx.table("orders").select(
        "o_orderkey",
        F.unix_seconds(timeindex.parse_day(day)).alias("day_start"),
        F.unix_seconds(timeindex.parse_instant(F.concat(day, F.lit("T04:30:04Z")))).alias("instant"),
        F.unix_seconds(timeindex.parse_day(F.concat(F.lit("x"), day))).alias("malformed"),
    )


@check(
    "decode_geometry",
    """select aoi_id, xmin, ymin, xmax, ymax, 5 as points, xmin as gxmin, ymax as gymax, 5 as bpoints from {{aois}}""",
)
def decode_geometry(fx):
    coded = fx.aois.select("aoi_id", geom.ring_to_ewkb("ring").alias("wkb"), geom.ring_to_geojson("ring").alias("json"))
    rings = coded.select("aoi_id", geom.ring_from_ewkb("wkb").alias("ring"), geom.ring_from_geojson("json").alias("gring"))
    out = rings.select("aoi_id", geom.envelope("ring").alias("e"), geom.envelope("gring").alias("g"), "ring")
    box = geom.ring_from_geojson(geom.box_to_geojson(F.col("e.xmin"), F.col("e.ymin"), F.col("e.xmax"), F.col("e.ymax")))
    return out.select(
        "aoi_id", "e.*", F.size("ring").alias("points"), F.col("g.xmin").alias("gxmin"), F.col("g.ymax").alias("gymax"),
        F.size(box).alias("bpoints"),
    )


@check(
    "scale_offset",
    """select c.time_index, c.col, c.row, c.band, c.value * d.scale_factor + d.value_offset as value
       from {{cells}} c join {{datasets}} d on d.dataset_id = c.col % 10""",
)
def scale_offset(fx):
    cells = fx.cells.withColumn("dataset_id", F.pmod("col", F.lit(10)).cast("bigint"))
    joined = catalog.with_dataset(cells, fx.datasets, ["scale_factor", "value_offset"])
    return joined.select("time_index", "col", "row", "band", B.scale_offset("value", "scale_factor", "value_offset").alias("value"))


@check(
    "rescale_16_to_8",
    "select time_index, col, row, band, cast(floor(256 * (value % 65536) / 65536) as integer) as value from {{cells}}",
)
def rescale_16_to_8(fx):
    return fx.cells.select("time_index", "col", "row", "band", B.rescale_16_to_8(F.col("value") % 65536).alias("value"))


@check(
    "parse_band_meta",
    """select dataset_id, 1 as band, 'n' || dataset_id as name, 'band one' as description, 0e0 as min,
              cast(s_nationkey as double) as max from {{datasets}} where dataset_id % 7 <> 3
       union all select dataset_id, 2, 'm' || dataset_id, 'band two', 1e0, 2e0 from {{datasets}} where dataset_id % 7 <> 3""",
)
def parse_band_meta(fx):
    return catalog.parse_band_meta(fx.datasets)


@check(
    "nodata_mask",
    """select time_index, col, row, band, case when value <> 0 then value end as value from {{cells}}""",
)
def nodata_mask(fx):
    return fx.cells.select("time_index", "col", "row", "band", B.nodata_to_null("value", 0).alias("value"))


@check(
    "inside_data",
    """select ingest_id, xmin <= 70 and xmax >= 68 and ymin <= 36 and ymax >= 34 as inside from {{scenes}}""",
)
def inside_data(fx):
    row = {k: F.col(k) for k in ("xmin", "ymin", "xmax", "ymax")}
    data = {"xmin": 68.0, "ymin": 34.0, "xmax": 70.0, "ymax": 36.0}
    return fx.scenes.select("ingest_id", grid.inside_data(row, data).alias("inside"))


@check(
    "scene_metadata",
    """select o_orderkey, cast(epoch(o_orderdate) as bigint) + (o_orderkey % 24) * 3600 + 1804 as at from orders""",
)
def scene_metadata(fx):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    time = F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":30:04.3876230Z"))
    text = F.format_string(
        '{"LANDSAT_METADATA_FILE":{"IMAGE_ATTRIBUTES":{"DATE_ACQUIRED":"%s","SCENE_CENTER_TIME":"%s"}}}', day, time
    )
    out = rasters.scene_metadata(fx.table("orders").select("o_orderkey", text.alias("json")))
    return out.select("o_orderkey", F.unix_seconds("scene_time").alias("at"))


@check(
    "scene_from_filename",
    "select o_orderkey, cast(epoch(date_trunc('month', o_orderdate)) as bigint) - 631152000 as time_index from orders",
)
def scene_from_filename(fx):
    name = F.concat(F.lit("LC08_x_y_"), F.date_format("o_orderdate", "yyyy_MM"), F.lit(".tif"))
    out = rasters.scenes_from_filenames(fx.table("orders").select("o_orderkey", name.alias("name")))
    return out.select("o_orderkey", "time_index")
