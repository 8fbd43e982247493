"""Tile grid arithmetic: slippy tiles, layout keys, Z-order keys, Web Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col, intdiv, long_col, pow2

MIN_ZOOM = 4
MAX_ZOOM = 12
TILE_SIZE = 256
EARTH_RADIUS = 6378137.0
MAX_LAT = 85.0511287798066

#: the 7-bit numbers with bit i moved to bit 3i
_SPREAD = [sum((n >> i & 1) << 3 * i for i in range(7)) for n in range(128)]


def _spread(value: Column) -> Column:
    """Move bit i of a 21-bit value to bit 3i, seven bits at a time."""
    table = F.array(*[F.lit(n).cast("bigint") for n in _SPREAD])
    sevens = (F.get(table, F.shiftright(value, 7 * k).bitwiseAND(F.lit(127).cast("bigint")).cast("int")) for k in range(3))
    a, b, c = (F.shiftleft(seven, 21 * k) for k, seven in enumerate(sevens))
    return a.bitwiseOR(b).bitwiseOR(c)


def z_parts(time_index, y, x) -> tuple[Column, Column]:
    """The Z-order key as two non-negative longs (high, low); sorting by both sorts by the key.

    Bit i of argument d lands on position 3i+d, in the order time, y, x from the
    least significant bit. x and y take 21 bits, time takes 42.
    """
    t, y, x = long_col(time_index), long_col(y), long_col(x)
    low = (
        _spread(t)
        .bitwiseOR(F.shiftleft(_spread(y), 1))
        .bitwiseOR(F.shiftleft(_spread(x), 2))
    )
    high = _spread(F.shiftright(t, 21))
    return high, low


def z_index(time_index, y, x) -> Column:
    """The Z-order key as decimal(38,0); null where an argument does not fit its bits."""
    high, low = z_parts(time_index, y, x)
    scaled = high.cast("decimal(19,0)") * F.lit("9223372036854775808").cast("decimal(19,0)")
    fits = long_col(time_index).between(0, (1 << 42) - 1) & long_col(y).between(0, (1 << 21) - 1) & long_col(x).between(0, (1 << 21) - 1)
    return F.when(fits, (scaled + low.cast("decimal(19,0)")).cast("decimal(38,0)"))


def tile_lon(x, z) -> Column:
    return long_col(x) / pow2(z) * 360.0 - 180.0


def tile_lat(y, z) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * long_col(y) / pow2(z)))))


def tile_bbox(z, x, y) -> Column:
    """Longitude/latitude box of a slippy tile."""
    x, y = long_col(x), long_col(y)
    return F.struct(
        tile_lon(x, z).alias("xmin"),
        tile_lat(y + 1, z).alias("ymin"),
        tile_lon(x + 1, z).alias("xmax"),
        tile_lat(y, z).alias("ymax"),
    )


def lon_to_tile_x(lon, z) -> Column:
    n = pow2(z)
    raw = F.floor((as_col(lon) + 180.0) / 360.0 * n)
    return F.greatest(F.lit(0).cast("bigint"), F.least(raw, n - 1)).cast("int")


def lat_to_tile_y(lat, z) -> Column:
    n = pow2(z)
    lat = F.greatest(F.lit(-MAX_LAT), F.least(as_col(lat), F.lit(MAX_LAT)))
    raw = F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * n)
    return F.greatest(F.lit(0).cast("bigint"), F.least(raw, n - 1)).cast("int")


def point_to_tile(lon, lat, z) -> Column:
    return F.struct(lon_to_tile_x(lon, z).alias("tile_x"), lat_to_tile_y(lat, z).alias("tile_y"))


def box_ring(xmin, ymin, xmax, ymax) -> Column:
    """Closed five-point ring of a box, from the lower left corner going up."""
    def pt(x, y):
        return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"))

    return F.array(pt(xmin, ymin), pt(xmin, ymax), pt(xmax, ymax), pt(xmax, ymin), pt(xmin, ymin))


def tile_ring(z, x, y) -> Column:
    x, y = long_col(x), long_col(y)
    return box_ring(tile_lon(x, z), tile_lat(y + 1, z), tile_lon(x + 1, z), tile_lat(y, z))


def key_extent(origin_x, origin_y, cell_w, cell_h, tile_cols, tile_rows, tile_x, tile_y) -> Column:
    """Extent of a layout key; the origin is the layout's top left corner."""
    w = as_col(cell_w) * long_col(tile_cols)
    h = as_col(cell_h) * long_col(tile_rows)
    x0, y0 = as_col(origin_x), as_col(origin_y)
    tx, ty = long_col(tile_x), long_col(tile_y)
    return F.struct(
        (x0 + w * tx).alias("xmin"),
        (y0 - h * (ty + 1)).alias("ymin"),
        (x0 + w * (tx + 1)).alias("xmax"),
        (y0 - h * ty).alias("ymax"),
    )


def raster_extent(x0, dx, y0, dy, cols, rows) -> Column:
    """Extent from a north-up geotransform; dy is negative."""
    x0, y0 = as_col(x0), as_col(y0)
    x1 = x0 + as_col(dx) * long_col(cols)
    y1 = y0 + as_col(dy) * long_col(rows)
    return F.struct(
        F.least(x0, x1).alias("xmin"),
        F.least(y0, y1).alias("ymin"),
        F.greatest(x0, x1).alias("xmax"),
        F.greatest(y0, y1).alias("ymax"),
    )


def mercator_x(lon) -> Column:
    return F.radians(as_col(lon)) * EARTH_RADIUS


def mercator_y(lat) -> Column:
    return F.asinh(F.tan(F.radians(as_col(lat)))) * EARTH_RADIUS


def mercator_lon(x) -> Column:
    return F.degrees(as_col(x) / EARTH_RADIUS)


def mercator_lat(y) -> Column:
    return F.degrees(F.atan(F.sinh(as_col(y) / EARTH_RADIUS)))


def reproject_point(x, y, source: int, target: int) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857 or back; any other pair is an error."""
    if source == target:
        return as_col(x), as_col(y)
    if (source, target) == (4326, 3857):
        return mercator_x(x), mercator_y(y)
    if (source, target) == (3857, 4326):
        return mercator_lon(x), mercator_lat(y)
    raise ValueError(f"unsupported CRS pair {source} -> {target}")


def inside_data(view, data, view_crs: int = 4326, data_crs: int = 4326) -> Column:
    """Whether a view's box meets a layer's box, compared in the layer's CRS; an unsupported CRS is an error.

    view and data are struct columns or dicts with xmin, ymin, xmax, ymax.
    """
    from .geom import boxes_overlap

    for crs in (view_crs, data_crs):
        if crs not in (4326, 3857):
            raise ValueError(f"unsupported CRS {crs}")
    view = {k: as_col(view[k]) for k in ("xmin", "ymin", "xmax", "ymax")}
    if view_crs != data_crs:
        moved = reproject_extent(view, view_crs, data_crs)
        view = {k: moved[k] for k in view}
    return boxes_overlap(view, data)


def reproject_extent(extent: Column, source: int, target: int) -> Column:
    """Reproject the four corners and take their envelope."""
    corners = [
        reproject_point(extent[a], extent[b], source, target)
        for a in ("xmin", "xmax")
        for b in ("ymin", "ymax")
    ]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.struct(
        F.least(*xs).alias("xmin"),
        F.least(*ys).alias("ymin"),
        F.greatest(*xs).alias("xmax"),
        F.greatest(*ys).alias("ymax"),
    )


def reproject_ring(ring, source: int, target: int) -> Column:
    """Reproject each vertex of a ring."""
    def move(p):
        x, y = reproject_point(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(as_col(ring), move)


def pixel_offset(x, y, x0, y0, dx, dy) -> Column:
    """Cell of a raster under a point; dy is positive downwards from the top edge y0."""
    return F.struct(
        F.floor((as_col(x) - as_col(x0)) / as_col(dx)).cast("int").alias("col"),
        F.floor((as_col(y0) - as_col(y)) / as_col(dy)).cast("int").alias("row"),
    )


def cell_x(col, x0: float, dx: float) -> Column:
    """Centre longitude of a cell."""
    return F.lit(x0) + (as_col(col) + 0.5) * F.lit(dx)


def cell_y(row, y0: float, dy: float) -> Column:
    """Centre latitude of a cell; rows grow southwards."""
    return F.lit(y0) - (as_col(row) + 0.5) * F.lit(dy)


def clamp_zoom(z, low: int = MIN_ZOOM, high: int = MAX_ZOOM) -> Column:
    """Display zoom to storage level."""
    z = as_col(z).cast("int")
    return F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(high)), F.lit(low)))


def parse_tile_id(text) -> Column:
    """`level#x#y` to integers."""
    parts = F.split(as_col(text), "#")
    return F.struct(
        F.get(parts, F.lit(0)).try_cast("int").alias("zoom"),
        F.get(parts, F.lit(1)).try_cast("int").alias("tile_x"),
        F.get(parts, F.lit(2)).try_cast("int").alias("tile_y"),
    )


def parse_grid_id(text) -> Column:
    """Grid feature id `(x, y, level)` to integers."""
    nums = F.regexp_extract_all(as_col(text), F.lit(r"(-?\d+)"), F.lit(1))
    return F.struct(
        F.get(nums, F.lit(2)).try_cast("int").alias("zoom"),
        F.get(nums, F.lit(0)).try_cast("int").alias("tile_x"),
        F.get(nums, F.lit(1)).try_cast("int").alias("tile_y"),
    )


def tile_path(sensor, zoom, x, y, time_index) -> Column:
    """`{sensor}/{level}/{x}/{y}/{time}.tif`."""
    return F.concat(
        F.concat_ws("/", *[as_col(c).cast("string") for c in (sensor, zoom, x, y, time_index)]),
        F.lit(".tif"),
    )


def ancestor(x, y, dz) -> Column:
    """Ancestor key dz levels up, and the offset of the tile inside it."""
    n = pow2(dz)
    return F.struct(
        intdiv(x, n).cast("int").alias("tile_x"),
        intdiv(y, n).cast("int").alias("tile_y"),
        F.pmod(long_col(x), n).cast("int").alias("off_x"),
        F.pmod(long_col(y), n).cast("int").alias("off_y"),
    )
