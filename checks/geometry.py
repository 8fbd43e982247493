"""Polygons against cells, windows, density."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions.kernels import gaussian_kernel
from terracell.operators import cover, layout, levels, zonal
from terracell.operators.layout import Grid

from .fixture import GRID, TILE, WIDTH
from .registry import check

_CX = "68e0 + (col + 0.5e0) * 0.03125e0"
_CY = "36e0 - (row + 0.5e0) * 0.03125e0"


@check("zonal_cells", "select aoi_id, time_index, col, row, band, value from {{zonal}}")
def zonal_cells(fx):
    out = zonal.zonal_cells(fx.cells, fx.aois, GRID)
    return out.select("aoi_id", "time_index", "col", "row", "band", "value")


@check("zonal_histogram", "select aoi_id, cast(value as integer) as value, count(*) as n from {{zonal}} group by 1, 2")
def zonal_histogram(fx):
    return zonal.zonal_histogram(fx.cells, fx.aois, GRID)


@check(
    "zonal_mean_tiles",
    """select aoi_id, layer, time_index, band, count(value) as n, sum(value) as total, sum(value) / count(value) as mean
       from {{zonal}} group by 1, 2, 3, 4""",
)
def zonal_mean_tiles(fx):
    return zonal.zonal_mean_tiles(fx.tiles, fx.aois, GRID, TILE, by=["layer", "time_index", "band"])


@check(
    "zonal_mean",
    """select aoi_id, time_index, band, count(value) as n, sum(value) as total, sum(value) / count(value) as mean
       from {{zonal}} group by 1, 2, 3""",
)
def zonal_mean(fx):
    return zonal.zonal_mean(fx.cells, fx.aois, GRID, by=["time_index", "band"])


@check(
    "mean_ndi_by_aoi",
    """select a.aoi_id, n.time_index, count(*) as n, cast(sum(cast(floor(v * 1e6) as bigint)) as bigint) as micro_sum
       from (select *, case when b5 + b4 = 0 then 0e0 else (b5 - b4) / cast(b5 + b4 as double) end as v from {{wide}}
             where time_index between 864000 and 4320000) n
       join {{aois}} a on 36e0 - (n.row + 0.5e0) * 0.03125e0 between a.ymin and a.ymax
         and 68e0 + (n.col + 0.5e0) * 0.03125e0 - a.cx >= -(a.h - abs(36e0 - (n.row + 0.5e0) * 0.03125e0 - a.cy))
         and 68e0 + (n.col + 0.5e0) * 0.03125e0 - a.cx < a.h - abs(36e0 - (n.row + 0.5e0) * 0.03125e0 - a.cy)
       group by 1, 2""",
)
def mean_ndi_by_aoi(fx):
    from terracell.operators.algebra import ndi
    from terracell.operators.series import time_range

    cells = time_range(fx.cells, 864000, 4320000)
    micros = ndi((cells, 5), (cells, 4)).withColumn("value", F.floor(F.col("value") * 1e6))
    found = zonal.zonal_mean(micros, fx.aois, GRID, by=["time_index"])
    return found.select("aoi_id", "time_index", "n", F.col("total").cast("bigint").alias("micro_sum"))


_ALL_CELLS = """(select aoi_id, cx, cy, h, c as col, r as row from {{aois}},
    unnest(generate_series(cast(floor((xmin - 68) * 32) as bigint) - 1, cast(floor((xmax - 68) * 32) as bigint) + 1)) gc(c),
    unnest(generate_series(cast(floor((36 - ymax) * 32) as bigint) - 1, cast(floor((36 - ymin) * 32) as bigint) + 1)) gr(r)
    where c between 0 and 63 and r >= 0)"""
_IN = f"abs({_CY} - cy) <= h and {_CX} - cx >= -(h - abs({_CY} - cy)) and {_CX} - cx < h - abs({_CY} - cy)"


@check("rasterize_polygon", f"select aoi_id, cast(col as integer) as col, cast(row as integer) as row from {_ALL_CELLS} where {_IN}")
def rasterize_polygon(fx):
    return zonal.rasterize_polygon(fx.aois, GRID, cols=WIDTH)


@check(
    "clip_to_aoi",
    f"""select time_index, c.col, c.row, band, case when m.col is not null then value end as value from {{{{cells}}}} c
        left join (select distinct col, row from {_ALL_CELLS} where {_IN}) m on m.col = c.col and m.row = c.row""",
)
def clip_to_aoi(fx):
    return zonal.clip_to_aoi(fx.cells, fx.aois, GRID).select("time_index", "col", "row", "band", "value")


@check(
    "clip_tiles",
    f"""select time_index, c.col, c.row, band, value from {{{{cells}}}} c
        join (select distinct col, row from {_ALL_CELLS} where {_IN}) m on m.col = c.col and m.row = c.row where value is not null""",
)
def clip_tiles(fx):
    clipped = zonal.clip_tiles(fx.tiles, fx.aois, GRID, TILE, TILE)
    return layout.tiles_to_cells(clipped).select("time_index", "col", "row", "band", "value")


@check(
    "crop_window",
    f"select time_index, col, row, band, value from {{{{cells}}}} where {_CX} between 68.5e0 and 69.609375e0 and {_CY} between 34.5e0 and 35.9375e0",
)
def crop_window(fx):
    return layout.crop_window(fx.cells, GRID, 68.5, 34.5, 69.609375, 35.9375).select("time_index", "col", "row", "band", "value")


def _kernel_sql() -> str:
    rows = ", ".join(f"({dx}, {dy}, {k})" for dx, dy, k in gaussian_kernel() if k)
    return f"(values {rows}) k(dx, dy, w)"


@check(
    "kernel_density",
    f"""select cast(col + dx as integer) as col, cast(row + dy as integer) as row, cast(sum(weight * w) as double) as value from
        (select cast(floor((lon - 68e0) / 0.0078125e0) as integer) as col, cast(floor((36e0 - lat) / 0.0078125e0) as integer) as row, weight
         from {{{{points}}}}), {_kernel_sql()}
        where col + dx between 0 and 255 and row + dy between 0 and (select max(event_id) // 64 + 16 from events) group by 1, 2""",
)
def kernel_density(fx):
    fine = Grid(GRID.x0, GRID.y0, GRID.dx / 4, GRID.dy / 4)
    rows = fx.table("events").agg(F.max("event_id")).first()[0] // 64 + 17
    return zonal.kernel_density(fx.points, fine, 256, rows, gaussian_kernel())


def slippy_tiles(fx, zooms=(9, 10), size=16):
    """Stored slippy tiles of the fixture layer, one row per tile and time."""
    return levels.ingest_tiles(fx.cells, GRID, 5, list(zooms), size, "nearest")


# the slippy cells themselves: for every tile pixel the nearest source cell
SLIPPY = """(select z as zoom, tx as tile_x, ty as tile_y, i, j, px, py, c.time_index, c.band, c.value from (
      select *, tx0 + (i + 0.5e0) * (tx1 - tx0) / 16 as px, ty1 - (j + 0.5e0) * (ty1 - ty0) / 16 as py from (
        select z, tx, ty, tx / pow(2, z) * 360e0 - 180e0 as tx0, (tx + 1) / pow(2, z) * 360e0 - 180e0 as tx1,
               degrees(atan(sinh(pi() * (1 - 2 * ty / pow(2, z))))) as ty1, degrees(atan(sinh(pi() * (1 - 2 * (ty + 1) / pow(2, z))))) as ty0
        from (values (9), (10)) zz(z),
             unnest(generate_series(cast(floor(248 / 360e0 * pow(2, z)) as bigint) - 1, cast(floor(250 / 360e0 * pow(2, z)) as bigint) + 1)) gx(tx),
             unnest(generate_series(cast(floor((1 - asinh(tan(radians(36e0))) / pi()) / 2 * pow(2, z)) as bigint) - 1,
                cast(floor((1 - asinh(tan(radians(36e0 - (select max(row) + 2 from {{wide}}) / 32e0))) / pi()) / 2 * pow(2, z)) as bigint) + 1)) gy(ty)) t,
        unnest(generate_series(0, 15)) gi(i), unnest(generate_series(0, 15)) gj(j)) p
    join {{cells}} c on c.col = cast(floor((px - 68e0) / 0.03125e0) as integer) and c.row = cast(floor((36e0 - py) / 0.03125e0) as integer))"""


@check(
    "aoi_data",
    f"""select aoi_id, cast(tile_x as integer) as tile_x, cast(tile_y as integer) as tile_y, cast(i as integer) as col, cast(j as integer) as row, band, arg_max(value, time_index) as value
        from {SLIPPY} s join {{{{aois}}}} a on px between a.xmin and a.xmax and py between a.ymin and a.ymax
        where zoom = 10 and time_index in (0, 864000) group by 1, 2, 3, 4, 5, 6""",
)
def aoi_data(fx):
    out = cover.aoi_data(fx.aois, slippy_tiles(fx), 10, [0, 864000])
    return out.select("aoi_id", "tile_x", "tile_y", "col", "row", "band", "value")
