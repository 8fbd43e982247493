"""Resampling, pyramids and re-cutting."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terracell.operators import layout, levels, resample
from terracell.operators.algebra import fill_empty
from terracell.operators.layout import Grid

from .fixture import GRID, WIDTH
from .geometry import SLIPPY
from .registry import check, micro
from .sql import micro as sql_micro

# half-size cells, shifted by a quarter cell; the height follows the layer
_DST = Grid(GRID.x0 + GRID.dx / 4, GRID.y0 - GRID.dy / 4, GRID.dx / 2, GRID.dy / 2)
_COLS = 126


def _rows(fx) -> int:
    return 2 * (fx.wide.agg(F.max("row")).first()[0] + 1)


_TARGET = f"""(select i, j, (68e0 + 0.03125e0 / 4 + (i + 0.5e0) * 0.015625e0 - 68e0) / 0.03125e0 - 0.5e0 as u,
     (36e0 - (36e0 - 0.03125e0 / 4 - (j + 0.5e0) * 0.015625e0)) / 0.03125e0 - 0.5e0 as v
     from unnest(generate_series(0, {_COLS - 1})) gi(i), unnest(generate_series(0, (select 2 * max(row) + 1 from {{{{wide}}}}))) gj(j))"""
_OUT = "c.time_index, cast(i as integer) as col, cast(j as integer) as row, c.band"


@check(
    "resample_nearest",
    f"""select {_OUT}, c.value from {_TARGET} t join {{{{cells}}}} c
        on c.col = cast(floor(u + 0.5e0) as integer) and c.row = cast(floor(v + 0.5e0) as integer)""",
)
def resample_nearest(fx):
    out = resample.resample(fx.cells, GRID, _DST, _COLS, _rows(fx), "nearest")
    return out.select("time_index", "col", "row", "band", "value")


def _gathered(weight, span, target=_TARGET):
    return f"""select time_index, col, row, band, {sql_micro("s / w / case when band = 3 then 1e6 else 1e0 end", "value")} from (
        select {_OUT}, sum(c.value * {weight('u - c.col')} * {weight('v - c.row')}) as s, sum({weight('u - c.col')} * {weight('v - c.row')}) as w,
               sum(abs({weight('u - c.col')} * {weight('v - c.row')})) as size
        from {target} t, unnest(generate_series({span[0]}, {span[1]})) ga(a), unnest(generate_series({span[0]}, {span[1]})) gb(b),
             {{{{cells}}}} c
        where c.col = cast(floor(u) as integer) + a and c.row = cast(floor(v) as integer) + b
          and {weight('u - c.col')} <> 0 and {weight('v - c.row')} <> 0
        group by 1, 2, 3, 4) where abs(w) > size * 1e-9"""


def _gathered_whole(weight, span, target=_TARGET):
    """Every target cell that a weight reaches: the mean by the weights' size where the weights cancel."""
    return f"""select time_index, col, row, band, {sql_micro("case when abs(w) > size * 1e-9 then s / w else a / size end / case when band = 3 then 1e6 else 1e0 end", "value")} from (
        select {_OUT}, sum(c.value * {weight('u - c.col')} * {weight('v - c.row')}) as s, sum({weight('u - c.col')} * {weight('v - c.row')}) as w,
               sum(c.value * abs({weight('u - c.col')} * {weight('v - c.row')})) as a, sum(abs({weight('u - c.col')} * {weight('v - c.row')})) as size
        from {target} t, unnest(generate_series({span[0]}, {span[1]})) ga(a), unnest(generate_series({span[0]}, {span[1]})) gb(b),
             {{{{cells}}}} c
        where c.col = cast(floor(u) as integer) + ga.a and c.row = cast(floor(v) as integer) + b
          and {weight('u - c.col')} <> 0 and {weight('v - c.row')} <> 0
        group by 1, 2, 3, 4)"""


def _linear(d):
    return f"greatest(1 - abs({d}), 0)"


def _cubic(d):
    return (
        f"(case when abs({d}) <= 1 then 1.5e0 * abs({d}) * abs({d}) * abs({d}) - 2.5e0 * abs({d}) * abs({d}) + 1"
        f" when abs({d}) < 2 then -0.5e0 * abs({d}) * abs({d}) * abs({d}) + 2.5e0 * abs({d}) * abs({d}) - 4 * abs({d}) + 2 else 0 end)"
    )


def _scaled():
    """Values in millionths; band 3, whose numbers are large, in millions first."""
    return micro(F.col("value") / F.when(F.col("band") == 3, 1e6).otherwise(1.0), "value")


@check("resample_bilinear", _gathered(_linear, (0, 1)))
def resample_bilinear(fx):
    out = resample.resample(fx.cells, GRID, _DST, _COLS, _rows(fx), "bilinear")
    return out.select("time_index", "col", "row", "band", _scaled())


@check("resample_bicubic", _gathered_whole(_cubic, (-1, 2)))
def resample_bicubic(fx):
    out = resample.resample(fx.cells, GRID, _DST, _COLS, _rows(fx), "cubic", fill_cancelled=True)
    return out.select("time_index", "col", "row", "band", _scaled())


@check("resample_tiles_bicubic", _gathered(_cubic, (-1, 2)))
def resample_tiles_bicubic(fx):
    out = resample.resample_tiles(fx.tiles, GRID, _DST, _COLS, _rows(fx), "cubic")
    return out.select("time_index", "col", "row", "band", _scaled())


# Web Mercator cells of 4 km from the layer's top left corner
_R = 6378137.0
_MX, _MY, _MD = 7569000.0, 4300000.0, 4000.0
_MCOLS = 56
_MERC = f"""(select i, j, (degrees(({_MX:.1f}e0 + (i + 0.5e0) * {_MD:.1f}e0) / {_R:.1f}e0) - 68e0) / 0.03125e0 - 0.5e0 as u,
     (36e0 - degrees(atan(sinh(({_MY:.1f}e0 - (j + 0.5e0) * {_MD:.1f}e0) / {_R:.1f}e0)))) / 0.03125e0 - 0.5e0 as v
     from unnest(generate_series(0, {_MCOLS - 1})) gi(i), unnest(generate_series(0, (select cast(ceil(({_MY:.1f}e0 - {_R:.1f}e0 * asinh(tan(radians(36e0 - (max(row) + 1) / 32e0)))) / {_MD:.1f}e0) as bigint)
                                   from {{{{wide}}}}) - 1)) gj(j))"""


def _mercator_rows(fx) -> int:
    """Rows down to the layer's lower edge."""
    south = math.radians(36 - (fx.wide.agg(F.max("row")).first()[0] + 1) / 32)
    return math.ceil((_MY - _R * math.asinh(math.tan(south))) / _MD)


@check("reproject_webmercator", _gathered(_linear, (0, 1), _MERC))
def reproject_webmercator(fx):
    out = resample.reproject_webmercator(fx.cells, GRID, Grid(_MX, _MY, _MD, _MD), _MCOLS, _mercator_rows(fx))
    return out.select("time_index", "col", "row", "band", _scaled())


@check(
    "pyramid",
    """select time_index, cast(k as integer) as level, cast(col // (1 << k) as integer) as col, cast(row // (1 << k) as integer) as row, band,
              arg_min(value, row * 100000 + col) as value
       from {{cells}}, unnest(generate_series(1, 4)) g(k) group by 1, 2, 3, 4, 5""",
)
def pyramid(fx):
    return levels.pyramid(fx.cells, 4).select("time_index", "level", "col", "row", "band", "value")


@check(
    "pyramid_avg",
    """select time_index, cast(k as integer) as level, cast(col // (1 << k) as integer) as col, cast(row // (1 << k) as integer) as row, band,
              sum(value) / count(*) as value
       from {{cells}}, unnest(generate_series(1, 4)) g(k) group by 1, 2, 3, 4, 5""",
)
def pyramid_avg(fx):
    return levels.pyramid(fx.cells, 4, "avg").select("time_index", "level", "col", "row", "band", "value")


@check(
    "ingest_pyramid",
    f"""select cast(zoom as integer) as zoom, cast(tile_x as integer) as tile_x, cast(tile_y as integer) as tile_y, time_index, band,
               cast(i as integer) as col, cast(j as integer) as row, value from {SLIPPY}""",
)
def ingest_pyramid(fx):
    out = levels.ingest_pyramid(fx.cells, GRID, [9, 10], size=16, method="nearest")
    return out.select("zoom", "tile_x", "tile_y", "time_index", "band", "col", "row", "value")


_TILE_PX = """(select zoom, tile_x, tile_y, i, j, (px - 68e0) / 0.03125e0 - 0.5e0 as u, (36e0 - py) / 0.03125e0 - 0.5e0 as v from (
      select *, tx0 + (i + 0.5e0) * (tx1 - tx0) / 16 as px, ty1 - (j + 0.5e0) * (ty1 - ty0) / 16 as py from (
        select z as zoom, tile_x, tile_y, tile_x / pow(2, z) * 360e0 - 180e0 as tx0, (tile_x + 1) / pow(2, z) * 360e0 - 180e0 as tx1,
               degrees(atan(sinh(pi() * (1 - 2 * tile_y / pow(2, z))))) as ty1, degrees(atan(sinh(pi() * (1 - 2 * (tile_y + 1) / pow(2, z))))) as ty0
        from (values (9), (10)) zz(z),
             unnest(generate_series(cast(floor(248 / 360e0 * pow(2, z)) as bigint) - 1, cast(floor(250 / 360e0 * pow(2, z)) as bigint) + 1)) gx(tile_x),
             unnest(generate_series(cast(floor((1 - asinh(tan(radians(36e0))) / pi()) / 2 * pow(2, z)) as bigint) - 1,
                cast(floor((1 - asinh(tan(radians(36e0 - (select max(row) + 2 from {{wide}}) / 32e0))) / pi()) / 2 * pow(2, z)) as bigint) + 1)) gy(tile_y)) t,
        unnest(generate_series(0, 15)) gi(i), unnest(generate_series(0, 15)) gj(j)))"""


@check(
    "ingest_pyramid_cubic",
    f"""select zoom, tile_x, tile_y, time_index, band, col, row, {sql_micro("s / w / case when band = 3 then 1e6 else 1e0 end / 1e3", "value")} from (
        select cast(zoom as integer) as zoom, cast(tile_x as integer) as tile_x, cast(tile_y as integer) as tile_y, c.time_index, c.band,
               cast(i as integer) as col, cast(j as integer) as row,
               sum(c.value * {_cubic('u - c.col')} * {_cubic('v - c.row')}) as s, sum({_cubic('u - c.col')} * {_cubic('v - c.row')}) as w,
               sum(abs({_cubic('u - c.col')} * {_cubic('v - c.row')})) as size
        from {_TILE_PX} t, unnest(generate_series(-1, 2)) ga(a), unnest(generate_series(-1, 2)) gb(b),
             (select p.time_index, p.col, p.row, p.band, coalesce(q.value, 0e0) as value from
                (select time_index, cast(x as integer) as col, cast(y as integer) as row, cast(k as integer) as band
                 from (select distinct time_index from {{{{wide}}}}), unnest(generate_series(0, 63)) gx(x),
                      unnest(generate_series(0, (select max(row) from {{{{wide}}}}))) gy(y), unnest(generate_series(1, 5)) gk(k)) p
                left join {{{{cells}}}} q using (time_index, col, row, band)) c
        where c.col = cast(floor(u) as integer) + a and c.row = cast(floor(v) as integer) + b
          and {_cubic('u - c.col')} <> 0 and {_cubic('v - c.row')} <> 0
        group by 1, 2, 3, 4, 5, 6, 7)""",
)
def ingest_pyramid_cubic(fx):
    # without gaps, so that no weights cancel: their rounding would show, and places here are no short binary fractions
    last = fx.wide.agg(F.max("row")).scalar()
    grid = fx.wide.select("layer", "time_index").distinct().withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))))
    grid = grid.withColumn("row", F.explode(F.sequence(F.lit(0), last))).withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(5))))
    whole = fill_empty(grid, fx.cells, ["layer", "time_index", "col", "row", "band"])
    out = levels.ingest_pyramid(whole, GRID, [9, 10], size=16).withColumn("value", F.col("value") / 1e3)
    return out.select("zoom", "tile_x", "tile_y", "time_index", "band", "col", "row", _scaled())


_REQUESTS = """(select event_id as request_id, cast(8 + event_id % 5 as integer) as z,
    cast(floor((lon + 180) / 360 * pow(2, 8 + event_id % 5)) as integer) as x,
    cast(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2, 8 + event_id % 5)) as integer) as y
    from events join {{points}} on point_id = event_id)"""


def tile_requests(fx):
    """One request per point: its tile at a zoom 8..12, below, at and beyond the stored levels."""
    from terracell.functions.grid import point_to_tile

    z = (8 + F.col("point_id") % 5).cast("int")
    return fx.points.withColumn("z", z).withColumn("t", point_to_tile("lon", "lat", "z")).select(
        F.col("point_id").alias("request_id"), "z", F.col("t.tile_x").alias("x"), F.col("t.tile_y").alias("y")
    )


@check(
    "overzoom",
    f"""select request_id, time_index, count(*) as n, cast(sum(value) as bigint) as total,
               cast(sum(value * (ci * 17 + cj)) as bigint) as placed from (
          select r.request_id, s.time_index, s.value, ci, cj from (
            select r.*, greatest(z - 10, 0) as dz, z - greatest(z - 10, 0) as sz, x >> greatest(z - 10, 0) as ax, y >> greatest(z - 10, 0) as ay
            from {_REQUESTS} r) r,
            unnest(generate_series(0, 15)) gi(ci), unnest(generate_series(0, 15)) gj(cj),
            (select * from {SLIPPY} where band = 1) s
          where s.zoom = r.sz and s.tile_x = r.ax and s.tile_y = r.ay
            and s.i = (((r.x & ((1 << r.dz) - 1)) * 16 + ci) >> r.dz) and s.j = (((r.y & ((1 << r.dz) - 1)) * 16 + cj) >> r.dz))
        group by 1, 2""",
)
def overzoom(fx):
    stored = levels.ingest_pyramid(fx.cells.filter("band = 1"), GRID, [9, 10], size=16, method="nearest")
    out = resample.overzoom(tile_requests(fx), stored, max_zoom=10, size=16)
    return out.groupBy("request_id", "time_index").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").cast("bigint").alias("total"),
        F.sum(F.col("value") * (F.col("col") * 17 + F.col("row"))).cast("bigint").alias("placed"),
    )


_CELLS = "select layer, time_index, col, row, band, value from {{cells}}"


@check("retile", _CELLS)
def retile(fx):
    return layout.tiles_to_cells(layout.retile(fx.tiles, 10, 5))


@check("cells_to_tiles", """select time_index, cast(col // 16 as integer) as tile_x, cast(row // 16 as integer) as tile_y, band, count(*) as filled,
    cast(sum(value * ((row % 16) * 16 + col % 16)) as bigint) as placed from {{cells}} group by 1, 2, 3, 4""")
def cells_to_tiles(fx):
    pairs = fx.tiles.select("time_index", "tile_x", "tile_y", F.posexplode("bands").alias("b", "data")).select(
        "time_index", "tile_x", "tile_y", (F.col("b") + 1).alias("band"), F.posexplode("data").alias("p", "v")
    )
    return pairs.groupBy("time_index", "tile_x", "tile_y", "band").agg(
        F.count("v").alias("filled"), F.sum(F.col("v") * F.col("p")).cast("bigint").alias("placed")
    )


@check("stitch", _CELLS)
def stitch(fx):
    return layout.stitch(fx.tiles)


@check("scan_pixels", _CELLS)
def scan_pixels(fx):
    from terracell.sources.rasters import scan_pixels as scan

    return scan(fx.tiles)


@check("transpose_tile", "select layer, time_index, row as col, col as row, band, value from {{cells}}")
def transpose_tile(fx):
    return layout.transpose(fx.cells)


@check(
    "layer_metadata",
    """select layer, 0 as zoom, cast(min(col) // 16 as integer) as min_x, cast(min(row) // 16 as integer) as min_y,
              cast(max(col) // 16 as integer) as max_x, cast(max(row) // 16 as integer) as max_y, min(time_index) as min_t, max(time_index) as max_t,
              16 as tile_cols, 16 as tile_rows, count(distinct (col // 16, row // 16, time_index)) as tiles, 0.03125e0 as cell_w, 0.03125e0 as cell_h,
              68e0 + (min(col) // 16) * 0.5e0 as xmin, 36e0 - (max(row) // 16 + 1) * 0.5e0 as ymin,
              68e0 + (max(col) // 16 + 1) * 0.5e0 as xmax, 36e0 - (min(row) // 16) * 0.5e0 as ymax
       from {{wide}} group by 1""",
)
def layer_metadata(fx):
    return layout.layer_metadata(fx.tiles, GRID)


@check(
    "merge_metadata",
    """select 0 as zoom, cast(min(x) as integer) as min_x, cast(min(y) as integer) as min_y, min(t) as min_t,
              cast(max(x) as integer) as max_x, cast(max(y) as integer) as max_y, max(t) as max_t, count(distinct (x, y, t)) as tiles
       from (select col // 16 as x, row // 16 as y, time_index as t from {{wide}}
             union all select col // 16, row // 16 + 1000, time_index + 864000 from {{wide}})""",
)
def merge_metadata(fx):
    moved = fx.tiles.withColumns(
        {"layer": F.lit("moved"), "tile_y": F.col("tile_y") + 1000, "time_index": F.col("time_index") + 864000}
    )
    meta = layout.layer_metadata(fx.tiles).unionByName(layout.layer_metadata(moved))
    return layout.merge_metadata(meta, ["zoom"])


