"""Rendering as data."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions.colour import class_break, class_of
from terracell.operators import render


from .geometry import SLIPPY, slippy_tiles
from .raster import _REQUESTS, tile_requests
from .registry import check


def _byte(v: str, low: str = "0e0", high: str = "1e0") -> str:
    return f"cast(case when ({v}) is null then 0 else greatest(0, least(255, floor(255e0 * (({v}) - {low}) / ({high} - {low})))) end as integer)"


_A = "case when r + g + b > 0 then 255 else 0 end as a"


@check(
    "rgb_composite",
    f"""select *, {_A} from (select time_index, col, row, {_byte('b1 * 0.0078125e0 + 0.125e0')} as r,
            {_byte('b4 * 0.0078125e0 + 0.125e0')} as g, {_byte('b5 * 0.0078125e0 + 0.125e0')} as b from {{{{wide}}}})""",
)
def rgb_composite(fx):
    return render.rgb_composite(fx.cells, [1, 4, 5], 5, 0.0078125, 0.125).drop("layer")


@check(
    "rgb_composite_one_band",
    f"""select *, {_A} from (select time_index, col, row, {_byte('b1', '10e0', '90e0')} as r, {_byte('b1', '10e0', '90e0')} as g,
            {_byte('b1', '10e0', '90e0')} as b from {{{{wide}}}})""",
)
def rgb_composite_one_band(fx):
    return render.rgb_composite(fx.cells, [3, 2, 1], 1, vmin=10.0, vmax=90.0).drop("layer")


# fixed values: the test ramp's five stops, red, green, blue and alpha
_RAMP = ["#0000ff96", "#00ffffa0", "#00ff00c8", "#ffff00fa", "#ff0000ff"]
_STOPS = [tuple(bytes.fromhex(stop[1:])) for stop in _RAMP]


def _mix(k: int) -> str:
    stops = "[" + ", ".join(str(s[k]) for s in _STOPS) + "]"
    start, end = f"{stops}[ix + 1]", f"{stops}[least(ix + 2, 5)]"
    return f"case when ix between 0 and 4 then cast(floor({end} * (p - ix) + {start} * (1 - (p - ix)) + 0.5e0) as integer) else 0 end"


@check(
    "color_ramp",
    f"""select time_index, col, row, band, {_mix(0)} as r, {_mix(1)} as g, {_mix(2)} as b, {_mix(3)} as a from
        (select *, cast(floor(p) as integer) as ix from (select *, (value - 8) / 120e0 * 4 as p from {{{{cells}}}}))""",
)
def color_ramp(fx):
    return render.color_layer(fx.cells, 8.0, 128.0, _RAMP).drop("layer", "value")


# fixed values: lowest and highest break, number of classes
@check(
    "class_breaks",
    """select time_index, col, row, value, cls, -7000e0 + 15000e0 * (cls - 1) / 100 as lower from
       (select *, cast(case when value < -7000 then 0 when value >= 8000 then 101 else floor(100 * (value + 7000) / 15000) + 1 end as integer) as cls
        from (select time_index, col, row, value / 1000 - 8000 as value from {{cells}} where band = 3))""",
)
def class_breaks(fx):
    cells = fx.cells.filter("band = 3").select("time_index", "col", "row", (F.col("value") / 1000 - 8000).alias("value"))
    out = cells.withColumn("cls", class_of("value", -7000, 8000, 100))
    return out.withColumn("lower", class_break("cls", -7000, 8000, 100))


@check(
    "tile_render_query",
    f"""select request_id, count(*) filter (a > 0) as pixels, cast(sum(r) as bigint) as r, cast(sum(g) as bigint) as g, cast(sum(b) as bigint) as b, cast(sum(a) as bigint) as a from (
        select *, {_A} from (
          select request_id, {_byte("case when inside then b1 * 0.0078125e0 end")} as r, {_byte("case when inside then b4 * 0.0078125e0 end")} as g,
                 {_byte("case when inside then b5 * 0.0078125e0 end")} as b from (
            select q.*, s.b1, s.b4, s.b5, abs(qy - cy) <= h and qx - cx >= -(h - abs(qy - cy)) and qx - cx < h - abs(qy - cy) as inside from (
              select *, cast(floor((qx + 180) / 360 * pow(2, sz) ) as integer) as ttx,
                     cast(floor((1 - asinh(tan(radians(qy))) / pi()) / 2 * pow(2, sz)) as integer) as tty from (
                select *, w + (ci + 0.5e0) * (e - w) / 16 as qx, n - (cj + 0.5e0) * (n - s) / 16 as qy from (
                  select *, cast(greatest(least(z, 10), 9) as integer) as sz, x / pow(2, z) * 360e0 - 180e0 as w, (x + 1) / pow(2, z) * 360e0 - 180e0 as e,
                         degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, z))))) as n, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2, z))))) as s
                  from {_REQUESTS}) r join {{{{aois}}}} a on a.aoi_id = r.request_id
                unnest_here) p) q
            semi_here) o) t) u group by 1 having count(*) filter (a > 0) > 0""".replace(
        "unnest_here", ", unnest(generate_series(0, 15)) gi(ci), unnest(generate_series(0, 15)) gj(cj) where w <= xmax and e >= xmin and s <= ymax and n >= ymin"
    ).replace(
        "semi_here",
        """join (select zoom, tile_x, tile_y, i, j, max(value) filter (band = 1) as b1, max(value) filter (band = 4) as b4, max(value) filter (band = 5) as b5
               from tiles_px where time_index = 864000 group by 1, 2, 3, 4, 5) s
             on s.zoom = sz and s.tile_x = ttx and s.tile_y = tty
            and s.i = cast(floor((qx - (ttx / pow(2, sz) * 360e0 - 180e0)) / (360e0 / pow(2, sz)) * 16) as integer)
            and s.j = cast(floor((degrees(atan(sinh(pi() * (1 - 2 * tty / pow(2, sz))))) - qy)
                / (degrees(atan(sinh(pi() * (1 - 2 * tty / pow(2, sz))))) - degrees(atan(sinh(pi() * (1 - 2 * (tty + 1) / pow(2, sz)))))) * 16) as integer)""",
    ).replace("tiles_px", SLIPPY),
)
def tile_render_query(fx):
    asked = tile_requests(fx).withColumns({"time_index": F.lit(864000).cast("bigint"), "aoi_id": F.col("request_id")})
    out = render.tile_render_query(
        asked, slippy_tiles(fx), fx.aois, [1, 4, 5], 5, scale=0.0078125, size=16, levels=(9, 10), layer="lineitem"
    )
    return (
        out.filter("a > 0").groupBy("request_id").agg(F.count(F.lit(1)).alias("pixels"), *[F.sum(c).alias(c) for c in "rgba"])
    )
