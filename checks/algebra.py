"""Map algebra over the cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.operators import algebra, layout
from terracell.operators import tiles as T
from terracell.plans.model import process_inputs as bind_inputs
from terracell.plans.model import run_model as run

from .fixture import TILE
from .registry import ORACLES, check

_POS = "time_index, col, row"
_NDI = "case when b5 + b4 = 0 then 0e0 else (b5 - b4) / cast(b5 + b4 as double) end"


@check("ndi", f"select 'ndi' as layer, {_POS}, 1 as band, {_NDI} as value from {{{{wide}}}}")
def ndi(fx):
    return algebra.ndi((fx.cells, 5), (fx.cells, 4))


@check(
    "ndi_percent",
    f"select {_POS}, case when b5 + b4 = 0 then -99 else cast(trunc((b5 - b4) / cast(b5 + b4 as double) * 100) as integer) end as value from {{{{wide}}}}",
)
def ndi_percent(fx):
    return algebra.ndi_percent((fx.cells, 5), (fx.cells, 4))


# a second layer: the first one, a step later, cells with an even quantity only
_SHIFTED = "(select time_index + 864000 as time_index, col, row, b1, b2 from {{wide}} where b1 % 2 = 0)"


def _shifted(fx):
    even = fx.wide.filter(F.col("b1") % 2 == 0).withColumn("time_index", F.col("time_index") + 864000)
    return layout.wide_to_cells(even, ["b1", "b2"])


@check(
    "join_layers",
    f"""select a.time_index, a.col, a.row, cast(a.b1 as double) as v0, cast(b.b1 as double) as v1
        from {{{{wide}}}} a join {_SHIFTED} b using (time_index, col, row)""",
)
def join_layers(fx):
    return algebra.join_layers((fx.cells, 1), (_shifted(fx), 1))


@check(
    "join_layers_n",
    f"""select a.time_index, a.col, a.row, cast(a.b1 as double) as v0, cast(b.b1 as double) as v1, cast(a.b3 as double) as v2
        from {{{{wide}}}} a join {_SHIFTED} b using (time_index, col, row)""",
)
def join_layers_n(fx):
    return algebra.align([(fx.cells, 1), (_shifted(fx), 1), (fx.cells, 3)])


@check(
    "local_avg",
    f"""select 'avg' as layer, a.time_index, a.col, a.row, 1 as band, (a.b1 + a.b2 + b.b1) / 3e0 as value
        from {{{{wide}}}} a join {_SHIFTED} b using (time_index, col, row)""",
)
def local_avg(fx):
    return algebra.local_avg([(fx.cells, 1), (fx.cells, 2), (_shifted(fx), 1)])


@check(
    "local_avg_skip_missing",
    f"""select 'avg' as layer, time_index, col, row, 1 as band, sum(v) / cast(count(*) as double) as value
        from (select time_index, col, row, b1 as v from {{{{wide}}}} union all select time_index, col, row, b1 from {_SHIFTED})
        group by 2, 3, 4""",
)
def local_avg_skip_missing(fx):
    return algebra.local_avg([(fx.cells, 1), (_shifted(fx), 1)], skip_missing=True)


@check(
    "mosaic",
    f"""select 'merged' as layer, time_index, col, row, 1 as band, coalesce(cast(b.b1 as double), cast(a.b1 as double)) as value
        from (select * from {{{{wide}}}}) a full join {_SHIFTED} b using (time_index, col, row)""",
)
def mosaic(fx):
    return algebra.merge_layers([layout.select_bands(_shifted(fx), [1]), layout.select_bands(fx.cells, [1])])


@check(
    "mosaic_last_wins",
    f"""select 'merged' as layer, time_index, col, row, 1 as band, coalesce(cast(a.b1 as double), cast(b.b1 as double)) as value
        from (select * from {{{{wide}}}}) a full join {_SHIFTED} b using (time_index, col, row)""",
)
def mosaic_last_wins(fx):
    return algebra.merge_layers([layout.select_bands(_shifted(fx), [1]), layout.select_bands(fx.cells, [1])], first_wins=False)


@check(
    "empty_tile_fill",
    """select p.col, p.row, t.time_index, cast(k.band as integer) as band, coalesce(c.value, 0e0) as value
       from (select distinct col, row from {{wide}}) p, (select distinct time_index from {{wide}}) t, unnest(generate_series(1, 5)) k(band)
       left join {{cells}} c on c.col = p.col and c.row = p.row and c.time_index = t.time_index and c.band = k.band""",
)
def empty_tile_fill(fx):
    times = F.array_sort(F.collect_set("time_index"))
    axis = fx.wide.agg(times).scalar()
    wanted = fx.wide.select("col", "row").distinct().select("col", "row", F.explode(axis).alias("time_index"))
    wanted = wanted.withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return algebra.fill_empty(wanted, fx.cells, ["col", "row", "time_index", "band"])


@check("raster_calc", f"select 'calc' as layer, {_POS}, 1 as band, (b1 - 2e0 * b2) / (1e0 + b5) as value from {{{{wide}}}}")
def raster_calc(fx):
    return algebra.raster_calc(fx.cells, "(b1 - 2 * b2) / (1 + b5)", [1, 2, 5])


_FOCAL_SQL = """select a.layer, a.time_index, a.col, a.row, a.band,
              cast(sum(b.value * (2 - abs(b.col - a.col)) * (2 - abs(b.row - a.row))) as double) as value
       from {{cells}} a join {{cells}} b
         on a.time_index = b.time_index and a.band = b.band and abs(b.col - a.col) <= 1 and abs(b.row - a.row) <= 1
       group by 1, 2, 3, 4, 5"""
_TENT = [(dx, dy, (2 - abs(dx)) * (2 - abs(dy))) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


@check("focal_conv", _FOCAL_SQL)
def focal_conv(fx):
    return algebra.focal(fx.cells, _TENT)


@check("focal_conv_tiles", _FOCAL_SQL)
def focal_conv_tiles(fx):
    return algebra.focal_tiles(fx.tiles, _TENT)


@check("band_min_max", "select layer, band, min(value) as min_value, max(value) as max_value, count(value) as n from {{cells}} group by 1, 2")
def band_min_max(fx):
    return algebra.band_min_max(fx.cells)


@check("union_layers", f"select layer, {_POS}, band, value from {{{{cells}}}} union all select layer, {_POS}, band, value * 2 from {{{{cells}}}}")
def union_layers(fx):
    return layout.union_layers(fx.cells, fx.cells.withColumn("value", F.col("value") * 2))


_MODEL_SQL = f"""({_NDI} + case when b1 + b2 = 0 then 0e0 else (b1 - b2) / cast(b1 + b2 as double) end) / 2 as value from {{{{wide}}}}"""
_MODEL = {
    "operations": [
        {"id": "O1", "type": "op_ndi", "inputs": [{"id": "I1", "band": 5}, {"id": "I1", "band": 4}], "output": {"id": "O1"}},
        {"id": "O2", "type": "op_normalized_difference", "inputs": [{"layer": "I1", "band": 1}, {"layer": "I1", "band": 2}], "output": {"id": "O2"}},
        {"id": "O3", "type": "op_local_avg", "inputs": [{"id": "O1", "band": 1}, {"id": "O2", "band": 1}], "output": {"id": "O3"}},
    ],
    "output": {"id": "O3"},
}


@check("run_model", f"select 'avg' as layer, {_POS}, 1 as band, {_MODEL_SQL}")
def run_model(fx):
    return run(_MODEL, {"I1": fx.cells})


@check("run_model_on_tiles", f"select 'avg' as layer, {_POS}, 1 as band, {_MODEL_SQL}")
def run_model_on_tiles(fx):
    return layout.tiles_to_cells(run(_MODEL, {"I1": fx.tiles}))


@check(
    "process_inputs",
    """select c.time_index, c.col, c.row, c.band, c.value from {{cells}} c
       semi join (select distinct tx, ty from (
           select x as tx, y as ty, x / 1024e0 * 360e0 - 180e0 as tx0, (x + 1) / 1024e0 * 360e0 - 180e0 as tx1,
                  degrees(atan(sinh(pi() * (1 - 2 * y / 1024e0)))) as ty1,
                  degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 1024e0)))) as ty0, a.*
           from (select * from {{aois}} where aoi_id = 100) a, unnest(generate_series(700, 720)) gx(x), unnest(generate_series(390, 420)) gy(y))
           where tx0 <= xmax and tx1 >= xmin and ty0 <= ymax and ty1 >= ymin) k
         on c.col // 16 = tx - 705 and c.row // 16 = ty - 402
       where c.time_index in (0, 864000)""",
)
def process_inputs(fx):
    return _bound_inputs(fx, lambda tiles, name: tiles.withColumn("dataset_id", F.lit(7).cast("bigint")))


@check(
    "process_inputs_clipped",
    """select time_index, col, row, band, value from (
         select c.*, tx0 + (col % 16 + 0.5e0) * (tx1 - tx0) / 16 as px, ty1 - (row % 16 + 0.5e0) * (ty1 - ty0) / 16 as py, cx, cy, h
         from (select *, (col // 16 + 705) / 1024e0 * 360e0 - 180e0 as tx0, (col // 16 + 706) / 1024e0 * 360e0 - 180e0 as tx1,
                      degrees(atan(sinh(pi() * (1 - 2 * (row // 16 + 402) / 1024e0)))) as ty1,
                      degrees(atan(sinh(pi() * (1 - 2 * (row // 16 + 403) / 1024e0)))) as ty0
               from {{cells}} where time_index in (0, 864000)) c, (select cx, cy, h from {{aois}} where aoi_id = 100) a)
       where value is not null and abs(py - cy) <= h and px - cx >= -(h - abs(py - cy)) and px - cx < h - abs(py - cy)""",
)
def process_inputs_clipped(fx):
    """As process_inputs, with the cells outside the area's own polygon left out."""
    return _bound_inputs(fx, lambda tiles, name: tiles.withColumn("dataset_id", F.lit(7).cast("bigint")), clip=True, size=TILE)


def _bound_inputs(fx, stored, **options):
    # stored tiles carry slippy keys: the layer's first tile is taken as (705, 402) at zoom 10
    tiles = fx.tiles.withColumn("zoom", F.lit(10)).withColumn("tile_x", F.col("tile_x") + 705).withColumn("tile_y", F.col("tile_y") + 402)
    refs = tiles.select(
        F.lit(7).cast("bigint").alias("dataset_id"), F.col("zoom").alias("zoom_level"), "time_index",
        F.col("tile_x").alias("spatial_index_x"), F.col("tile_y").alias("spatial_index_y"),
    )
    names = {r["dataset_id"]: r["ds_name"] for r in fx.datasets.filter("dataset_id = 7").collect()}
    code = fx.aois.filter("aoi_id = 100").first()["aoi_code"]
    spec = [{"id": "I1", "aoiCode": code, "dsName": names[7], "tIndexes": [0, 864000]}]
    cells = bind_inputs(spec, fx.aois, fx.datasets, refs, stored(tiles, names[7]), level=10, **options)["I1"]
    return cells.select(
        "time_index", (F.col("col") - 705 * TILE).alias("col"), (F.col("row") - 402 * TILE).alias("row"), "band", "value"
    )


@check("process_inputs_by_layer", ORACLES["process_inputs"])
def process_inputs_by_layer(fx):
    """Tiles without a dataset column are found by the dataset's name; another layer in the table stays out."""

    def stored(tiles, name):
        return tiles.withColumn("layer", F.lit(name)).unionByName(tiles.withColumn("layer", F.lit("other")))

    return _bound_inputs(fx, stored)


@check("tile_ndi", f"select {_POS}, {_NDI} as value from {{{{wide}}}}")
def tile_ndi(fx):
    tiles = fx.tiles
    return layout.tiles_to_cells(T.tile_ndi((tiles, 5), (tiles, 4))).select("time_index", "col", "row", "value")


@check(
    "tile_local_avg",
    f"""select a.time_index, a.col, a.row, (a.b1 + a.b2 + b.b1) / 3e0 as value
        from {{{{wide}}}} a join {_SHIFTED} b using (time_index, col, row)""",
)
def tile_local_avg(fx):
    tiles = fx.tiles
    shifted = layout.cells_to_tiles(_shifted(fx), TILE, 2)
    out = T.tile_local_avg([(tiles, 1), (tiles, 2), (shifted, 1)])
    return layout.tiles_to_cells(out).select("time_index", "col", "row", "value")


@check("tile_min_max", "select layer, band, min(value) as min_value, max(value) as max_value from {{cells}} group by 1, 2")
def tile_min_max(fx):
    return T.tile_min_max(fx.tiles)


@check("tile_scale_offset", f"select {_POS}, band, value * 0.5e0 + 3 as value from {{{{cells}}}} where band in (2, 5)")
def tile_scale_offset(fx):
    out = layout.tiles_to_cells(T.tile_scale_offset(T.tile_select_bands(fx.tiles, [2, 5]), 0.5, 3.0))
    band = F.when(F.col("band") == 1, 2).otherwise(5)
    return out.select("time_index", "col", "row", band.alias("band"), "value")
