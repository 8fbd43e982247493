"""Covers by rows of tiles, boxes of any size, clipping in tile arrays; each against a plain version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.functions.geom import footprint_meets_box, polygon_edges
from terracell.functions.grid import tile_bbox
from terracell.operators import cover, layout, zonal
from terracell.operators.layout import Grid, SlippyGrid
from terracell.plans import joins
from terracell.plans.model import process_inputs

POLYGON = "ingest_id bigint, dataset_id int, xmin double, ymin double, xmax double, ymax double, rings array<array<struct<x:double,y:double>>>"


def closed(points):
    return [tuple(map(float, p)) for p in [*points, points[0]]]


def box_ring(x0, y0, x1, y1):
    return closed([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def star(rng, cx, cy, r, n):
    angles = sorted(rng.uniform(0, 2 * np.pi) for _ in range(n))
    return closed([(cx + rng.uniform(0.2, 1) * r * np.cos(a), cy + rng.uniform(0.2, 1) * r * np.sin(a)) for a in angles])


def polygons(rng):
    tile = lambda k: float(np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * k / 64)))))
    shapes = [[star(rng, rng.uniform(-170, 170), rng.uniform(-70, 70), rng.uniform(0.1, 12), rng.randint(3, 30))] for _ in range(30)]
    shapes += [
        [box_ring(0, 0, 20, 20), box_ring(3, 3, 17, 17)],
        [box_ring(0, 0, 1, 1), box_ring(9, 9, 10, 10), box_ring(9.4, 9.4, 9.6, 9.6)],
        [box_ring(5.625, 0, 11.25, 11.25)],  # borders of tiles
        [box_ring(5.625, tile(30), 11.25, tile(28))],
        [closed([(-30, 40), (30, 40), (30, 40.0000001), (-30, 40.0000001)])],  # next to no height
        [closed([(-179.9, -84), (179.9, -84), (0, 84)])],
        [closed([(1, 1), (1, 1), (1, 1)])],  # a point
    ]
    rows = []
    for i, rings in enumerate(shapes):
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        rows.append((i, i % 3, min(xs), min(ys), max(xs), max(ys), rings))
    rows.append((900, 1, 4.0, 4.0, 6.0, 6.0, None))  # no footprint: its box
    rows.append((901, 1, 4.0, 4.0, 6.0, 6.0, []))
    rows.append((902, 1, None, None, None, None, None))
    rows.append((903, 1, 0.0, 0.0, 2.0, 2.0, [box_ring(0, 0, 20, 20)]))  # a box smaller than the footprint
    return rows + [rows[3]]  # and one given twice


def test_cover_by_rows_equals_a_test_of_every_tile(spark):
    scenes = spark.createDataFrame(polygons(random.Random(5)), POLYGON)
    levels = [0, 3, 6, 7]
    got = cover.scene_tile_cover(scenes, levels)
    boxes = scenes.withColumn("_edges", polygon_edges(scenes)).drop("rings")
    every = cover.tiles_in_bbox(boxes, levels)
    tile = tile_bbox(F.col("zoom"), F.col("tile_x"), F.col("tile_y"))
    want = every.filter(footprint_meets_box("_edges", {k: F.col(k) for k in cover.BOX}, tile)).drop("_edges", *cover.BOX)
    assert got.columns == want.columns
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got) == rows(want) and got.count() > 500


def test_cover_does_not_shuffle_tiles(spark):
    scenes = spark.createDataFrame(polygons(random.Random(5)), POLYGON)
    plan = cover.scene_tile_cover(scenes, [6])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the scenes, before they become tiles


def boxes_of(rng, n):
    out = []
    for i in range(n):
        w = rng.choice([0.0, 0.01, 0.5, 0.5000001, 1.0, 3.0, 40.0, 360.0])
        x, y = rng.choice([-180.0, 0.5, rng.uniform(-180, 180)]), rng.choice([-0.5, 0.0, rng.uniform(-90, 90)])
        out.append((i, x, y, x + w, y + rng.choice([w, w / 2, 0.0])))
    return out


@pytest.mark.parametrize("options", [{}, {"max_rows": 3, "rows_per_task": 50}])
def test_boxes_of_all_sizes_meet(spark, options):
    rng = random.Random(9)
    a, b = boxes_of(rng, 150), boxes_of(rng, 120)
    big = spark.createDataFrame([*a, (-1, None, None, None, None)], "id long, xmin double, ymin double, xmax double, ymax double")
    other = spark.createDataFrame(b, "o long, b_xmin double, b_ymin double, b_xmax double, b_ymax double")
    got = sorted((r["id"], r["o"]) for r in joins.box_join(big, other, ["id"], **options).collect())
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])
    assert got == want and len(want) > 100


def test_a_global_box_costs_few_rows(spark):
    level = spark.createDataFrame([(-180.0, -90.0, 180.0, 90.0), (0.0, 0.0, 0.1, 0.1)], "xmin double, ymin double, xmax double, ymax double")
    found = level.withColumn("k", joins.box_level("", 0.5))
    width = F.lit(0.5) * F.pow(F.lit(2.0), F.col("k"))
    buckets = found.select("k", (F.size(joins.bucket_range(F.col("xmin"), F.col("xmax"), width)) * F.size(joins.bucket_range(F.col("ymin"), F.col("ymax"), width))).alias("n"))
    assert {(r["k"], r["n"]) for r in buckets.collect()} == {(10, 4), (0, 1)}


TILES = "layer string, zoom int, time_index bigint, tile_x int, tile_y int, cols int, rows int, bands array<array<double>>"


def tiles_of(spark, keys, cols, rows, zoom=None):
    rng = random.Random(1)
    value = lambda: None if rng.random() < 0.1 else rng.uniform(0, 1)
    made = [("a", zoom, t, x, y, cols, rows, [[value() for _ in range(cols * rows)], None, [value() for _ in range(cols * rows)]]) for x, y in keys for t in (0, 5)]
    return spark.createDataFrame([*made, ("a", zoom, 9, keys[0][0], keys[0][1], cols, rows, None), ("a", zoom, 9, *keys[1], cols, rows, [])], TILES)


AOI = "aoi_id int, aoi_code string, xmin double, ymin double, xmax double, ymax double, rings array<array<struct<x:double,y:double>>>"


def areas(spark, shapes):
    made = []
    for i, rings in enumerate(shapes):
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        made.append((i, f"A{i}", min(xs), min(ys), max(xs), max(ys), rings))
    return spark.createDataFrame(made, AOI)


def clipped_cells(clipped):
    found = layout.tiles_to_cells(clipped.filter(F.size("bands") > 0).withColumn("bands", F.filter("bands", lambda b: b.isNotNull())))
    return sorted(map(tuple, found.select("time_index", "col", "row", "band", "value").collect()))


def plain_clip(tiles, aois, grid):
    inside = zonal.rasterize_polygon(aois, grid).select("col", "row").distinct()
    cells = layout.tiles_to_cells(tiles.filter(F.size("bands") > 0).withColumn("bands", F.filter("bands", lambda b: b.isNotNull())))
    return sorted(map(tuple, cells.join(inside, ["col", "row"], "left_semi").select("time_index", "col", "row", "band", "value").collect()))


@pytest.mark.parametrize("cols, rows", [(16, 16), (70, 9), (128, 3)])
def test_clipping_in_tile_arrays(spark, cols, rows):
    grid = Grid(10.0, 20.0, 0.1, 0.1)
    tiles = tiles_of(spark, [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 2)], cols, rows)
    aois = areas(spark, [[box_ring(8.0, 18.0, 14.0, 21.0), box_ring(9.0, 19.0, 11.0, 19.5)], [star(random.Random(3), 16, 19.5, 3, 9)]])
    clipped = zonal.clip_tiles(tiles, aois, grid, cols, rows)
    assert clipped.schema == tiles.schema and clipped.count() == tiles.count()
    assert clipped_cells(clipped) == plain_clip(tiles, aois, grid) != []
    kinds = lambda df: sorted((r["time_index"], r["bands"] is None, len(r["bands"] or [])) for r in df.collect())
    assert kinds(clipped) == kinds(tiles)
    nothing = zonal.clip_tiles(tiles, aois.filter("aoi_id < 0"), grid, cols, rows)
    assert clipped_cells(nothing) == [] and nothing.count() == tiles.count()
    with pytest.raises(Exception, match="does not have"):
        zonal.clip_tiles(tiles, aois, grid, cols + 1, rows).collect()


def test_cells_of_slippy_tiles_lie_where_they_are_clipped(spark):
    grid = SlippyGrid(6, 8, 4)
    aois = areas(spark, [[star(random.Random(8), 20, 50, 9, 12)], [closed([(-179.99, -88), (-170, -60), (-175, -89)])]])
    got = {tuple(r) for r in zonal.rasterize_polygon(aois, grid).select("aoi_id", "col", "row").collect()}
    lat = lambda k: np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * k / 64))))
    want = set()
    for area in aois.collect():
        edges = [(p, q) for ring in area["rings"] for p, q in zip(ring, ring[1:])]
        for row in range(64 * 4):
            top, bottom = lat(row // 4), lat(row // 4 + 1)
            y = top - (row % 4 + 0.5) * (top - bottom) / 4
            at = [p.x + (y - p.y) * (q.x - p.x) / (q.y - p.y) for p, q in edges if (p.y > y) != (q.y > y)]
            want |= {(area["aoi_id"], c, row) for c in range(64 * 8) if sum((c + 0.5) * 360 / 512 - 180 < a for a in at) % 2}
    assert got == want and {a for a, _, _ in want} == {0, 1}


def test_inputs_clipped_to_their_area(spark):
    stored = tiles_of(spark, [(35, 21), (35, 22), (36, 21)], 16, 16, zoom=6).filter("time_index < 9").withColumn("dataset_id", F.lit(1))
    aois = areas(spark, [[star(random.Random(2), 22, 50, 4, 11)], [box_ring(0, 0, 80, 80)]])
    datasets = spark.createDataFrame([(1, "d")], "dataset_id int, ds_name string")
    refs = stored.selectExpr("dataset_id", "zoom as zoom_level", "time_index", "tile_x as spatial_index_x", "tile_y as spatial_index_y")
    asked = [{"id": "I", "aoiCode": "A0", "dsName": "d", "tIndexes": [5]}]
    bind = lambda **more: process_inputs(asked, aois, datasets, refs, stored, 6, as_tiles=True, **more)["I"]
    whole, clipped = bind(), bind(clip=True, size=16)
    assert clipped_cells(clipped) == plain_clip(whole, aois.filter("aoi_code = 'A0'"), SlippyGrid(6, 16, 16)) != []
    assert len(clipped_cells(clipped)) < len(clipped_cells(whole))
    with pytest.raises(ValueError, match="ring"):
        process_inputs(asked, aois.drop("rings"), datasets, refs, stored, 6, clip=True)
