"""Findings of round 3: the stream's cover is not sorted to find repeated keys, areas crop arrays, model tasks stay small."""

import math

import pytest
from pyspark.sql import functions as F

from terracell.functions.grid import z_index
from terracell.operators import algebra, cover
from terracell.sources import catalog
from terracell.streaming.ingest import refs_once


def scenes_of(spark, rows):
    return spark.createDataFrame(rows, "ingest_id long, dataset_id long, time_index long, xmin double, ymin double, xmax double, ymax double, sensor string")


def test_only_scenes_that_share_a_key_are_grouped(spark):
    rows = [
        (1, 1, 10, 90.0, 25.0, 90.3, 25.3, "S"),
        (1, 1, 10, 90.2, 25.2, 90.5, 25.5, "S"),  # the same scene with another box
        (1, 1, 10, 90.0, 25.0, 90.3, 25.3, "S"),  # and sent again
        (1, 1, 11, 90.0, 25.0, 90.3, 25.3, "S"),
        (2, None, 10, 90.0, 25.0, 90.3, 25.3, "S"),
        (2, None, 10, 90.0, 25.0, 90.3, 25.3, "S"),
    ]
    scenes = scenes_of(spark, rows)
    refs = refs_once(scenes, [8, 9, 9])
    want = cover.tile_refs_of(cover.scene_tile_cover(scenes, [8, 9])).distinct()
    assert sorted(map(str, refs.collect())) == sorted(map(str, want.collect()))
    union = refs._jdf.queryExecution().optimizedPlan()
    alone, shared = (union.children().apply(i).toString() for i in range(2))
    assert "Aggregate" not in alone and "Aggregate" in shared


def test_a_catalog_written_once_is_the_catalog(spark, tmp_path):
    scenes = scenes_of(spark, [(i, 1, 700000000 + i, 90.0 + i / 7, 25.0, 90.3 + i / 7, 25.3, "S") for i in range(6)])
    refs = cover.tile_refs_of(cover.scene_tile_cover(scenes, [7, 8]))
    for n, once in enumerate((False, True)):
        catalog.write_tile_catalog(refs, str(tmp_path / str(n)), once)
        catalog.write_tile_catalog(refs, str(tmp_path / str(n)), once)  # a replay
    a, b = (spark.read.parquet(str(tmp_path / n)) for n in "01")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == refs.count()


def test_z_index_bit_by_bit(spark):
    values = [(0, 0, 0), (1, 2, 3), (2**42 - 1, 2**21 - 1, 2**21 - 1), (913543204, 6, 11), (2**41 + 12345, 1048577, 777), (-1, 0, 0), (0, 2**21, 0), (None, 1, 1)]
    rows = spark.createDataFrame(values, "t long, y long, x long").select("t", "y", "x", z_index("t", "y", "x").alias("z")).collect()
    for r in rows:
        fits = r.t is not None and 0 <= r.t < 2**42 and r.y < 2**21
        want = sum((r[d] >> i & 1) << 3 * i + d for d in range(3) for i in range(42)) if fits else None
        assert (None if r.z is None else int(r.z)) == want


def test_areas_crop_arrays_before_cells_are_made(spark):
    """Against brute force; and no value is taken from an array before its place is known to lie inside."""
    shape = "layer string, zoom int, tile_x int, tile_y int, time_index bigint, cols int, rows int, bands array<array<double>>"
    def bands(t, cols, rows):
        return [[None if (p + t) % 5 == 0 else p + 1000.0 * b + 10000.0 * t for p in range(cols * rows)] for b in range(2)]

    stored = [("a", 10, x, y, t, c, r, bands(t, c, r)) for x in (512, 513) for y in (400, 401) for t in (0, 1) for c, r in [(4, 8)]]
    boxes = [(1, 0.05, 36.2, 0.5, 36.5), (1, 0.1, 36.0, 0.4, 36.3), (2, 0.2, 36.4, 0.2, 36.4), (3, 0.3, 35.0, 0.31, 37.0), (4, 5.0, 36.0, 6.0, 36.5), (5, -180.0, -90.0, 180.0, 90.0), (6, 0.0, 36.3, float("inf"), float("nan"))]
    aois = spark.createDataFrame(boxes, "aoi_id int, xmin double, ymin double, xmax double, ymax double")
    found = cover.aoi_data(aois, spark.createDataFrame(stored, shape), 10)
    want = {}
    edges = {y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 1024)))) for y in (400, 401, 402)}
    for layer, z, x, y, t, c, r, data in stored:
        for a, x0, y0, x1, y1 in boxes:
            for p in range(c * r):
                px = x / 1024 * 360 - 180 + (p % c + 0.5) * (360 / 1024) / c
                py = edges[y] - (p // c + 0.5) * (edges[y] - edges[y + 1]) / r
                if x0 <= px <= x1 and y0 <= py and (py <= y1 or y1 != y1):
                    for b in range(2):
                        if data[b][p] is not None:
                            want[a, layer, z, x, y, p % c, p // c, b + 1] = data[b][p]  # times come in order
    assert {tuple(r)[:8]: r["value"] for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode(bands") < plan.index("explode(CASE WHEN") and "posexplode(data" not in plan


def test_inputs_of_a_mean_meet_in_one_grouping(spark):
    cell = "layer string, time_index bigint, col int, row int, band int, value double"
    layer = spark.createDataFrame([("a", 0, c, 0, b, None if (c, b) == (2, 3) else float(b)) for b in range(1, 71) for c in range(3) if (c, b) != (1, 70)], cell)
    whole = algebra.local_avg([(layer, b) for b in range(1, 71)])
    assert sorted((r["col"], r["value"]) for r in whole.collect()) == [(0, 35.5), (2, None)]
    some = algebra.local_avg([(layer, b) for b in range(1, 71)], skip_missing=True)
    assert sorted((r["col"], r["value"]) for r in some.collect()) == [(0, 35.5), (1, 35.0), (2, 2482 / 69)]
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    wide = algebra.align([(layer, b) for b in range(1, 71)])
    assert [(r["col"], r["v69"], r["v2"]) for r in wide.orderBy("col").collect()] == [(0, 70.0, 3.0), (2, 70.0, None)]
    twice = layer.unionByName(layer.filter("band = 70 and col = 0"))
    for broken in (algebra.local_avg([(twice, 70), (layer, 1)], skip_missing=True), algebra.align([(twice, b) for b in range(1, 71)])):
        with pytest.raises(Exception, match="two values"):
            broken.collect()
