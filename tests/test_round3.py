"""Layers kept apart, polygons with holes, ranges of the Z key, running sums, border exchange."""

import itertools
import random

import numpy as np
import pytest

from terracell.functions.zcurve import z_ranges, z_value
from terracell.operators import algebra, cover, fpca, halo, layout, render, resample, tiles, zonal
from terracell.operators.layout import Grid
from terracell.sources import layers

CELL = "layer string, time_index bigint, col int, row int, band int, value double"


def cells_of(spark, rows, layer="a"):
    return spark.createDataFrame([r if isinstance(r[0], str) else (layer, *r) for r in rows], CELL)


def fails(df, words):
    with pytest.raises(Exception, match=words):
        df.collect()


def two_layers(spark):
    return cells_of(spark, [("x", 0, 0, 0, 1, 1.0), ("y", 0, 0, 0, 1, 10.0), ("x", 0, 1, 0, 1, 2.0), ("y", 0, 1, 0, 1, 20.0)])


def test_local_avg_counts_inputs(spark):
    a, b = cells_of(spark, [(0, 0, 0, 1, 4.0), (0, 0, 0, 1, 6.0)]), cells_of(spark, [(0, 5, 5, 1, 1.0)], "b")
    fails(algebra.local_avg([(a, 1), (b, 1)]), "two values")
    fails(algebra.local_avg([(a, 1), (b, 1)], skip_missing=True), "two values")
    one = cells_of(spark, [(0, 0, 0, 1, 4.0), (0, 1, 0, 1, None), (0, 2, 0, 1, 7.0)])
    other = cells_of(spark, [(0, 0, 0, 1, 6.0), (0, 1, 0, 1, 3.0)], "b")
    whole = {r["col"]: r["value"] for r in algebra.local_avg([(one, 1), (other, 1)]).collect()}
    some = {r["col"]: r["value"] for r in algebra.local_avg([(one, 1), (other, 1)], skip_missing=True).collect()}
    assert whole == {0: 5.0, 1: None} and some == {0: 5.0, 1: 3.0, 2: 7.0}
    twice = {r["col"]: r["value"] for r in algebra.local_avg([(one, 1), (one, 1)]).collect()}
    assert twice == {0: 4.0, 1: None, 2: 7.0}


def test_layers_are_not_mixed(spark):
    both = two_layers(spark)
    fails(algebra.raster_calc(both, "b1 * 2", [1]), "two values")
    found = {(r["layer"], r["col"]): r["value"] for r in algebra.focal(both, [(0, 0, 1.0), (1, 0, 1.0)]).collect()}
    assert found == {("x", 0): 3.0, ("x", 1): 2.0, ("y", 0): 30.0, ("y", 1): 20.0}
    stored = layout.cells_to_tiles(both, 2, 1)
    fails(tiles.tile_ndi((stored, 1), (stored, 1)), "several layers")
    fails(tiles.tile_local_avg([(stored, 1), (stored, 1)]), "several layers")
    assert tiles.tile_ndi(*[(stored.filter("layer = 'x'"), 1)] * 2).count() == 1


def test_render_of_several_layers(spark):
    rows = [(name, 10, 512, 512, 0, 2, 2, [[0.5] * 4]) for name in "xy"]
    stored = spark.createDataFrame(rows, "layer string, zoom int, tile_x int, tile_y int, time_index bigint, cols int, rows int, bands array<array<double>>")
    ring = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0)]
    hole = [(0.1, -0.3), (0.3, -0.3), (0.3, -0.1), (0.1, -0.1), (0.1, -0.3)]
    types = "aoi_id int, xmin double, ymin double, xmax double, ymax double, rings array<array<struct<x:double,y:double>>>"
    requests = spark.createDataFrame([(1, 10, 512, 512, 0, 7)], "request_id int, z int, x int, y int, time_index bigint, aoi_id int")
    aoi = spark.createDataFrame([(7, -1.0, -1.0, 1.0, 1.0, [ring, hole])], types)
    show = lambda t, **k: render.tile_render_query(requests, t, aoi, no_of_bands=1, size=4, levels=(4, 12), **k)
    fails(show(stored), "several layers")
    pixels = {(r["col"], r["row"]): r["a"] for r in show(stored, layer="x").collect()}
    assert len(pixels) == 16 and set(pixels.values()) == {0, 255}
    # the tile spans 0.3516 degrees down to the south east of (0, 0): the hole takes the pixels with centres in 0.1..0.3
    assert {p for p, a in pixels.items() if a == 0} == {(c, r) for c in (2,) for r in (2,)} | {(1, 1), (1, 2), (2, 1)}


def test_covers_leave_holes_out(spark):
    def ring(x0, y0, x1, y1):
        return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]

    types = "ingest_id bigint, xmin double, ymin double, xmax double, ymax double, rings array<array<struct<x:double,y:double>>>"
    parts = [
        (1, 0.0, 0.0, 10.0, 10.0, [ring(0.0, 0.0, 10.0, 10.0)]),
        (2, 0.0, 0.0, 10.0, 10.0, [ring(0.0, 0.0, 10.0, 10.0), ring(1.0, 1.0, 9.0, 9.0)]),
        (3, 0.0, 0.0, 10.0, 10.0, [ring(0.0, 0.0, 1.0, 1.0), ring(9.0, 9.0, 10.0, 10.0)]),
    ]
    found = cover.scene_tile_cover(spark.createDataFrame(parts, types), [8]).collect()
    by_id = {k: {(r["tile_x"], r["tile_y"]) for r in found if r["ingest_id"] == k} for k in (1, 2, 3)}
    inside = {t for t in by_id[1] - by_id[2]}
    n = 2**8

    def box(x, y):
        lat = lambda k: np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * k / n))))
        return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)

    wanted = {t for t in by_id[1] if box(*t)[0] > 1 and box(*t)[1] > 1 and box(*t)[2] < 9 and box(*t)[3] < 9}
    assert inside == wanted and wanted
    assert by_id[3] < by_id[1] and len(by_id[3]) < len(by_id[1]) / 2
    scenes = spark.createDataFrame([(*p, 0, 5) for p in parts], types + ", dataset_id int, time_index bigint")
    aois = spark.createDataFrame([(1, 4.0, 4.0, 5.0, 5.0), (2, 0.2, 0.2, 0.3, 0.3)], "aoi_id int, xmin double, ymin double, xmax double, ymax double")
    hits = {(r["aoi_id"], r["ingest_id"]) for r in cover.aoi_scenes(aois, scenes).collect()}
    assert hits == {(1, 1), (2, 1), (2, 2), (2, 3)}


def test_fpca_steps_in_any_order(spark):
    rng = random.Random(1)
    cells = cells_of(spark, [(t, c, 0, 1, rng.random()) for t in (10, 20, 30, 40) for c in range(6)])
    gram = lambda steps: {(r["i"], r["j"]): round(r["g"], 12) for r in fpca.fpca_gram(cells, steps=steps).collect()}
    assert gram([20, 10, 30]) == gram([30, 10, 20]) == gram([10, 20, 30])
    years = cells_of(spark, [(t, c, 0, b, rng.random()) for t in range(3) for c in range(4) for b in (1, 2, 3)])
    one = lambda steps: sorted((r["col"], r["step"], round(r["component"], 12)) for r in fpca.fpca_per_pixel(years, steps).collect())
    assert one([3, 1]) == one([1, 3])


def test_one_tile_of_equal_keys_stays(spark, tmp_path):
    rows = [("a", 0, 0, 0, 0, 1, 1, [[float(v)]]) for v in (3, 9, 4)]
    types = "layer string, zoom int, tile_x int, tile_y int, time_index bigint, cols int, rows int, bands array<array<double>>"
    for k, order in enumerate(itertools.permutations(rows)):
        layers.upsert_layer(spark.createDataFrame(order, types).repartition(2), str(tmp_path / str(k)))
        assert [r["bands"] for r in layers.read_layer(spark, str(tmp_path / str(k))).collect()] == [[[9.0]]]


def test_z_ranges_hold_the_box_and_little_else():
    rng = random.Random(2)
    for _ in range(60):
        t, y, x = (tuple(sorted(rng.randrange(20) for _ in range(2))) for _ in range(3))
        wanted = {z_value(*p) for p in itertools.product(*(range(a, b + 1) for a, b in (t, y, x)))}
        exact = z_ranges(t, y, x, 100_000)
        assert {k for a, b in exact for k in range(a, b + 1)} == wanted
        for budget in (1, 4, 16):
            few = z_ranges(t, y, x, budget)
            assert len(few) <= budget and all(any(a <= k <= b for a, b in few) for k in wanted)
            assert all(a <= b for a, b in few) and all(b1 < a2 for (_, b1), (a2, _) in zip(few, few[1:]))
            assert few[0][0] == min(wanted) and few[-1][1] == max(wanted)
    assert z_ranges((-5, -1), (0, 3), (0, 3)) == []
    assert z_ranges((0, 1), (0, 1), (0, 1)) == [(0, 7)] and z_value(2, 0, 0) == 8 and z_value(1 << 30, 0, 0) == 1 << 90


def test_layer_query_reads_the_row_groups_of_the_curve(spark, tmp_path):
    """A thin wide box: tile_x and tile_y alone keep most of the row groups, ranges of the key do not."""
    side = 64
    rows = [("a", 9, x, y, 0, 1, 1, [[float(x * 1000 + y)]]) for x in range(side) for y in range(side)]
    types = "layer string, zoom int, tile_x int, tile_y int, time_index bigint, cols int, rows int, bands array<array<double>>"
    tiles_df = spark.createDataFrame(rows, types).coalesce(1)
    path = str(tmp_path / "layer")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size.row.check.min", "64")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size.row.check.max", "64")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "1024")
    try:
        layers.write_layer(tiles_df, path)
    finally:
        for key in ("parquet.block.size", "parquet.block.size.row.check.min", "parquet.block.size.row.check.max"):
            spark.sparkContext._jsc.hadoopConfiguration().unset(key)
    stored = layers.read_layer(spark, path)

    def read(found):
        """Rows returned, and rows that the scan gave out."""
        n = found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getSimpleName() else plan
        leaves = plan.collectLeaves()
        return n, sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))

    totals = 0, 0
    for keys in ((3, 5, 60, 5), (31, 31, 32, 32), (7, 0, 7, 63), (-3, 10, 2, 12)):
        with_ranges, scanned = read(layers.layer_query(stored, "a", 9, keys))
        plain, scanned_plain = read(layers.layer_query(stored.drop("z_index"), "a", 9, keys))
        key = lambda r: (r["tile_x"], r["tile_y"])
        assert sorted(map(key, with_ranges)) == sorted(map(key, plain)) and with_ranges
        assert scanned <= scanned_plain
        totals = totals[0] + scanned, totals[1] + scanned_plain
    assert totals[0] < totals[1]
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # the plan's text is cut at 100 characters otherwise
    try:
        plan = layers.layer_query(stored, "a", 9, (3, 5, 60, 5))._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "z_index" in plan[plan.rindex("PushedFilters"):]


def test_layer_query_in_time(spark, tmp_path):
    day = 86400
    rows = [("a", 9, x, y, t * 10 * day, 1, 1, [[0.0]]) for x in range(8) for y in range(8) for t in (-2, 0, 1, 2, 5)]
    types = "layer string, zoom int, tile_x int, tile_y int, time_index bigint, cols int, rows int, bands array<array<double>>"
    made = spark.createDataFrame(rows, types)
    layers.write_layer_temporal(made, str(tmp_path / "t"))
    layers.upsert_layer(made, str(tmp_path / "u"))
    for path, z_time in (("t", "stored"), ("u", "time_index"), ("u", "stored")):
        stored = layers.read_layer(spark, str(tmp_path / path))
        for start, end in ((0, 10 * day), (None, 20 * day), (-30 * day, 0), (15 * day, None), (None, None)):
            got = layers.layer_query(stored, "a", 9, (1, 2, 5, 3), start, end, z_time=z_time).count()
            times = [t for t in (-2, 0, 1, 2, 5) if (start is None or t * 10 * day >= start) and (end is None or t * 10 * day <= end)]
            assert got == 10 * len(times)


def polygons(spark, rings):
    return spark.createDataFrame([(k, r) for k, r in enumerate(rings)], "aoi_id int, rings array<array<struct<x:double,y:double>>>")


def test_running_sums_equal_sums_over_cells(spark):
    rng = random.Random(4)
    grid = Grid(0.0, 0.0, 1.0, 1.0)
    cells = [(t, c, r, b, None if rng.random() < 0.1 else float(rng.randrange(6))) for t in (0, 1) for b in (1, 2) for c in range(-40, 90) for r in range(-5, 12) if rng.random() < 0.7]
    layer = cells_of(spark, cells)
    rings = []
    for _ in range(12):
        x, y, w, h = rng.uniform(-50, 80), rng.uniform(-12, 6), rng.uniform(1, 90), rng.uniform(1, 12)
        ring = [(x, y), (x + w, y), (x + w / 2, y + h), (x, y)]
        hole = [(x + w * 0.4, y + h * 0.1), (x + w * 0.6, y + h * 0.1), (x + w / 2, y + h * 0.5), (x + w * 0.4, y + h * 0.1)]
        rings.append([ring, hole])
    aois = polygons(spark, rings)
    inside = zonal.zonal_cells(layer, aois, grid).collect()
    for by in ([], ["band"], ["time_index", "band"]):
        wanted = {}
        for r in inside:
            n, total = wanted.get((r["aoi_id"], *(r[k] for k in by)), (0, 0.0))
            wanted[(r["aoi_id"], *(r[k] for k in by))] = (n + (r["value"] is not None), total + (r["value"] or 0))
        found = {(r["aoi_id"], *(r[k] for k in by)): (r["n"], r["total"] or 0.0) for r in zonal.zonal_mean(layer, aois, grid, by).collect()}
        assert found == wanted and len(found) > 5
    counts = {}
    for r in inside:
        if r["value"] is not None:
            counts[r["aoi_id"], int(r["value"])] = counts.get((r["aoi_id"], int(r["value"])), 0) + 1
    assert {(r["aoi_id"], r["value"]): r["n"] for r in zonal.zonal_histogram(layer, aois, grid).collect()} == counts
    stored = layout.cells_to_tiles(layer, 16, 2)
    of_tiles = {(r["aoi_id"], r["band"]): (r["n"], r["total"]) for r in zonal.zonal_mean_tiles(stored, aois, grid, 16, ["band"]).collect() if r["n"]}
    of_cells = {(r["aoi_id"], r["band"]): (r["n"], r["total"]) for r in zonal.zonal_mean(layer, aois, grid, ["band"]).collect() if r["n"]}
    assert of_tiles == of_cells
    fails(zonal.zonal_histogram(layer.unionByName(layer), aois, grid), "twice")


def brute_resample(cells, u, v, weight, reach):
    have = {(c, r): x for _, c, r, _, x in cells if x is not None}
    out = {}
    for i, ui in enumerate(u):
        for j, vj in enumerate(v):
            taps = [(weight(ui - c) * weight(vj - r), have[c, r]) for c in range(int(np.floor(ui)) - reach + 1, int(np.floor(ui)) + reach + 1) for r in range(int(np.floor(vj)) - reach + 1, int(np.floor(vj)) + reach + 1) if (c, r) in have]
            taps = [(w, x) for w, x in taps if w]
            total, size = sum(w for w, _ in taps), sum(abs(w) for w, _ in taps)
            if abs(total) > size * 1e-9:
                out[i, j] = sum(w * x for w, x in taps) / total
    return out


@pytest.mark.parametrize("method, reach", [("bilinear", 1), ("cubic", 2)])
@pytest.mark.parametrize("block", [2, 3, 128])
def test_borders_of_blocks_do_not_show(spark, monkeypatch, method, reach, block):
    rng = random.Random(block)
    cells = [(0, c, r, 1, rng.uniform(1, 9)) for c in range(-3, 9) for r in range(-2, 7) if rng.random() < 0.85]
    src, dst = Grid(0.0, 0.0, 1.0, 1.0), Grid(-3.3, 2.2, 0.7, 0.6)
    weight = lambda d: float(halo.kernel_weights(np.array([d]), method)[0])
    u = [(-3.3 + (i + 0.5) * 0.7) - 0.5 for i in range(18)]
    v = [-(2.2 - (j + 0.5) * 0.6) - 0.5 for j in range(15)]
    wanted = brute_resample(cells, u, v, weight, reach)
    layer = cells_of(spark, cells)
    blocks = halo.blocks_of_cells(layer, block)
    found = resample._interpolated(blocks, src, dst, 18, 15, method, False).collect()
    tiled = resample.resample_tiles(layout.cells_to_tiles(layer, block, 1), src, dst, 18, 15, method).collect()
    for got in (found, tiled):
        got = {(r["col"], r["row"]): r["value"] for r in got}
        assert got.keys() == wanted.keys()
        assert all(abs(got[k] - wanted[k]) <= 1e-6 * max(1, abs(wanted[k])) for k in wanted)


def test_windows_across_blocks(spark):
    rng = random.Random(9)
    cells = [(0, c, r, 1, rng.uniform(1, 9)) for c in range(-4, 8) for r in range(-3, 6) if rng.random() < 0.8]
    kernel = [(dx, dy, rng.choice([0.0, 1.0, 2.5, -1.0])) for dx in range(-2, 3) for dy in range(-1, 3)]
    have = {(c, r): x for _, c, r, _, x in cells}
    sums = {p: sum(w * have.get((p[0] + dx, p[1] + dy), 0.0) for dx, dy, w in kernel) for p in have}
    weights = {p: sum(w for dx, dy, w in kernel if (p[0] + dx, p[1] + dy) in have) for p in have}
    for size in (2, 3, 128):
        plain = {(r["col"], r["row"]): r["value"] for r in algebra.focal(cells_of(spark, cells), kernel, block=size).collect()}
        assert plain.keys() == sums.keys() and all(abs(plain[p] - sums[p]) < 1e-9 for p in sums)
        norm = {(r["col"], r["row"]): r["value"] for r in algebra.focal(cells_of(spark, cells), kernel, normalise=True, block=size).collect()}
        assert all(norm[p] is None if not weights[p] else abs(norm[p] - sums[p] / weights[p]) < 1e-6 for p in sums)
    tiled = layout.cells_to_tiles(cells_of(spark, cells), 3, 1)
    found = {(r["col"], r["row"]): r["value"] for r in algebra.focal_tiles(tiled, kernel).collect()}
    assert found.keys() == sums.keys() and all(abs(found[p] - sums[p]) < 1e-9 for p in sums)


def test_a_broadcast_is_decided_by_a_count_first(spark):
    from terracell.plans.joins import measured, small_enough

    size = measured(spark.range(10), ["id"])
    assert (size["rows"], size["low_id"], size["high_id"]) == (10, 0, 9)
    assert small_enough(size, 10) and not small_enough(size, 9)
    assert small_enough(measured(spark.range(0), ["id"]), 1)
