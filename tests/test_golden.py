"""Catalog facts, literal cases, numpy cross-checks, properties."""

import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terracell.functions import bands, colour, geom, grid, kernels, timeindex
from terracell.operators import algebra, cover, fpca, layout, resample, series, zonal
from terracell.operators.layout import Grid
from terracell.plans.model import run_model
from terracell.schema import CELLS
from terracell.sources.catalog import parse_band_meta


def cells_of(spark, rows):
    return spark.createDataFrame([("l", *r) for r in rows], CELLS)


def series_of(spark, values, band=1):
    return cells_of(spark, [(t, 0, 0, band, None if v is None else float(v)) for t, v in enumerate(values)])


def values_by_time(df):
    return [r["value"] for r in df.orderBy("time_index").collect()]


def test_z_keys_of_the_catalog(spark):
    rows = [
        (913543204, 11, 6, "174425412577111579794901236"),
        (913543204, 12, 6, "174425412577111579794901456"),
        (1050755451, 3074, 1744, "176843779569970783638565417"),
    ]
    df = spark.createDataFrame(rows, "t bigint, x int, y int, key string")
    got = df.select(grid.z_index("t", "y", "x").cast("string").alias("z"), "key").collect()
    assert all(r["z"] == r["key"] for r in got)


def test_z_key_out_of_range_is_null(spark):
    df = spark.createDataFrame([(1 << 42, 1, 1), (-1, 1, 1)], "t bigint, x int, y int")
    assert [r[0] for r in df.select(grid.z_index("t", "y", "x")).collect()] == [None, None]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**42 - 1), st.integers(0, 2**21 - 1), st.integers(0, 2**21 - 1)), min_size=20, max_size=50))
def test_z_key_interleaves_and_parts_sort_alike(rows):
    from terracell.session import local_session

    spark = local_session(4, 4, "8g")
    df = spark.createDataFrame(rows, "t bigint, y int, x int")
    high, low = grid.z_parts("t", "y", "x")
    got = df.select("t", "y", "x", grid.z_index("t", "y", "x").alias("z"), high.alias("h"), low.alias("l")).collect()
    for r in got:
        key, want = int(r["z"]), 0
        for d, v in enumerate((r["t"], r["y"], r["x"])):
            for i in range(v.bit_length()):
                want |= ((v >> i) & 1) << (3 * i + d)
        assert key == want
        assert key == (r["h"] << 63) + r["l"]


def test_tile_boxes(spark):
    df = spark.createDataFrame([(12, 3074, 1744), (4, 11, 6)], "z int, x int, y int")
    boxes = [r[0] for r in df.select(grid.tile_bbox("z", F.col("x"), F.col("y"))).collect()]
    assert boxes[0]["xmin"] == 90.17578125 and boxes[0]["xmax"] == 90.263671875
    assert boxes[0]["ymax"] == pytest.approx(25.79989118208832, abs=1e-12)
    assert boxes[0]["ymin"] == pytest.approx(25.720735134412102, abs=1e-12)
    assert boxes[1]["ymax"] == pytest.approx(40.97989806962013, abs=1e-12)


def test_time_index_round_trip(spark):
    df = spark.createDataFrame([(913543204,), (0,), (1050755451,)], "t bigint")
    back = df.select("t", timeindex.ts_to_time_index(timeindex.time_index_to_ts("t")).alias("b")).collect()
    assert all(r["t"] == r["b"] for r in back)
    ms = spark.range(1).select(timeindex.millis_to_time_index(F.lit(1544675404387))).first()[0]
    assert ms == 1544675404 - timeindex.EPOCH_1990


def test_cover_of_a_stored_scene(spark):
    """The axis-aligned catalog scene: tiles per level 4..12."""
    df = spark.createDataFrame([(4, 2, 914925604, 88.42435, 24.92360, 90.72790, 27.04471)], "ingest_id long, dataset_id long, time_index long, xmin double, ymin double, xmax double, ymax double")
    got = dict(cover.scene_tile_cover(df).groupBy("zoom").count().collect())
    assert got == {4: 2, 5: 2, 6: 2, 7: 2, 8: 6, 9: 20, 10: 56, 11: 196, 12: 756}


def test_aoi_tiles_of_the_catalog(spark):
    df = spark.createDataFrame([(1, 90.11154, 25.66313, 90.21675, 25.73609)], "aoi_id int, xmin double, ymin double, xmax double, ymax double")
    keys = {(r["tile_x"], r["tile_y"]) for r in cover.tiles_in_bbox(df, [12]).collect()}
    assert keys == {(x, y) for x in (3073, 3074) for y in (1744, 1745)}


def test_touching_tiles_count(spark):
    edge = 180.0 / 4096 * 2 * 3074 - 180.0  # a level-12 tile edge
    df = spark.createDataFrame([(1, edge, 25.73, edge + 0.01, 25.74)], "aoi_id int, xmin double, ymin double, xmax double, ymax double")
    assert {r["tile_x"] for r in cover.tiles_in_bbox(df, [12]).collect()} == {3073, 3074}


def test_ndi_cases(spark):
    df = spark.createDataFrame([(3.0, 1.0), (0.0, 0.0), (2.0, -2.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(bands.normalized_difference("a", "b")).collect()] == [0.5, 0.0, 0.0, None]


def test_local_avg_of_three(spark):
    layer = cells_of(spark, [(0, 0, 0, 1, 2.0), (0, 0, 0, 2, 4.0), (0, 0, 0, 3, 9.0), (0, 1, 0, 1, 5.0)])
    got = algebra.local_avg([(layer, 1), (layer, 2), (layer, 3)]).collect()
    assert [(r["col"], r["value"]) for r in got] == [(0, 5.0)]
    twice = algebra.local_avg([(layer, 1), (layer, 1)]).orderBy("col").collect()
    assert [r["value"] for r in twice] == [2.0, 5.0]
    some = algebra.local_avg([(layer, 1), (layer, 2)], skip_missing=True).orderBy("col").collect()
    assert [r["value"] for r in some] == [3.0, 5.0]


@pytest.mark.parametrize(
    "window, degree, values, wanted",
    [
        (5, 2, [0, 1, 4, 9, 16, 25], [0, 1, 4, 9, 16, 25]),
        (5, 2, [0, 0, 10, 0, 0], [0, 0, 170 / 35, 0, 0]),
        (4, 2, [0, 0, 10, 0, 0], [0, 0, 5.5, 0, 0]),
        (5, 2, [1, 2], [1, 2]),
        (3, 2, [5, 1, 7, 2], [5, 1, 7, 2]),
    ],
)
def test_savgol_cases(spark, window, degree, values, wanted):
    got = values_by_time(series.savgol(series_of(spark, values), window, degree))
    assert got == pytest.approx(wanted, abs=1e-9)


def test_savgol_weights_are_least_squares():
    assert list(kernels.savgol_weights(5, 2).values()) == pytest.approx([-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35])
    assert list(kernels.savgol_weights(4, 2).values()) == pytest.approx([-0.15, 0.45, 0.55, 0.15])
    for w, p in ((3, 2), (4, 3), (5, 4)):
        assert list(kernels.savgol_weights(w, p).values()) == pytest.approx([float(i == w // 2) for i in range(w)], abs=1e-9)


def test_stretch_cases(spark):
    got = series.minmax_stretch(series_of(spark, [0, 5, 10]), ["band"]).orderBy("time_index").collect()
    assert [r["stretched"] for r in got] == [0, 127, 255]
    flat = series.minmax_stretch(series_of(spark, [7, 7]), ["band"]).collect()
    assert [r["stretched"] for r in flat] == [None, None]


def test_clamp_and_overzoom_keys(spark):
    df = spark.createDataFrame([(2,), (4,), (9,), (15,), (None,)], "z int")
    assert [r[0] for r in df.select(grid.clamp_zoom("z")).collect()] == [4, 4, 9, 12, None]
    a = spark.range(1).select(grid.ancestor(F.lit(100), F.lit(203), F.lit(2)).alias("a")).first()["a"]
    assert (a["tile_x"], a["tile_y"], a["off_x"], a["off_y"]) == (25, 50, 0, 3)


def test_mosaic_priority(spark):
    first = cells_of(spark, [(0, 0, 0, 1, None), (0, 1, 0, 1, 5.0)])
    second = cells_of(spark, [(0, 0, 0, 1, 3.0), (0, 1, 0, 1, 4.0)])
    got = algebra.merge_layers([first, second]).orderBy("col").collect()
    assert [r["value"] for r in got] == [3.0, 5.0]
    last = algebra.merge_layers([first, second], first_wins=False).orderBy("col").collect()
    assert [r["value"] for r in last] == [3.0, 4.0]


def test_colours(spark):
    df = spark.createDataFrame([(5.0,), (10.0,), (None,), (21.0,), (0.0,), (11.0,), (-1.0,)], "v double")
    got = [tuple(r[0]) for r in df.select(colour.color_ramp("v", 0.0, 10.0)).collect()]
    assert got == [(128, 128, 128, 255), (255, 255, 255, 255), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 255), (255, 255, 255, 255), (0, 0, 0, 0)]
    df = spark.createDataFrame([(0.5,), (1.2,), (None,), (-1.0,)], "v double")
    assert [r[0] for r in df.select(colour.to_byte("v")).collect()] == [127, 255, 0, 0]


def test_year_file_bands(spark):
    start = 252460800  # 1998-01-01 in seconds since 1990
    layer = cells_of(spark, [(start, 0, 0, b, float(b)) for b in range(1, 43)])
    got = series.band_to_timestep(layer).withColumn("ts", timeindex.time_index_to_ts("time_index")).orderBy("ts").collect()
    assert len(got) == 42 and str(got[0]["ts"]) == "1998-01-01 00:00:00" and str(got[35]["ts"]) == "1998-12-17 00:00:00"


def test_ewkb_polygon(spark):
    pts = [(90.0, 25.5), (90.25, 25.5), (90.25, 25.75), (90.0, 25.5)]
    little = struct.pack("<BIIII", 1, 0x20000003, 4326, 1, len(pts)) + b"".join(struct.pack("<dd", *p) for p in pts)
    big = struct.pack(">BIII", 0, 3, 1, len(pts)) + b"".join(struct.pack(">dd", *p) for p in pts)
    point = struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    df = spark.createDataFrame([(little.hex(),), (big.hex(),), (point.hex(),), (None,)], "h string")
    got = [r[0] for r in df.select(geom.ring_from_ewkb("h")).collect()]
    assert [(p["x"], p["y"]) for p in got[0]] == pts and got[0] == got[1] and got[2] is None and got[3] is None
    assert spark.createDataFrame([("{bad",)], "j string").select(geom.ring_from_geojson("j")).first()[0] is None


def test_band_meta_malformed_gives_no_rows(spark):
    df = spark.createDataFrame([(2, '[{name:"Blue",min:0,max:9}]'), (3, "[")], "dataset_id long, band_meta string")
    got = parse_band_meta(df).collect()
    assert [(r["dataset_id"], r["band"], r["name"]) for r in got] == [(2, 1, "Blue")]


def test_polygon_spans_follow_even_odd(spark):
    """A concave ring: spans equal a brute-force even-odd test of every centre."""
    ring = [(0.3, 0.2), (7.7, 0.4), (7.2, 6.8), (4.1, 2.2), (1.1, 7.4), (0.3, 0.2)]
    cell = Grid(0.0, 8.0, 0.25, 0.25)
    aoi = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "aoi_id int, ring array<struct<x:double,y:double>>")
    got = {(r["col"], r["row"]) for r in zonal.rasterize_polygon(aoi, cell).collect()}

    def inside(px, py):
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
                hit = not hit
        return hit

    wanted = {(c, r) for c in range(32) for r in range(32) if inside((c + 0.5) * 0.25, 8.0 - (r + 0.5) * 0.25)}
    assert got == wanted and len(wanted) > 100


def test_fpca_against_numpy(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(5, 40))
    rows = [(t, p, 0, 1, float(m[t, p])) for t in range(5) for p in range(40)]
    layer = cells_of(spark, rows)
    model = fpca.fpca_fit(layer)
    u, s, vt = np.linalg.svd((m / math.sqrt(40)).T, full_matrices=False)
    v = vt[0] * (1 if vt[0][np.argmax(np.abs(vt[0]))] > 0 else -1)
    assert model.s == pytest.approx(s[0]) and model.v == pytest.approx(list(v))
    comp = fpca.fpca_components(layer, model)
    got = {r["col"]: r["component"] for r in comp.collect()}
    want = m.T @ v / s[0]
    assert [got[p] for p in range(40)] == pytest.approx(list(want))
    scores = {r["step"]: r["score"] for r in fpca.fpca_scores(comp, model).collect()}
    assert [scores[t] for t in range(5)] == pytest.approx(list(v * s[0]))


def test_fpca_rank_one_is_rebuilt(spark):
    m = [[1.0, 2.0], [2.0, 4.0]]
    layer = cells_of(spark, [(t, p, 0, 1, m[t][p]) for t in range(2) for p in range(2)])
    model = fpca.fpca_fit(layer)
    got = {(r["col"], r["step"]): r["value"] for r in fpca.fpca_reconstruct(fpca.fpca_components(layer, model), model).collect()}
    assert all(got[(p, t)] == pytest.approx(m[t][p]) for t in range(2) for p in range(2))


def test_fpca_of_zeros_is_null(spark):
    layer = cells_of(spark, [(t, p, 0, 1, 0.0) for t in range(2) for p in range(2)])
    comp = fpca.fpca_components(layer, fpca.fpca_fit(layer))
    assert {r["component"] for r in comp.collect()} == {None}
    assert {r["component"] for r in fpca.fpca_per_pixel(layer).collect()} == {None}


def test_fpca_refuses_too_many_steps(spark):
    with pytest.raises(ValueError):
        fpca.layer_steps(series_of(spark, range(20)), max_steps=10)


@pytest.mark.parametrize("method", ["bilinear", "cubic"])
def test_resample_keeps_a_plane(spark, method):
    rows = [(0, c, r, 1, 3.0 * c - 2.0 * r) for c in range(8) for r in range(8)]
    src, dst = Grid(0.0, 8.0, 1.0, 1.0), Grid(0.3, 7.8, 0.7, 0.7)
    got = resample.resample(cells_of(spark, rows), src, dst, 10, 10, method).collect()
    inner = 0
    for r in got:
        u, v = (0.3 + (r["col"] + 0.5) * 0.7) - 0.5, (8.0 - (7.8 - (r["row"] + 0.5) * 0.7)) - 0.5
        if 1 <= u <= 6 and 1 <= v <= 6:
            inner += 1
            assert r["value"] == pytest.approx(3 * u - 2 * v, abs=1e-9)
    assert inner > 25


def test_bands_are_one_based(spark):
    with pytest.raises(ValueError):
        layout.select_bands(series_of(spark, [1]), [0])
    with pytest.raises(ValueError):
        layout.check_bands([1, 8], 7)
    df = spark.createDataFrame([([[1.0], [2.0]],)], "bands array<array<double>>")
    assert df.select(bands.pick_bands("bands", [2, 3])).first()[0] == [[2.0], None]


def test_nodata_becomes_null(spark):
    df = spark.createDataFrame([(0.0,), (float("nan"),), (4.0,), (None,)], "v double")
    assert [r[0] for r in df.select(bands.nodata_to_null("v", 0)).collect()] == [None, None, 4.0, None]


def test_model_errors(spark):
    layer = series_of(spark, [1, 2, 3])
    op = {"id": "O", "type": "op_ndi", "inputs": [{"id": "I", "band": 1}, {"id": "I", "band": 1}]}
    out = {"id": "O"}
    with pytest.raises(ValueError):
        run_model({"operations": [{**op, "type": "op_unknown"}], "output": out}, {"I": layer})
    with pytest.raises(KeyError):
        run_model({"operations": [op], "output": out}, {})
    with pytest.raises(KeyError):
        run_model({"operations": [op], "output": {"id": "X"}}, {"I": layer})
    smooth = {"operations": [{"id": "S", "type": "op_savgol", "inputs": [{"id": "I", "band": 1}], "output": out}], "output": out}
    assert values_by_time(run_model(smooth, {"I": series_of(spark, [0, 0, 10, 0, 0])}))[2] == pytest.approx(170 / 35)


def test_unsupported_crs_is_an_error(spark):
    with pytest.raises(ValueError):
        grid.reproject_point(F.lit(1.0), F.lit(1.0), 4326, 32644)


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_holes_and_parts_from_both_codecs(spark):
    import json

    outer, hole, part = square(0, 0, 8, 8), square(2, 2, 5, 5), square(10, 1, 12, 3)

    def wkb(rings):
        return struct.pack("<BII", 1, 3, len(rings)) + b"".join(
            struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings
        )

    multi = struct.pack("<BIII", 1, 0x20000006, 4326, 2) + wkb([outer, hole]) + wkb([part])
    text = json.dumps({"type": "MultiPolygon", "coordinates": [[outer, hole], [part]]})
    df = spark.createDataFrame([(1, multi.hex(), text), (2, "00zz", "{}"), (3, None, None)], "aoi_id int, h string, j string")
    decoded = df.select("aoi_id", geom.rings_from_ewkb("h").alias("rings"), geom.rings_from_geojson("j").alias("again"))
    rows = decoded.orderBy("aoi_id").collect()
    assert [[(p["x"], p["y"]) for p in r] for r in rows[0]["rings"]] == [outer, hole, part]
    assert rows[0]["rings"] == rows[0]["again"] and rows[1]["rings"] is None and rows[2]["again"] is None
    cell = Grid(0.0, 8.0, 1.0, 1.0)
    got = {(r["col"], r["row"]) for r in zonal.rasterize_polygon(decoded.filter("aoi_id = 1"), cell).collect()}
    inside = lambda x, y, s: s[0][0] < x < s[1][0] and s[0][1] < y < s[2][1]
    centres = {(c, r): (c + 0.5, 7.5 - r) for c in range(14) for r in range(9)}
    assert got == {k for k, p in centres.items() if (inside(*p, outer) and not inside(*p, hole)) or inside(*p, part)}


def test_polygons_at_negative_keys(spark):
    """Cells left of and above the grid's corner are found, masked and counted like all others."""
    cell = Grid(0.0, 0.0, 1.0, 1.0)
    ring = [{"x": float(x), "y": float(y)} for x, y in square(-70, -2, 3, 5)]
    aoi = spark.createDataFrame([(1, ring)], "aoi_id int, ring array<struct<x:double,y:double>>")
    layer = cells_of(spark, [(0, c, r, 1, 1.0) for c in range(-72, 6) for r in range(-7, 4)])
    wanted = {(c, r) for c in range(-70, 3) for r in range(-5, 2)}
    assert {(r["col"], r["row"]) for r in zonal.zonal_cells(layer, aoi, cell).collect()} == wanted
    kept = zonal.clip_to_aoi(layer, aoi, cell).filter("value is not null").collect()
    assert {(r["col"], r["row"]) for r in kept} == wanted
    cut = {(r["col"], r["row"]) for r in zonal.rasterize_polygon(aoi, cell, cols=2, rows=9).collect()}
    assert cut == {(c, r) for c, r in wanted if 0 <= c < 2 and 0 <= r}


def raises(df, text):
    with pytest.raises(Exception, match=text):
        df.collect()


def test_nothing_is_cut_off_silently(spark):
    raises(layout.cells_to_tiles(cells_of(spark, [(0, 0, 0, 3, 1.0)]), 4, 2), "outside 1..2")
    raises(layout.cells_to_tiles(cells_of(spark, [(0, 0, 0, 1, 1.0), (0, 0, 0, 1, 2.0)]), 4, 2), "two values")
    many = cells_of(spark, [(0, 0, 0, b, float(b)) for b in range(1, 50)])
    assert series.band_to_timestep(many).count() == 49
    raises(series.band_to_timestep(many, steps=36), "beyond 36 steps")
    with pytest.raises(ValueError, match="outside 1..5"):
        layout.select_bands(many, [9], no_of_bands=5)
    two = layout.cells_to_tiles(cells_of(spark, [(0, 9, 0, 1, 1.0)]), 4, 1).unionByName(layout.cells_to_tiles(cells_of(spark, [(0, 9, 0, 1, 2.0)]), 4, 1, zoom=3))
    assert {(r["zoom"], r["tile_x"]) for r in layout.retile(two, 3, 1).collect()} == {(0, 3), (3, 3)}


def test_two_layers_are_not_mixed(spark):
    rows = [(0, c, r, b, float(10 * b + c)) for c in range(4) for r in range(4) for b in (1, 2)]
    one = cells_of(spark, rows)
    both = one.unionByName(one.withColumn("layer", F.lit("m")).withColumn("value", F.col("value") * 100))
    raises(algebra.ndi((both, 1), (both, 2)), "two values")
    raises(algebra.local_avg([(both, 1), (both, 2)]), "two values")
    grid0, half = Grid(0.0, 4.0, 1.0, 1.0), Grid(0.0, 4.0, 0.5, 0.5)
    alone = resample.resample(one, grid0, half, 8, 8).collect()
    mixed = resample.resample(both, grid0, half, 8, 8).collect()
    assert sorted(map(tuple, alone)) == sorted(tuple(r) for r in mixed if r["layer"] == "l") and len(mixed) == 2 * len(alone)


def test_fpca_with_repeated_slots_and_foreign_steps(spark):
    rng = np.random.default_rng(8)
    rows = [(t, c, 0, 1, float(rng.integers(1, 100))) for t in (0, 0, 1, 2, 2, 2, 7) for c in range(6)]
    means = np.zeros((3, 6))
    for t in range(3):
        for c in range(6):
            means[t, c] = np.mean([v for s, x, _, _, v in rows if (s, x) == (t, c)])
    for order in (rows, rows[::-1]):
        layer = cells_of(spark, order)
        got = {(r["i"], r["j"]): r["g"] for r in fpca.fpca_gram(layer, steps=[0, 1, 2]).collect()}
        assert all(abs(got[i, j] - (means @ means.T / 6)[i, j]) < 1e-9 for i in range(3) for j in range(i, 3))
        model = fpca.fpca_fit(layer, steps=[0, 1, 2])
        comp = {r["col"]: r["component"] for r in fpca.fpca_components(layer, model).collect()}
        assert all(abs(comp[c] - means[:, c] @ np.array(model.v) / model.s) < 1e-9 for c in range(6))


def test_stored_nulls_are_not_filled(spark):
    wanted = spark.createDataFrame([(0,), (1,), (2,)], "col int")
    stored = spark.createDataFrame([(0, 5.0), (1, None)], "col int, value double")
    got = {r["col"]: r["value"] for r in algebra.fill_empty(wanted, stored, ["col"]).collect()}
    assert got == {0: 5.0, 1: None, 2: 0.0}


def test_tiles_and_cells_agree_where_values_are_missing(spark):
    from terracell.operators import tilestack as stack

    rng = np.random.default_rng(3)
    rows = [(t, c, r, b, float(rng.integers(1, 99))) for t in range(9) for c in range(5) for r in range(4) for b in (1, 2) if rng.random() < 0.7]
    layer = cells_of(spark, rows)
    tiles = layout.cells_to_tiles(layer, 3, 2)

    def rounded(df):
        return sorted((r["time_index"], r["col"], r["row"], r["band"], round(r["value"], 9)) for r in df.collect())

    for window, degree in ((5, 2), (4, 2), (3, 1)):
        assert rounded(layout.tiles_to_cells(stack.tile_savgol(tiles, window, degree))) == rounded(series.savgol(layer, window, degree))
    newest = stack.tile_latest(tiles)
    got = {(r["col"], r["row"], r["band"]): r["value"] for r in layout.tiles_to_cells(newest).collect()}
    assert got == {(r["col"], r["row"], r["band"]): r["value"] for r in series.latest_per_cell(layer).collect()}
    one = layer.filter("band = 1")
    gram = {(r["i"], r["j"]): r["g"] for r in stack.tile_fpca_gram(layout.cells_to_tiles(one, 3, 1), list(range(9))).collect()}
    want = {(r["i"], r["j"]): r["g"] for r in fpca.fpca_gram(one, steps=list(range(9))).collect()}
    assert gram.keys() == want.keys() and all(abs(gram[k] - want[k]) < 1e-9 for k in want)


def test_no_cell_is_shuffled_for_stored_tiles(spark):
    from terracell.operators import tilestack as stack

    tiles = layout.cells_to_tiles(cells_of(spark, [(t, 0, 0, 1, 1.0) for t in range(3)]), 4, 1)
    stored = spark.createDataFrame(tiles.collect(), tiles.schema)
    for df in (stack.tile_savgol(stored), stack.tile_latest(stored), stack.tile_fpca_gram(stored, [0, 1, 2]), stack.tile_rgb_composite(stored, no_of_bands=1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan
    assert "Exchange" not in plan  # the composite needs none


def test_inside_data_in_either_crs(spark):
    df = spark.createDataFrame([(9.9e6, 2.9e6, 1.0e7, 3.0e6), (0.0, 0.0, 1.0, 1.0)], "xmin double, ymin double, xmax double, ymax double")
    data = {"xmin": F.lit(88.0), "ymin": F.lit(24.0), "xmax": F.lit(91.0), "ymax": F.lit(27.0)}
    box = {k: F.col(k) for k in data}
    assert [r[0] for r in df.select(grid.inside_data(box, data, 3857, 4326)).collect()] == [True, False]
    assert [r[0] for r in df.select(grid.inside_data(box, data)).collect()] == [False, False]
    with pytest.raises(ValueError, match="unsupported CRS 32644"):
        grid.inside_data(box, data, 32644)
