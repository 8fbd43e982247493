"""Pyramids: the cascade against single passes, slippy levels against a loop over targets, a scene to its stored pyramid."""

import math
import random

import pytest

from terracell.functions.kernels import SUPPORT
from terracell.operators import layout, levels
from terracell.operators.layout import Grid
from terracell.sources import ingest

CELL = "layer string, time_index bigint, col int, row int, band int, value double"


def scene(seed, cols, rows, x0=0, y0=0, gaps=0.3):
    pick = random.Random(seed)
    return {(c, r): float(pick.randint(1, 99)) for c in range(x0, x0 + cols) for r in range(y0, y0 + rows) if pick.random() > gaps}


def frame(spark, values, layer="a"):
    return spark.createDataFrame([(layer, 0, c, r, 1, v) for (c, r), v in values.items()], CELL)


def halved(values, depth, how):
    out = {}
    for level in range(1, depth + 1):
        groups = {}
        for (c, r), v in sorted(values.items(), key=lambda x: (x[0][1], x[0][0])):
            groups.setdefault((c >> level, r >> level), []).append(v)
        for (c, r), found in groups.items():
            out[level, c, r] = found[0] if how == "nearest" else sum(found) / len(found)
    return out


def as_levels(df):
    rows = df.collect()
    out = {(r["level"], r["col"], r["row"]): r["value"] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("how", ["nearest", "avg"])
def test_cascade_over_borders_and_negative_keys(spark, how):
    values = scene(1, 300, 9, x0=-140, y0=-5)
    expected = halved(values, 9, how)
    assert as_levels(levels.pyramid(frame(spark, values), 9, how)) == pytest.approx(expected)
    for size in (7, 16):  # tiles whose edges do and do not meet those of the levels
        stored = layout.cells_to_tiles(frame(spark, values), size, 1)
        assert as_levels(levels.pyramid_tiles(stored, 9, how)) == pytest.approx(expected)


def test_cascade_edges(spark):
    assert levels.pyramid(frame(spark, {(0, 0): 1.0}).filter("false"), 3).collect() == []
    nulls = spark.createDataFrame([("a", 0, 0, 0, 1, None), ("a", 0, 1, 0, 1, 5.0)], CELL)
    assert as_levels(levels.pyramid(nulls, 1)) == {(1, 0, 0): 5.0}
    twice = spark.createDataFrame([("a", 0, 0, 0, 1, 1.0), ("a", 0, 0, 0, 1, 5.0)], CELL)
    with pytest.raises(Exception, match="two values"):
        levels.pyramid(twice, 1).collect()
    with pytest.raises(ValueError):
        levels.pyramid(nulls, 1, "median")
    two = frame(spark, {(0, 0): 1.0}, "a").unionByName(frame(spark, {(0, 0): 3.0}, "b"))
    assert {(r["layer"], r["value"]) for r in levels.pyramid(two, 1, "avg").collect()} == {("a", 1.0), ("b", 3.0)}


def test_no_copy_of_a_cell_per_level(spark):
    plan = levels.pyramid(frame(spark, {(0, 0): 1.0}), 8)._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "Generate" not in plan
    plan = levels.pyramid_tiles(layout.cells_to_tiles(frame(spark, {(0, 0): 1.0}), 4, 1), 8)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("CollectList") == 0


def test_layers_of_stored_tiles(spark):
    values = scene(3, 40, 24)
    stored = layout.cells_to_tiles(frame(spark, values), 8, 1, zoom=6)
    lower = levels.pyramid_layers(stored, 6, 2, 8, 1)
    assert sorted({r["zoom"] for r in lower.collect()}) == [4, 5]
    cells = layout.tiles_to_cells(lower, with_zoom=True).collect()
    assert {(6 - r["zoom"], r["col"], r["row"]): r["value"] for r in cells} == halved(values, 2, "nearest")


def kernel(d, method):
    d = abs(d)
    if method == "bilinear":
        return max(0.0, 1 - d)
    return (1.5 * d - 2.5) * d * d + 1 if d <= 1 else ((-0.5 * d + 2.5) * d - 4) * d + 2 if d < 2 else 0.0


def slippy(values, src, zooms, size, method):
    """Target by target: the source cells around it."""
    out = {}
    cols, rows = [c for c, _ in values], [r for _, r in values]
    reach = 1 if method == "nearest" else int(SUPPORT[method])
    lat = lambda y, z: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 2**z))))
    tile_y = lambda v, z: math.floor((1 - math.asinh(math.tan(math.radians(v))) / math.pi) / 2 * 2**z)
    for z in zooms:
        west, east = src.x0 + (min(cols) - 3) * src.dx, src.x0 + (max(cols) + 3) * src.dx
        north, south = src.y0 - (min(rows) - 3) * src.dy, src.y0 - (max(rows) + 3) * src.dy
        for tx in range(math.floor((west + 180) / 360 * 2**z), math.floor((east + 180) / 360 * 2**z) + 1):
            for ty in range(tile_y(north, z), tile_y(south, z) + 1):
                for i in range(size):
                    u = (tx / 2**z * 360 - 180 + (i + 0.5) * 360 / 2**z / size - src.x0) / src.dx - 0.5
                    if not min(cols) - 3 < u < max(cols) + 3:
                        continue
                    for j in range(size):
                        v = (src.y0 - (lat(ty, z) - (j + 0.5) * (lat(ty, z) - lat(ty + 1, z)) / size)) / src.dy - 0.5
                        if method == "nearest":
                            found = values.get((math.floor(u + 0.5), math.floor(v + 0.5)))
                            if found is not None:
                                out[z, tx, ty, i, j] = found
                            continue
                        near = [
                            (values[c, r], kernel(u - c, method) * kernel(v - r, method))
                            for c in range(math.floor(u) - reach + 1, math.floor(u) + reach + 1)
                            for r in range(math.floor(v) - reach + 1, math.floor(v) + reach + 1)
                            if (c, r) in values
                        ]
                        total = sum(w for _, w in near)
                        if abs(total) > 1e-9 * sum(abs(w) for _, w in near):
                            out[z, tx, ty, i, j] = sum(a * w for a, w in near) / total
    return out


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
def test_nine_levels_of_whole_tiles(spark, method):
    # across the blocks' border at column 128, and across tile borders
    src, values = Grid(68.0, 36.0, 1 / 512, 1 / 512), scene(5, 14, 9, x0=121, y0=-4, gaps=0.0 if method == "cubic" else 0.2)
    expected = slippy(values, src, range(4, 13), 256, method)
    cells = frame(spark, values)
    rows = levels.ingest_pyramid(cells, src, method=method).collect()
    found = {(r["zoom"], r["tile_x"], r["tile_y"], r["col"], r["row"]): r["value"] for r in rows}
    assert len(found) == len(rows) and found.keys() == expected.keys() and {k[0] for k in found} >= {8, 9, 10, 11, 12}
    assert found == pytest.approx(expected, rel=1e-6, abs=1e-6)
    stored = levels.ingest_tiles(cells, src, 1, method=method).collect()
    tiles = {
        (r["zoom"], r["tile_x"], r["tile_y"], p % 256, p // 256): v
        for r in stored
        for p, v in enumerate(r["bands"][0])
        if v is not None
    }
    assert tiles == pytest.approx(found, rel=1e-9, abs=1e-9)
    assert len({(r["zoom"], r["tile_x"], r["tile_y"]) for r in stored}) == len(stored)


def test_band_outside_the_range(spark):
    cells = spark.createDataFrame([("a", 0, 0, 0, 3, 1.0)], CELL)
    with pytest.raises(Exception, match="outside 1..2"):
        levels.ingest_tiles(cells, Grid(0.0, 0.0, 0.01, 0.01), 2, [12], 16).collect()


def test_scene_to_stored_pyramid_and_catalog(spark, tmp_path):
    src, layer, catalog = Grid(68.0, 36.0, 1 / 64, 1 / 64), str(tmp_path / "layer"), str(tmp_path / "catalog")
    cells = frame(spark, scene(7, 20, 12))

    def store(ingest_id, cells=cells):
        ingest.ingest_scene(cells, src, 1, 4, ingest_id, "s2", layer, catalog, [8, 9, 10], 32, "bilinear")

    store(1)
    store(1)  # repeated as a whole
    key = ["zoom", "tile_x", "tile_y", "time_index"]
    tiles = spark.read.parquet(layer)
    refs = spark.read.parquet(catalog)
    assert {r["zoom"] for r in tiles.collect()} == {8, 9, 10}
    named = refs.selectExpr("zoom_level as zoom", "spatial_index_x as tile_x", "spatial_index_y as tile_y", "time_index", "file_path")
    assert named.count() == tiles.count() == named.join(tiles.select(*key), key).count()
    path = {r["file_path"] for r in named.collect()}
    assert all(p.startswith("s2/") and p.endswith("/0.tif") for p in path) and len(path) == tiles.count()
    fresh = levels.ingest_pyramid(cells, src, [8, 9, 10], 32, "bilinear").count()
    assert tiles.selectExpr("size(filter(bands[0], v -> v is not null)) as n").groupBy().sum("n").first()[0] == fresh
    before = tiles.count()
    store(2, frame(spark, scene(8, 4, 4)))  # a smaller scene of the same layer and time: only its own tiles
    again = spark.read.parquet(catalog).groupBy("ingest_id").count().collect()
    counts = {r["ingest_id"]: r["count"] for r in again}
    assert counts[1] == before and 0 < counts[2] < counts[1]
