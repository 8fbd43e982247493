"""Which tiles, scenes and AOIs meet: tile covers and catalog joins.

Candidate tiles are generated per row from its own box, so nothing is joined with a
materialised grid; everything else is an equi-join.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.geom import boxes_overlap, footprint_meets_box, polygon_edges
from ..functions.grid import (
    MAX_ZOOM,
    MIN_ZOOM,
    lat_to_tile_y,
    lon_to_tile_x,
    tile_bbox,
    tile_lat,
    tile_lon,
    tile_path,
    z_index,
)
from ..functions._col import pow2
from ..plans.joins import box_join, fan_out, rebalance, small_join

STORAGE_LEVELS = list(range(MIN_ZOOM, MAX_ZOOM + 1))
BOX = ["xmin", "ymin", "xmax", "ymax"]
#: tiles along a side of the blocks in which a cover is shuffled; catalog files lie by them
BLOCK = 64
#: and along a side of the largest span of tiles that is shuffled as one row
SPAN = 8


def _around(low: Column, high: Column) -> Column:
    """Tile numbers low..high of the row's zoom and one more on either side."""
    return F.sequence(F.greatest(low - 1, F.lit(0)), F.least(high + 1, pow2("zoom").cast("int") - 1))


def tiles_in_bbox(boxes: DataFrame, levels: list[int] | Column) -> DataFrame:
    """Every tile at each level whose box meets the row's box; touching counts.

    Adds zoom, tile_x, tile_y. Candidates reach one tile beyond the box and an exact closed test
    decides.
    """
    levels = F.array(*[F.lit(z) for z in levels]) if isinstance(levels, list) else levels
    z = F.col("zoom")
    row = {k: F.col(k) for k in BOX}
    # rows of tiles first, so that their latitudes are worked out once and not for every tile
    rows = boxes.withColumn("zoom", F.explode(levels)).withColumn("tile_y", F.explode(_around(lat_to_tile_y("ymax", z), lat_to_tile_y("ymin", z))))
    rows = rows.filter((tile_lat(F.col("tile_y") + 1, z) <= row["ymax"]) & (tile_lat("tile_y", z) >= row["ymin"]))
    tiles = rows.withColumn("tile_x", F.explode(_around(lon_to_tile_x("xmin", z), lon_to_tile_x("xmax", z))))
    tiles = tiles.filter((tile_lon("tile_x", z) <= row["xmax"]) & (tile_lon(F.col("tile_x") + 1, z) >= row["xmin"]))
    return tiles.select(*dict.fromkeys([*boxes.columns, "zoom", "tile_x", "tile_y"]))


@F.arrow_udf(ArrayType(IntegerType()))
def _tiles_of_row(zoom: pa.Array, low: pa.Array, high: pa.Array, edges: pa.Array) -> pa.Array:
    """Tiles of a row of tiles (its zoom and latitudes) that meet the polygon of the edges; no edges, no tiles.

    An edge is tested against the tiles next to the part of it that lies in the row. The inside is filled between the crossings at the
    row's centre line. All rows of a batch are worked out together.
    """
    import numpy as np

    n, low, high = 2 ** zoom.to_numpy().astype(np.int64), low.to_numpy(), high.to_numpy()
    flat = edges.flatten()
    x1, y1, x2, y2 = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("x1", "y1", "x2", "y2"))
    row = np.repeat(np.arange(len(n)), edges.value_lengths().fill_null(0).to_numpy())
    known = np.isfinite(x1 + y1 + x2 + y2)
    x1, y1, x2, y2, row = (v[known] for v in (x1, y1, x2, y2, row))

    def lon(t, of):
        return t / n[of] * 360.0 - 180.0

    def next_to(left, right, of):
        """The tiles from left to right and one more on either side: index of the interval, and tile."""
        first, last = (np.clip(np.floor((x + 180.0) / 360.0 * n[of]), 0, n[of] - 1).astype(np.int64) for x in (left, right))
        first, last = np.maximum(first - 1, 0), np.minimum(last + 1, n[of] - 1)
        count = last - first + 1
        which = np.repeat(np.arange(len(count)), count)
        return which, first[which] + np.arange(len(which)) - (np.cumsum(count) - count)[which]

    dx, dy = x2 - x1, y2 - y1
    level = dy == 0
    ends = []
    for x, y in ((x1, low[row]), (x2, high[row])):
        y = np.clip(y, np.minimum(y1, y2), np.maximum(y1, y2))
        ends.append(np.where(level, x, x1 + (y - y1) * dx / np.where(level, 1.0, dy)))
    e, t = next_to(np.minimum(*ends), np.maximum(*ends), row)
    of = row[e]
    left, right = lon(t, of), lon(t + 1, of)
    cx, cy, hx, hy = (left + right) / 2.0, (low[of] + high[of]) / 2.0, (right - left) / 2.0, (high[of] - low[of]) / 2.0
    meets = (np.minimum(x1, x2)[e] <= right) & (np.maximum(x1, x2)[e] >= left)
    meets &= np.abs(dx[e] * (cy - y1[e]) - dy[e] * (cx - x1[e])) <= np.abs(dx[e]) * hy + np.abs(dy[e]) * hx
    found = [(of[meets], t[meets])]

    middle = (low + high)[row] / 2.0
    crosses = (y1 > middle) != (y2 > middle)
    at = x1[crosses] + (middle[crosses] - y1[crosses]) * dx[crosses] / dy[crosses]
    order = np.lexsort((at, row[crosses]))
    at, of = at[order], row[crosses][order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    start = np.flatnonzero((rank[:-1] % 2 == 0) & (of[:-1] == of[1:]))
    a, b, of = at[start], at[start + 1], of[start]
    s, t = next_to(a, b, of)
    centre = (lon(t, of[s]) + lon(t + 1, of[s])) / 2.0
    inside = (centre >= a[s]) & (centre < b[s])
    found.append((of[s][inside], t[inside]))

    width = np.int64(2) ** (MAX_ZOOM + 20)  # more than any tile number
    tiles = np.unique(np.concatenate([r * width + t for r, t in found]))
    offsets = np.searchsorted(tiles, np.arange(len(n) + 1) * width).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((tiles % width).astype(np.int32)))


def _footprint_rows(scenes: DataFrame, levels: list[int]) -> DataFrame:
    """One row per scene, level and row of tiles that meets the box, with `_tiles`: where its footprint may lie in the row."""
    z, low, high = F.col("zoom"), F.col("_low"), F.col("_high")
    per_row = (
        scenes.withColumn("zoom", F.explode(F.array(*[F.lit(v) for v in levels])))
        .withColumn("tile_y", F.explode(_around(lat_to_tile_y("ymax", z), lat_to_tile_y("ymin", z))))
        .withColumns({"_low": tile_lat(F.col("tile_y") + 1, z), "_high": tile_lat("tile_y", z)})
        .filter((low <= F.col("ymax")) & (high >= F.col("ymin")))
        .withColumn("_here", F.filter("_edges", lambda e: (F.least(e["y1"], e["y2"]) <= high) & (F.greatest(e["y1"], e["y2"]) >= low)))
    )
    all_of_box = _around(lon_to_tile_x("xmin", z), lon_to_tile_x("xmax", z))
    return per_row.withColumn("_tiles", F.when(F.col("_edges").isNull(), all_of_box).otherwise(_tiles_of_row(z, low, high, F.col("_here"))))


def footprint_cover(scenes: DataFrame, levels: list[int]) -> DataFrame:
    """Tiles that meet both a scene's box and its `_edges`, by rows of tiles; null edges leave the box alone to decide.

    A scene becomes one row per level and row of tiles, with the edges that reach it; a tile meets the footprint if an edge meets it
    or its centre lies inside. Work is in proportion to rows x edges + tiles of the cover, without a test of every edge on
    every tile. No shuffle, and no tile is found twice. Edges with a null coordinate count as missing.
    """
    z = F.col("zoom")
    tiles = _footprint_rows(scenes, levels).withColumn("tile_x", F.explode("_tiles"))
    tiles = tiles.filter((tile_lon("tile_x", z) <= F.col("xmax")) & (tile_lon(F.col("tile_x") + 1, z) >= F.col("xmin")))
    given = [c for c in scenes.columns if c != "_edges"]
    return tiles.select(*given, "zoom", "tile_x", "tile_y")


def _ends(low: Column, high: Column, from_here, to_here) -> tuple[Column, Column]:
    """First and last of the numbers of _around(low, high) that pass two tests, without a list of them; null, or last before first, if none does.

    from_here holds from some number on, which is next to low, and to_here up to some number, which is next to high.
    """
    a = F.greatest(low - 1, F.lit(0))
    b = F.greatest(F.least(high + 1, pow2("zoom").cast("int") - 1), a)
    first, last = F.coalesce(*[F.when(from_here(n), n) for n in (a, a + 1, a + 2)]), F.coalesce(*[F.when(to_here(n), n) for n in (b, b - 1, b - 2)])
    return first, last


def _pieces(first: Column, last: Column) -> Column:
    """Which SPAN numbers each the numbers first..last lie in; null where there are none."""
    return F.when(first <= last, F.sequence(*(F.shiftright(v, 3) for v in (first, last))))


def cover_spans(scenes: DataFrame, levels: list[int]) -> DataFrame:
    """The tiles of tiles_in_bbox, or of footprint_cover where scenes have `_edges`, as rectangles of at most SPAN x SPAN tiles.

    They are cut along a fixed grid; a footprint gives them per row of tiles. `_block` holds the level and the place of the block of
    BLOCK x BLOCK tiles, `_span` the first and last tile row and column within it. span_tiles makes the tiles. The scenes' box is left out.
    """
    z = F.col("zoom")
    lon, lat = (lambda n: tile_lon(n, z)), (lambda n: tile_lat(n, z))
    given = [c for c in scenes.columns if c not in ("_edges", *BOX)]
    if "_edges" in scenes.columns:
        inside = F.filter("_tiles", lambda t: (lon(t) <= F.col("xmax")) & (lon(t + 1) >= F.col("xmin")))
        rows = _footprint_rows(scenes, levels).withColumn("_tiles", F.sort_array(inside)).withColumns({"_y0": F.col("tile_y"), "_y1": F.col("tile_y")})
        t = F.col("_tiles")
        starts = F.filter(t, lambda n, i: (i == 0) | (F.get(t, i - 1) != n - 1))
        stops = F.filter(t, lambda n, i: (i == F.size(t) - 1) | (F.get(t, i + 1) != n + 1))
        rows = rows.withColumn("_run", F.explode(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
        rows = rows.withColumns({"_x0": F.col("_run.a"), "_x1": F.col("_run.b")})
    else:
        y = _ends(lat_to_tile_y("ymax", z), lat_to_tile_y("ymin", z), lambda n: lat(n + 1) <= F.col("ymax"), lambda n: lat(n) >= F.col("ymin"))
        x = _ends(lon_to_tile_x("xmin", z), lon_to_tile_x("xmax", z), lambda n: lon(n + 1) >= F.col("xmin"), lambda n: lon(n) <= F.col("xmax"))
        rows = scenes.withColumn("zoom", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumns(dict(zip(("_y0", "_y1", "_x0", "_x1"), (*y, *x))))
    for d in "yx":
        rows = rows.withColumn(f"_p{d}", F.explode(_pieces(F.col(f"_{d}0"), F.col(f"_{d}1"))))
    block, corners = [z], []
    for d in "yx":
        piece = F.col(f"_p{d}")
        block.append(F.shiftright(piece, 3))
        corners += [F.greatest(F.col(f"_{d}0"), piece * SPAN) % BLOCK, F.least(F.col(f"_{d}1"), piece * SPAN + (SPAN - 1)) % BLOCK]
    return rows.select(*given, _packed(block, 24, "bigint").alias("_block"), _packed(corners, 6, "int").alias("_span"))


def _packed(parts: list[Column], bits: int, kind: str) -> Column:
    """Non-negative numbers of so many bits in one, the first highest."""
    return reduce(Column.bitwiseOR, [F.shiftleft(p.cast(kind), bits * i) for i, p in enumerate(reversed(parts))])


def _unpacked(column: str, count: int, bits: int) -> list[Column]:
    return [F.shiftright(column, bits * i).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for i in reversed(range(count))]


def span_tiles(spans: DataFrame) -> DataFrame:
    """The tiles of cover_spans: zoom, tile_x and tile_y for `_block` and `_span`."""
    (zoom, by, bx), (y0, y1, x0, x1) = _unpacked("_block", 3, 24), _unpacked("_span", 4, 6)
    rows = spans.withColumn("tile_y", F.explode(F.sequence(by * BLOCK + y0, by * BLOCK + y1)))
    tiles = rows.withColumn("tile_x", F.explode(F.sequence(bx * BLOCK + x0, bx * BLOCK + x1)))
    return tiles.withColumn("zoom", zoom).select(*[c for c in spans.columns if c not in ("_block", "_span")], "zoom", "tile_x", "tile_y")


def scene_tile_cover(
    scenes: DataFrame, levels: list[int] | None = None, grid_mask: DataFrame | None = None, together: list[str] | None = None
) -> DataFrame:
    """Tiles to store for each scene: those that meet its box and its exact footprint where a ring, or rings with holes and parts, are given.

    grid_mask (zoom, tile_x, tile_y) limits the cover to known grid cells. With `together`, tiles of the same level, block of BLOCK x BLOCK tiles
    and values of these columns lie together, in partitions of an even size; only the cover's spans are shuffled for it, not its tiles.
    """
    levels = levels or STORAGE_LEVELS
    if together is not None:
        if {"ring", "rings"} & set(scenes.columns):
            scenes = scenes.withColumn("_edges", polygon_edges(scenes)).drop("ring", "rings")
        cover = span_tiles(rebalance(cover_spans(scenes, levels), *together, "_block"))
    elif {"ring", "rings"} & set(scenes.columns):
        scenes = scenes.withColumn("_edges", polygon_edges(scenes)).drop("ring", "rings")
        cover = footprint_cover(fan_out(scenes, "ingest_id"), levels)
    else:
        cover = tiles_in_bbox(fan_out(scenes, "ingest_id"), levels)
    if grid_mask is not None:
        cover = cover.join(grid_mask.select("zoom", "tile_x", "tile_y").distinct(), ["zoom", "tile_x", "tile_y"], "left_semi")
    return cover.drop(*BOX)


def tile_refs_of(cover: DataFrame, sensor: str | Column = "sensor") -> DataFrame:
    """Catalog rows (Z key and path) of a scene cover. `sensor` is a column."""
    return cover.select(
        "ingest_id",
        "dataset_id",
        F.col("zoom").alias("zoom_level"),
        "time_index",
        F.col("tile_x").alias("spatial_index_x"),
        F.col("tile_y").alias("spatial_index_y"),
        z_index("time_index", "tile_y", "tile_x").alias("z_index"),
        tile_path(sensor, "zoom", "tile_x", "tile_y", "time_index").alias("file_path"),
    )


def scene_aoi_filter(pairs: DataFrame) -> DataFrame:
    """Scene footprint (its edges if present, else its box) against the AOI's envelope b_xmin..b_ymax."""
    box = {k: F.col(f"b_{k}") for k in BOX}
    own = {k: F.col(k) for k in BOX}
    return pairs.filter(footprint_meets_box("_edges", own, box) if "_edges" in pairs.columns else boxes_overlap(own, box))


def aoi_scenes(aois: DataFrame, scenes: DataFrame, start=None, end=None, dataset_id: int | None = None) -> DataFrame:
    """Scenes meeting each AOI's envelope, optionally of one dataset and within a time range.

    aois: aoi_id, xmin..ymax. Output: aoi_id, ingest_id, dataset_id, time_index.
    """
    from .series import time_range

    wanted = time_range(scenes, start, end)
    if dataset_id is not None:
        wanted = wanted.filter(F.col("dataset_id") == dataset_id)
    areas = aois.select("aoi_id", *[F.col(k).alias(f"b_{k}") for k in BOX])
    keep = ["ingest_id", "dataset_id", "time_index", *BOX]
    edges = [polygon_edges(scenes).alias("_edges")] if {"ring", "rings"} & set(scenes.columns) else []
    pairs = box_join(wanted.select(*keep, *edges), areas, ["ingest_id"])
    return scene_aoi_filter(pairs).select("aoi_id", "ingest_id", "dataset_id", "time_index")


def aoi_tile_refs(aois: DataFrame, tile_refs: DataFrame, level: int = MAX_ZOOM, dataset_id=None, times: list[int] | None = None) -> DataFrame:
    """Stored tiles under each AOI's envelope at one level: a cover, then one equi-join.

    times None means all times. Filters on the stored side reach its scan.
    """
    stored = tile_refs.filter(F.col("zoom_level") == level)
    if dataset_id is not None:
        stored = stored.filter(F.col("dataset_id") == dataset_id)
    if times is not None:
        stored = stored.filter(F.col("time_index").isin(times))
    cover = tiles_in_bbox(aois.select("aoi_id", *BOX), [level]).select(
        "aoi_id",
        F.col("tile_x").alias("spatial_index_x"),
        F.col("tile_y").alias("spatial_index_y"),
    )
    return small_join(stored, cover, ["spatial_index_x", "spatial_index_y"], ["aoi_id"])


def with_tiles(cover: DataFrame, tile_refs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have a stored tile."""
    return cover.join(tile_refs.select(*keys), keys, "left_semi")


def without_tiles(cover: DataFrame, tile_refs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose tile is not stored."""
    return cover.join(tile_refs.select(*keys), keys, "left_anti")


def _places(low: Column, high: Column, count: Column) -> Column:
    """Numbers from low to high among 0..count-1 and one more on either side; null where there is none."""
    first = F.greatest(F.floor(F.greatest(F.least(F.nanvl(low, F.lit(0.0)), count), F.lit(0.0))) - 1, F.lit(0)).cast("int")
    last = F.least(F.ceil(F.greatest(F.least(F.nanvl(high, count.cast("double")), count), F.lit(-1.0))) + 1, count - 1).cast("int")
    return F.when(first <= last, F.sequence(first, last))


def aoi_data(aois: DataFrame, tiles: DataFrame, level: int, times: list[int] | None = None, layer: str | None = None) -> DataFrame:
    """Cells under each AOI's envelope from slippy tiles: cover, join, latest-last mosaic, crop.

    Every layer, or the one named, is mosaicked on its own. Output: aoi_id, layer, zoom, tile_x, tile_y, col, row (within the tile), band, value.
    """
    stored = tiles.filter(F.col("zoom") == level)
    if times is not None:
        stored = stored.filter(F.col("time_index").isin(times))
    if layer is not None:
        stored = stored.filter(F.col("layer") == layer)
    cover = tiles_in_bbox(aois.select("aoi_id", *BOX), [level])
    hits = small_join(stored, cover, ["zoom", "tile_x", "tile_y"], ["aoi_id"])
    tile = tile_bbox(F.col("zoom"), F.col("tile_x"), F.col("tile_y"))
    edges = {f"_{k}": tile[k] for k in BOX}
    wide, high = F.col("_xmax") - F.col("_xmin"), F.col("_ymax") - F.col("_ymin")
    x, y = F.col("_xmin") + (F.col("col") + 0.5) * wide / F.col("cols"), F.col("_ymax") - (F.col("row") + 0.5) * high / F.col("rows")
    left, right = ((F.col(k) - F.col("_xmin")) / wide * F.col("cols") - 0.5 for k in ("xmin", "xmax"))
    top, bottom = ((F.col("_ymax") - F.col(k)) / high * F.col("rows") - 0.5 for k in ("ymax", "ymin"))
    # the places inside are found once for all bands of a tile, and only their values are taken
    cells = (
        hits.select("aoi_id", *BOX, "layer", "zoom", "tile_x", "tile_y", "time_index", "cols", "rows", "bands")
        .withColumns(edges)
        .withColumn("row", F.explode(_places(top, bottom, F.col("rows"))))
        .filter(y.between(F.col("ymin"), F.col("ymax")))
        .withColumn("col", F.explode(_places(left, right, F.col("cols"))))
        .filter(x.between(F.col("xmin"), F.col("xmax")))
        .select("*", F.posexplode("bands").alias("b", "data"))
        .withColumn("value", F.get("data", F.col("row") * F.col("cols") + F.col("col")))
        .filter(F.col("value").isNotNull())
    )
    keys = ["aoi_id", "layer", "zoom", "tile_x", "tile_y", "col", "row"]
    return cells.groupBy(*keys, (F.col("b") + 1).alias("band")).agg(
        F.max_by("value", "time_index").alias("value")
    )
