"""Rendering as data: RGBA columns instead of image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import scale_offset
from ..functions.colour import color_ramp, to_byte
from ..functions.geom import boxes_overlap, point_in_edges, polygon_edges
from ..functions.grid import MAX_ZOOM, MIN_ZOOM, clamp_zoom, lat_to_tile_y, lon_to_tile_x, tile_bbox
from ..plans.joins import small_join
from .layout import cells_to_wide
from .tiles import one_layer

DEFAULT_BANDS = [2, 3, 4]


def _rgba(r: Column, g: Column, b: Column) -> list[Column]:
    return [
        r.alias("r"),
        g.alias("g"),
        b.alias("b"),
        F.when(r + g + b > 0, F.lit(255)).otherwise(F.lit(0)).alias("a"),
    ]


def composite_bands(bands: list[int] | None, no_of_bands: int) -> list[int]:
    """Bands to show: 2,3,4 by default; a one-band dataset shows its band three times."""
    return [1, 1, 1] if no_of_bands == 1 else list(bands or DEFAULT_BANDS)


def rgb_composite(
    cells: DataFrame, bands: list[int] | None = None, no_of_bands: int = 7, scale=1.0, offset=0.0, vmin=0.0, vmax=1.0
) -> DataFrame:
    """Three bands to r, g, b and an alpha that is 255 where any colour is set."""
    red, green, blue = composite_bands(bands, no_of_bands)
    wide = cells_to_wide(cells, sorted({red, green, blue}))

    def byte(n: int) -> Column:
        return to_byte(scale_offset(F.col(f"b{n}"), scale, offset), vmin, vmax)

    return wide.select("layer", "time_index", "col", "row", *_rgba(byte(red), byte(green), byte(blue)))


def color_layer(cells: DataFrame, low, high, ramp=None) -> DataFrame:
    """Each cell's colour on a ramp."""
    return cells.withColumn("_c", color_ramp("value", low, high, ramp)).select(*cells.columns, "_c.*")


def tile_render_query(
    requests: DataFrame,
    tiles: DataFrame,
    aois: DataFrame,
    bands: list[int] | None = None,
    no_of_bands: int = 7,
    scale: float = 1.0,
    offset: float = 0.0,
    vmin: float = 0.0,
    vmax: float = 1.0,
    size: int = 256,
    levels: tuple[int, int] = (MIN_ZOOM, MAX_ZOOM),
    layer: str | None = None,
) -> DataFrame:
    """RGBA pixels of a batch of map-tile requests, clipped to each request's AOI.

    requests: request_id, z, x, y, time_index, aoi_id, and `layer` where each names the one it wants; else `layer` names
    one for all. Without either, `tiles` must hold one layer, or it is an error. aois: aoi_id, xmin..ymax, and ring, or rings where
    polygons have holes or several parts. tiles: stored slippy tiles. A request outside its AOI's envelope yields nothing. Output pixels are
    (request_id, col, row); null or masked pixels are transparent.

    Each request meets the stored tiles under it in one equi-join on the tile key (the stored arrays
    are not shuffled while the counted requests fit a broadcast), and every
    output pixel takes the nearest stored cell of the one tile its centre falls in.
    """
    red, green, blue = composite_bands(bands, no_of_bands)
    low, high = levels
    box = tile_bbox(F.col("z"), F.col("x"), F.col("y"))
    asked = (
        requests.withColumn("_b", box)
        .select("*", F.col("_b.xmin").alias("_w"), F.col("_b.ymin").alias("_s"), F.col("_b.xmax").alias("_e"), F.col("_b.ymax").alias("_n"))
        .drop("_b")
        .join(aois.select("aoi_id", "xmin", "ymin", "xmax", "ymax", polygon_edges(aois).alias("_edges")), "aoi_id")
        .filter(
            boxes_overlap(
                {"xmin": F.col("_w"), "ymin": F.col("_s"), "xmax": F.col("_e"), "ymax": F.col("_n")},
                {k: F.col(k) for k in ("xmin", "ymin", "xmax", "ymax")},
            )
        )
        .withColumn("zoom", clamp_zoom("z", low, high))
    )
    dx, dy = (F.col("_e") - F.col("_w")) / size, (F.col("_n") - F.col("_s")) / size
    # half a pixel in from the edges, so tiles that are only touched are not read
    covered = (
        asked.withColumn(
            "tile_x",
            F.explode(F.sequence(lon_to_tile_x(F.col("_w") + dx / 2, F.col("zoom")), lon_to_tile_x(F.col("_e") - dx / 2, F.col("zoom")))),
        ).withColumn(
            "tile_y",
            F.explode(F.sequence(lat_to_tile_y(F.col("_n") - dy / 2, F.col("zoom")), lat_to_tile_y(F.col("_s") + dy / 2, F.col("zoom")))),
        )
    )
    if layer is not None:
        tiles = tiles.filter(F.col("layer") == layer)
    asked_for = ["layer"] if "layer" in requests.columns else []
    if layer is None and not asked_for:
        tiles = one_layer(tiles)
    stored = tiles.select(
        *asked_for,
        "zoom",
        "tile_x",
        "tile_y",
        "time_index",
        "cols",
        "rows",
        *[F.get("bands", F.lit(n - 1)).alias(f"_d{k}") for k, n in zip("rgb", (red, green, blue))],
    )
    keys = [*asked_for, "zoom", "tile_x", "tile_y", "time_index"]
    hits = small_join(stored, covered, keys, ["request_id"]).withColumn(
        "_t", tile_bbox(F.col("zoom"), F.col("tile_x"), F.col("tile_y"))
    )

    def span(first: Column, last: Column) -> Column:
        a = F.greatest(F.floor(first).cast("int") - 1, F.lit(0))
        b = F.least(F.ceil(last).cast("int") + 1, F.lit(size - 1))
        return F.sequence(a, F.greatest(a, b))

    px = (
        hits.withColumn("col", F.explode(span((F.col("_t.xmin") - F.col("_w")) / dx, (F.col("_t.xmax") - F.col("_w")) / dx)))
        .withColumn("row", F.explode(span((F.col("_n") - F.col("_t.ymax")) / dy, (F.col("_n") - F.col("_t.ymin")) / dy)))
        .withColumn("_x", F.col("_w") + (F.col("col") + 0.5) * dx)
        .withColumn("_y", F.col("_n") - (F.col("row") + 0.5) * dy)
        .withColumn("_c", F.floor((F.col("_x") - F.col("_t.xmin")) / (F.col("_t.xmax") - F.col("_t.xmin")) * F.col("cols")).cast("int"))
        .withColumn("_r", F.floor((F.col("_t.ymax") - F.col("_y")) / (F.col("_t.ymax") - F.col("_t.ymin")) * F.col("rows")).cast("int"))
        .filter(
            F.col("col").between(0, size - 1)
            & F.col("row").between(0, size - 1)
            & (F.col("_c") >= 0)
            & (F.col("_c") < F.col("cols"))
            & (F.col("_r") >= 0)
            & (F.col("_r") < F.col("rows"))
        )
    )
    place = F.col("_r") * F.col("cols") + F.col("_c")
    inside = (
        F.col("_x").between(F.col("xmin"), F.col("xmax"))
        & F.col("_y").between(F.col("ymin"), F.col("ymax"))
        & point_in_edges("_x", "_y", "_edges")
    )

    def byte(k: str) -> Column:
        value = F.when(inside, F.get(f"_d{k}", place))
        return to_byte(scale_offset(value, scale, offset), vmin, vmax)

    raw = px.select("request_id", "col", "row", *[byte(k).alias(f"_{k}8") for k in "rgb"])
    return raw.select("request_id", "col", "row", *_rgba(F.col("_r8"), F.col("_g8"), F.col("_b8")))
