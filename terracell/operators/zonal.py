"""Polygons against cells, by scanlines.

A polygon becomes, per raster row, the column spans whose cell centres lie inside it (even-odd,
half-open). That costs one row per edge and raster row instead of one polygon test per
cell, and the spans meet the cells in an equi-join on (row, column block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._col import intdiv
from ..functions.geom import polygon_edges
from ..plans.joins import fan_out, measured, small_join, within
from ..plans.storage import cut
from .layout import Grid, SlippyGrid

#: columns per join block: narrow enough that a cell meets few spans, wide enough that spans stay few
BLOCK = 32
MASK_BITS = 64
#: rows of a layer (times, bands, values) that a polygon's span is taken to meet, for the number of tasks only
MEETS = 32


def _first_col_from(x: Column, grid: Grid) -> Column:
    """Smallest column whose centre is at or right of x, exact for the centre expression."""
    guess = F.ceil((x - grid.x0) / grid.dx - 0.5)
    return (
        F.when(grid.x(guess - 1) >= x, guess - 1).when(grid.x(guess) >= x, guess).otherwise(guess + 1).cast("int")
    )


def polygon_spans(aois: DataFrame, grid: Grid | SlippyGrid, id_col: str = "aoi_id", cols: int | None = None, rows: int | None = None) -> DataFrame:
    """(id, row, c0, c1): columns c0..c1 of a raster row lie inside the polygon.

    aois has an id and a closed `ring`, or `rings` where polygons have holes or several parts (even-odd over all
    rings). Keys may be negative; where a raster's size is given in either direction, spans are cut to it
    and to keys from 0 on.
    """
    edges = aois.select(id_col, F.explode(polygon_edges(aois)).alias("e")).select(
        id_col, "e.x1", "e.y1", "e.x2", "e.y2"
    )
    top, bottom = grid.rows_between(F.greatest("y1", "y2"), F.least("y1", "y2"))
    if rows is not None or cols is not None:
        top = F.greatest(top, F.lit(0))
    if rows is not None:
        bottom = F.least(bottom, F.lit(rows - 1))
    # edges are spread before each becomes one row per raster row, so a very detailed polygon is many tasks' work
    crossings = (
        fan_out(edges.filter(F.col("y1") != F.col("y2")))
        .withColumn("_top", top)
        .withColumn("_bottom", bottom)
        .filter(F.col("_top") <= F.col("_bottom"))
        .withColumn("row", F.explode(F.sequence("_top", "_bottom")))
        .withColumn("_cy", grid.y("row"))
        .filter((F.col("y1") > F.col("_cy")) != (F.col("y2") > F.col("_cy")))
        .withColumn(
            "_x",
            F.col("x1") + (F.col("_cy") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")),
        )
    )
    sorted_x = crossings.groupBy(id_col, "row").agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.call_function("div", F.size("_xs"), F.lit(2)).cast("int") - 1),
        lambda i: F.struct(F.get(F.col("_xs"), i * 2).alias("a"), F.get(F.col("_xs"), i * 2 + 1).alias("b")),
    )
    spans = sorted_x.select(id_col, "row", F.explode(pairs).alias("_s")).select(
        id_col,
        "row",
        F.greatest(_first_col_from(F.col("_s.a"), grid), F.lit(None if rows is None and cols is None else 0).cast("int")).alias("c0"),
        (_first_col_from(F.col("_s.b"), grid) - 1).alias("c1"),
    )
    if cols is not None:
        spans = spans.withColumn("c1", F.least("c1", F.lit(cols - 1)))
    return spans.filter(F.col("c0") <= F.col("c1"))


def rasterize_polygon(aois: DataFrame, grid: Grid, id_col: str = "aoi_id", cols: int | None = None, rows: int | None = None) -> DataFrame:
    """(id, col, row) of every cell whose centre lies inside the polygon."""
    spans = polygon_spans(aois, grid, id_col, cols, rows)
    return spans.select(id_col, F.explode(F.sequence("c0", "c1")).alias("col"), "row")


def zonal_cells(cells: DataFrame, aois: DataFrame, grid: Grid, id_col: str = "aoi_id") -> DataFrame:
    """Cells inside each polygon, tagged with its id.

    Counted spans that fit are broadcast and the cells stay where they are. Otherwise, where very
    many polygons share a block, their spans are spread and only that block's cells copied.
    """
    spans = polygon_spans(aois, grid, id_col)
    first, last = intdiv("c0", BLOCK).cast("int"), intdiv("c1", BLOCK).cast("int")
    blocked = spans.withColumn("_block", F.explode(F.sequence(first, last)))
    keyed = cells.withColumn("_block", intdiv("col", BLOCK).cast("int"))
    joined = small_join(keyed, blocked, ["row", "_block"], [id_col, "c0"])
    return joined.filter(F.col("col").between(F.col("c0"), F.col("c1"))).select(id_col, *cells.columns)


def _pieces(spans: DataFrame, width: int) -> DataFrame:
    """Spans cut at blocks of `width` columns: _block and the columns _lo.._hi within it."""
    first, last = intdiv("c0", width).cast("int"), intdiv("c1", width).cast("int")
    cut = spans.withColumn("_block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("c0") - F.col("_block") * width, F.lit(0)).cast("int")
    hi = F.least(F.col("c1") - F.col("_block") * width, F.lit(width - 1)).cast("int")
    return cut.withColumns({"_lo": lo, "_hi": hi}).drop("c0", "c1")


def zonal_histogram(cells: DataFrame, aois: DataFrame, grid: Grid, id_col: str = "aoi_id") -> DataFrame:
    """Count of cells per polygon and whole-number value.

    The cells of one value in a raster row and block are one 64-bit mask, put together with partial sums. A polygon's span is
    a mask, too, and what both share is counted, so a polygon meets values and not cells. A cell given twice is an error.
    """
    keys = [c for c in ("layer", "time_index", "band") if c in cells.columns]
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("col", F.lit(MASK_BITS)).cast("int"))
    masks = (
        cells.filter(F.col("value").isNotNull())
        .groupBy(*keys, "row", intdiv("col", MASK_BITS).cast("int").alias("_block"), F.col("value").cast("int").alias("value"))
        .agg(F.bit_or(bit).alias("_mask"), F.count(F.lit(1)).alias("_n"))
    )
    twice = F.raise_error(F.lit("a cell is given twice: mosaic first")).cast("bigint")
    masks = masks.withColumn("_mask", F.when(F.col("_n") > F.bit_count("_mask"), twice).otherwise(F.col("_mask")))
    pieces = _pieces(polygon_spans(aois, grid, id_col), MASK_BITS)
    joined = small_join(masks, pieces, ["row", "_block"], [id_col, "_lo"], meets=MEETS)
    shared = F.bit_count(F.col("_mask").bitwiseAND(_ones(F.col("_lo"), F.col("_hi")))).cast("bigint")
    # most masks of a block lie beside a span: those pairs end here and are not added up
    return joined.select(id_col, "value", shared.alias("_shared")).filter("_shared > 0").groupBy(id_col, "value").agg(F.sum("_shared").alias("n"))


def row_sums(cells: DataFrame, by: list[str], width: int = BLOCK) -> DataFrame:
    """Running sums along raster rows: per `by`, row and block of `width` columns, the arrays _c, _n and _s with width + 1 entries.

    Entry k holds the cells, the non-null ones and their total before column k of the block, so a stretch of
    columns is two lookups. Cells are shuffled once, by row and block; both groupings work on that.
    """
    at = F.pmod("col", F.lit(width)).cast("int").alias("_at")
    keyed = cells.select(*by, "row", intdiv("col", width).cast("int").alias("_block"), at, F.col("value").cast("double").alias("value"))
    keys = [*by, "row", "_block"]
    per_cell = (
        keyed.repartition(*keys)
        .groupBy(*keys, "_at")
        .agg(F.count(F.lit(1)).alias("c"), F.count("value").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("s"))
    )
    blocks = per_cell.groupBy(*keys).agg(F.collect_list(F.struct("_at", "c", "n", "s")).alias("_cells"))

    def running(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("_cells")
            cell = lists.flatten()
            place = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy()), cell.field("_at").to_numpy() + 1
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * (width + 1))
            out = []
            for name, kind in (("c", np.int64), ("n", np.int64), ("s", np.float64)):
                sums = np.zeros((len(batch), width + 1), kind)
                sums[place] = cell.field(name).to_numpy()
                out.append(pa.ListArray.from_arrays(ends, pa.array(sums.cumsum(axis=1).ravel())))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *out], names=[*keys, "_c", "_n", "_s"])

    types = dict(blocks.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return blocks.mapInArrow(running, f"{schema}, _c array<bigint>, _n array<bigint>, _s array<double>")


def tile_row_sums(tiles: DataFrame, by: list[str], width: int) -> DataFrame:
    """row_sums of stored tiles of `width` columns, whose rows already lie together: no shuffle. `by`: of layer, time_index and band."""
    from pyspark.sql import types as T

    unknown = set(by) - {"layer", "time_index", "band"}
    if unknown:
        raise ValueError(f"tiles have no {sorted(unknown)}")
    given = tiles.select("layer", "time_index", "tile_x", "tile_y", "cols", "rows", "bands")
    kinds = {"layer": T.StringType(), "time_index": T.LongType(), "band": T.IntegerType()}

    def running(batches):
        import numpy as np
        import pyarrow as pa

        names = [*by, "row", "_block", "_c", "_n", "_s"]
        for batch in batches:
            for tile in range(len(batch)):
                cols, rows = batch.column("cols")[tile].as_py(), batch.column("rows")[tile].as_py()
                if cols != width:
                    raise ValueError(f"a tile has {cols} columns, not {width}")
                top, block = batch.column("tile_y")[tile].as_py() * rows, batch.column("tile_x")[tile].as_py()
                for band, data in enumerate(batch.column("bands")[tile], 1):
                    there = np.asarray(data.values.is_valid()).reshape(rows, cols)
                    values = data.values.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(rows, cols)
                    ends = pa.array(np.arange(rows + 1, dtype=np.int32) * (cols + 1))

                    def lists(x, ends=ends, shape=(rows, cols)):
                        sums = np.zeros((shape[0], shape[1] + 1), x.dtype)
                        x.cumsum(axis=1, out=sums[:, 1:])
                        return pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))

                    own = {"layer": batch.column("layer")[tile].as_py(), "time_index": batch.column("time_index")[tile].as_py(), "band": band}
                    arrow = {"layer": pa.string(), "time_index": pa.int64(), "band": pa.int32()}
                    keys = [pa.array([own[k]] * rows, arrow[k]) for k in by]
                    place = [pa.array(np.arange(top, top + rows, dtype=np.int32)), pa.array(np.full(rows, block, np.int32))]
                    n = lists(there.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([*keys, *place, n, n, lists(values)], names=names)

    schema = T.StructType([T.StructField(k, kinds[k]) for k in by])
    schema = schema.add("row", T.IntegerType()).add("_block", T.IntegerType())
    for name, kind in (("_c", T.LongType()), ("_n", T.LongType()), ("_s", T.DoubleType())):
        schema = schema.add(name, T.ArrayType(kind))
    return given.mapInArrow(running, schema)


def _measured_pieces(aois: DataFrame, grid: Grid, width: int, id_col: str) -> dict:
    return measured(cut(_pieces(polygon_spans(aois, grid, id_col), width)), ["row", "_block"])


def mean_of_sums(
    sums: DataFrame, aois: DataFrame, grid: Grid, by: list[str], width: int = BLOCK, id_col: str = "aoi_id", pieces: dict | None = None
) -> DataFrame:
    """zonal_mean from running sums: a span is two lookups in each block it crosses, whatever its length."""
    pieces = pieces or _measured_pieces(aois, grid, width, id_col)
    joined = small_join(sums, pieces["table"], ["row", "_block"], [id_col, "_lo"], meets=MEETS, size=pieces)

    def between(name: str) -> Column:
        return F.get(name, F.col("_hi") + 1) - F.get(name, F.col("_lo"))

    added = joined.groupBy(id_col, *by).agg(
        F.sum(between("_c")).alias("_cells"), F.sum(between("_n")).alias("n"), F.sum(between("_s")).alias("_total")
    )
    some = F.col("n") > 0
    return added.filter("_cells > 0").select(
        id_col, *by, "n", F.when(some, F.col("_total")).alias("total"), F.when(some, F.col("_total") / F.col("n")).alias("mean")
    )


def zonal_mean(cells: DataFrame, aois: DataFrame, grid: Grid, by: list[str] | None = None, id_col: str = "aoi_id") -> DataFrame:
    """Count, total and mean of the non-null cells per polygon (and further keys), by running sums along raster rows.

    A total is a sum of differences of running sums within blocks of BLOCK columns: exact for whole numbers, else as near as
    sums of so many values are.
    """
    by = by or []
    pieces = _measured_pieces(aois, grid, BLOCK, id_col)
    return mean_of_sums(row_sums(within(cells, ["row"], pieces), by), aois, grid, by, BLOCK, id_col, pieces)


def zonal_mean_tiles(tiles: DataFrame, aois: DataFrame, grid: Grid, width: int, by: list[str] | None = None, id_col: str = "aoi_id") -> DataFrame:
    """zonal_mean of stored tiles of `width` columns; the tile arrays are not shuffled while the spans fit a broadcast."""
    by = by or []
    pieces = _measured_pieces(aois, grid, width, id_col)
    if pieces["rows"]:
        tiles = tiles.filter(F.col("tile_x").between(pieces["low__block"], pieces["high__block"]))
        tiles = tiles.filter(((F.col("tile_y") + 1) * F.col("rows") > pieces["low_row"]) & (F.col("tile_y") * F.col("rows") <= pieces["high_row"]))
    return mean_of_sums(tile_row_sums(tiles, by, width), aois, grid, by, width, id_col, pieces)


def _ones(lo: Column, hi: Column) -> Column:
    """A mask with the bits lo..hi set."""
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (F.lit(MASK_BITS - 1) - (hi - lo)).cast("int"))
    return F.call_function("shiftleft", ones, lo.cast("int"))


def polygon_mask(aois: DataFrame, grid: Grid, id_col: str = "aoi_id", by: list[str] | None = None) -> DataFrame:
    """One 64-bit mask per raster row and 64-column block, polygons combined (per `by` if given)."""
    spans = polygon_spans(aois, grid, id_col)
    block = F.explode(
        F.sequence(intdiv("c0", MASK_BITS).cast("int"), intdiv("c1", MASK_BITS).cast("int"))
    )
    lo = F.greatest(F.col("c0") - F.col("_block") * MASK_BITS, F.lit(0))
    hi = F.least(F.col("c1") - F.col("_block") * MASK_BITS, F.lit(MASK_BITS - 1))
    bits = _ones(lo, hi)
    return (
        spans.withColumn("_block", block)
        .groupBy(*(by or []), "row", "_block")
        .agg(F.bit_or(bits).alias("_mask"))
    )


def clip_to_aoi(cells: DataFrame, aois: DataFrame, grid: Grid, id_col: str = "aoi_id") -> DataFrame:
    """Cells outside every polygon become null; the extent stays.

    The join side has one row per row and block whatever the number of polygons, so no cell is
    duplicated.
    """
    mask = polygon_mask(aois, grid, id_col)
    bit = F.getbit(F.coalesce("_mask", F.lit(0).cast("bigint")), F.pmod("col", F.lit(MASK_BITS)))
    keyed = cells.withColumn("_block", intdiv("col", MASK_BITS).cast("int"))
    return (
        small_join(keyed, mask, ["row", "_block"], ["row"], "left")
        .withColumn("value", F.when(bit == 1, F.col("value")))
        .select(*cells.columns)
    )


def tile_masks(aois: DataFrame, grid: Grid | SlippyGrid, cols: int, rows: int, id_col: str = "aoi_id") -> DataFrame:
    """Polygons combined as one row per tile they reach: `_mask`, the 64-bit words (place, bits) of its rows, (cols + 63) // 64 words a row.

    Spans are cut at tile and word borders and or-ed with partial aggregation, so a tile collects at most its own words
    whatever the number of polygons.
    """
    words = -(-cols // MASK_BITS)
    pieces = _pieces(polygon_spans(aois, grid, id_col), cols)
    first, last = intdiv("_lo", MASK_BITS).cast("int"), intdiv("_hi", MASK_BITS).cast("int")
    start = F.col("_word") * MASK_BITS
    lo, hi = F.greatest(F.col("_lo") - start, F.lit(0)), F.least(F.col("_hi") - start, F.lit(MASK_BITS - 1))
    place = (F.pmod("row", F.lit(rows)) * words + F.col("_word")).cast("int")
    keys = [F.col("_block").alias("tile_x"), intdiv("row", rows).cast("int").alias("tile_y")]
    return (
        pieces.withColumn("_word", F.explode(F.sequence(first, last)))
        .groupBy(*keys, place.alias("place"))
        .agg(F.bit_or(_ones(lo, hi)).alias("bits"))
        .groupBy("tile_x", "tile_y")
        .agg(F.collect_list(F.struct("place", "bits")).alias("_mask"))
    )


def clip_tiles(tiles: DataFrame, aois: DataFrame, grid: Grid | SlippyGrid, cols: int, rows: int, id_col: str = "aoi_id") -> DataFrame:
    """clip_to_aoi of stored tiles of cols x rows cells: cells outside every polygon become null in the arrays, all tiles stay.

    The tiles of a SlippyGrid must be of its level. Only masks, one row per tile that a polygon reaches, meet the tiles; while they fit a
    broadcast no tile is shuffled, and no cell ever is. A tile or band of another size is an error; null bands stay null.
    """
    masks = tile_masks(aois, grid, cols, rows, id_col)
    words = -(-cols // MASK_BITS)
    met = small_join(tiles, masks, ["tile_x", "tile_y"], ["tile_x", "tile_y"], "left").select(*tiles.columns, "_mask")

    def masked(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute

        def lists(lengths, values):
            """A list array of the given lengths, null where the length is."""
            ends = np.concatenate([[0], np.cumsum(lengths.fill_null(0).to_numpy())]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), values, mask=lengths.is_null())

        for batch in batches:
            mask, outer = batch.column("_mask"), batch.column("bands")
            inner = outer.flatten()
            flat = inner.flatten()
            per_tile, per_band = outer.value_lengths(), inner.value_lengths()
            if set(per_band.drop_null().unique().to_pylist()) - {cols * rows}:
                raise ValueError(f"a band does not have {cols} x {rows} cells")
            entry = mask.flatten()
            bits = np.zeros((len(batch), rows * words), "<i8")
            owner = np.repeat(np.arange(len(batch)), mask.value_lengths().fill_null(0).to_numpy())
            bits[owner, entry.field("place").to_numpy()] = entry.field("bits").to_numpy()
            inside = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")
            inside = inside.reshape(len(batch), rows, words * MASK_BITS)[:, :, :cols].reshape(len(batch), rows * cols).astype(bool)
            tile_of_band = np.repeat(np.arange(len(batch)), per_tile.fill_null(0).to_numpy())
            keep = inside[tile_of_band[per_band.is_valid().to_numpy(zero_copy_only=False)]].ravel()
            kept = pa.compute.if_else(pa.array(keep), flat, pa.scalar(None, flat.type))
            clipped = lists(per_tile, lists(per_band, kept))
            names = [c for c in batch.schema.names if c != "_mask"]
            yield pa.RecordBatch.from_arrays([clipped if c == "bands" else batch.column(c) for c in names], names=names)

    return met.mapInArrow(masked, tiles.schema)


def kernel_density(
    points: DataFrame, grid: Grid, cols: int, rows: int, kernel: list[tuple[int, int, float]], weight: str = "weight"
) -> DataFrame:
    """Density grid: each point adds weight * kernel around its cell; cells outside drop out.

    Points are summed per cell first, so a crowded cell is spread to its neighbours once.
    """
    per_cell = (
        points.select(grid.col_of("lon").alias("col"), grid.row_of("lat").alias("row"), F.col(weight).alias("w"))
        .groupBy("col", "row")
        .agg(F.sum("w").alias("w"))
    )
    offsets = F.array(
        *[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(k)).alias("k")) for dx, dy, k in kernel if k]
    )
    return (
        per_cell.select("col", "row", "w", F.explode(offsets).alias("o"))
        .select(
            (F.col("col") + F.col("o.dx")).alias("col"),
            (F.col("row") + F.col("o.dy")).alias("row"),
            (F.col("w") * F.col("o.k")).alias("v"),
        )
        .filter(F.col("col").between(0, cols - 1) & F.col("row").between(0, rows - 1))
        .groupBy("col", "row")
        .agg(F.sum("v").alias("value"))
    )
