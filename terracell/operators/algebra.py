"""Map algebra over cells.

Inputs are (layer DataFrame, band) pairs. Inputs that come from the same DataFrame are read
in one scan and met by one grouping; different layers meet in one union and grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import normalized_difference, normalized_percent
from .halo import BLOCK, blocks_of_cells, blocks_of_tiles, exchanged, weighted, window

POSITION = ["time_index", "col", "row"]

BandRef = tuple[DataFrame, int]


def _tagged(inputs: list[BandRef]) -> DataFrame:
    """All inputs as (position, slot, value); inputs of one layer share a scan."""
    by_layer: list[tuple[DataFrame, dict[int, list[int]]]] = []
    for slot, (layer, band) in enumerate(inputs):
        for known, bands in by_layer:
            if known is layer:
                bands.setdefault(band, []).append(slot)
                break
        else:
            by_layer.append((layer, {band: [slot]}))
    parts = []
    for layer, bands in by_layer:
        kept = layer.filter(F.col("band").isin(list(bands)))
        slots = F.lit(None).cast("array<int>")
        for band, numbers in bands.items():
            slots = F.when(F.col("band") == band, F.array(*[F.lit(n) for n in numbers])).otherwise(slots)
        if all(len(n) == 1 for n in bands.values()):
            slot = F.lit(None).cast("int")
            for band, numbers in bands.items():
                slot = F.when(F.col("band") == band, F.lit(numbers[0])).otherwise(slot)
            parts.append(kept.select(*POSITION, slot.alias("slot"), "value"))
        else:
            parts.append(kept.select(*POSITION, F.explode(slots).alias("slot"), "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: inputs that one long of `_seen` has a bit for
WORD = 62


def _seen(n: int) -> list[Column]:
    """Aggregates _rows and _seen0..: the rows of a position, and which of its n inputs they come from, a bit each."""
    slot = F.col("slot")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(WORD)))
    words = [F.bit_or(F.when(slot.between(w, w + WORD - 1), bit).otherwise(F.lit(0).cast("bigint"))) for w in range(0, n, WORD)]
    return [F.count(F.lit(1)).alias("_rows"), *(word.alias(f"_seen{w}") for w, word in enumerate(words))]


def _slots_seen(n: int) -> Column:
    """How many inputs a position has rows of."""
    words = [F.bit_count(f"_seen{w}") for w in range(-(-n // WORD))]
    return sum(words[1:], words[0])


def _once(n: int) -> Column:
    """True, or an error where an input has two rows at a position: several layers in a frame, or unmerged scenes."""
    twice = F.raise_error(F.lit("an input has two values for one position and band: select one layer, or mosaic first"))
    return F.when(F.col("_rows") > _slots_seen(n), twice.cast("boolean")).otherwise(True)


def align(inputs: list[BandRef], inner: bool = True) -> DataFrame:
    """One row per position with columns v0..vn-1, one per input.

    With inner, only positions present in every input remain. A cell whose value is null is
    present; its column is null.
    """
    n = len(inputs)
    picks = [F.max(F.when(F.col("slot") == i, F.col("value"))).alias(f"v{i}") for i in range(n)]
    rows = _tagged(inputs).groupBy(*POSITION).agg(*picks, *_seen(n)).filter(_once(n))
    if inner:
        rows = rows.filter(_slots_seen(n) == n)
    return rows.select(*POSITION, *[f"v{i}" for i in range(n)])


def _as_layer(rows: DataFrame, value: Column, name: str, band: int = 1) -> DataFrame:
    return rows.select(
        F.lit(name).alias("layer"),
        *POSITION,
        F.lit(band).alias("band"),
        value.cast("double").alias("value"),
    )


def join_layers(a: BandRef, b: BandRef) -> DataFrame:
    """Two layers aligned by position: columns v0 and v1."""
    return align([a, b])


def ndi(a: BandRef, b: BandRef, name: str = "ndi") -> DataFrame:
    """Normalized difference of two inputs, as band 1 of a new layer."""
    return _as_layer(align([a, b]), normalized_difference("v0", "v1"), name)


def ndi_percent(a: BandRef, b: BandRef, nodata: int = -99) -> DataFrame:
    """Normalized difference in whole percent, with a NoData code."""
    return align([a, b]).select(*POSITION, normalized_percent("v0", "v1", nodata).alias("value"))


def local_avg(inputs: list[BandRef], name: str = "avg", skip_missing: bool = False) -> DataFrame:
    """Cell-wise mean of n inputs.

    By default over positions present in all inputs; with skip_missing the mean of what is there. An input with two
    values for a position is an error, whatever the other inputs have there.
    """
    n = len(inputs)
    sums = [F.sum("value").alias("_s"), F.count("value").alias("_k")]
    grouped = _tagged(inputs).groupBy(*POSITION).agg(*sums, *_seen(n)).filter(_once(n))
    if skip_missing:
        return _as_layer(grouped, F.when(F.col("_k") > 0, F.col("_s") / F.col("_k")), name)
    whole = grouped.filter(_slots_seen(n) == n)
    return _as_layer(whole, F.when(F.col("_k") == n, F.col("_s") / n), name)


def mosaic(cells: DataFrame, priority: str | Column, ascending: bool = True, keys: list[str] | None = None) -> DataFrame:
    """One value per key from overlapping inputs: the best priority among non-null values."""
    keys = keys or ["time_index", "col", "row", "band"]
    rank = F.col(priority) if isinstance(priority, str) else priority
    pick = F.min_by if ascending else F.max_by
    present = F.when(F.col("value").isNotNull(), rank)
    return cells.groupBy(*keys).agg(pick(F.col("value"), present).alias("value"))


def merge_layers(layers: list[DataFrame], name: str = "merged", first_wins: bool = True) -> DataFrame:
    """Mosaic of whole layers in list order."""
    tagged = [l.withColumn("_p", F.lit(i)) for i, l in enumerate(layers)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    merged = mosaic(out, "_p", ascending=first_wins)
    return merged.select(F.lit(name).alias("layer"), "time_index", "col", "row", "band", "value")


def fill_empty(wanted: DataFrame, cells: DataFrame, keys: list[str], value: float = 0.0) -> DataFrame:
    """Every wanted key with its cell value, or a constant where no cell is stored; a stored null stays null."""
    stored = cells.select(*keys, "value", F.lit(True).alias("_stored"))
    filled = F.when(F.col("_stored"), F.col("value")).otherwise(F.lit(value))
    return wanted.join(stored, keys, "left").withColumn("value", filled).drop("_stored")


def raster_calc(cells: DataFrame, expression: str, bands: list[int], name: str = "calc") -> DataFrame:
    """A Spark SQL expression over columns b<n>, as band 1 of a new layer; two values for a position and band are an error."""
    wide = align([(cells, b) for b in bands], inner=False)
    return _as_layer(wide.withColumnsRenamed({f"v{i}": f"b{b}" for i, b in enumerate(bands)}), F.expr(expression), name)


def focal(
    cells: DataFrame, kernel: list[tuple[int, int, float]], name: str | None = None, normalise: bool = False, block: int = BLOCK
) -> DataFrame:
    """Moving-window weighted sum, layer by layer; kernel lists (dx, dy, weight) of a cell's neighbours.

    Cells are brought together in blocks, once, and summed on arrays; only partial sums along the blocks' borders are exchanged
    (see halo). Only positions that hold a cell get a result; missing neighbours drop out, and with normalise the rest is divided by
    the weights present (null where they cancel). The result keeps its layer's name, or all get `name`. A cell given twice is an error.
    """
    return _focal(blocks_of_cells(cells, block), kernel, name, normalise)


def focal_tiles(tiles: DataFrame, kernel: list[tuple[int, int, float]], name: str | None = None, normalise: bool = False) -> DataFrame:
    """focal of stored tiles, as cells: the tiles' arrays stay where they are and only border sums are shuffled."""
    return _focal(blocks_of_tiles(tiles), kernel, name, normalise)


def _focal(blocks: DataFrame, kernel: list[tuple[int, int, float]], name: str | None, normalise: bool) -> DataFrame:
    found = exchanged(blocks, window(kernel)).filter("own")
    value = weighted(F.col("s"), F.col("w"), F.col("size")) if normalise else F.col("s")
    layer = F.col("layer") if name is None else F.lit(name)
    return found.select(layer.alias("layer"), "time_index", F.col("i").alias("col"), F.col("j").alias("row"), "band", value.alias("value"))


def band_min_max(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Minimum and maximum per layer and band (or other keys), nulls ignored."""
    return cells.groupBy(*(by or ["layer", "band"])).agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("value").alias("n")
    )
