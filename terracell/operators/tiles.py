"""Map algebra on stored tiles, array against array.

Bands of one tile already lie in one row, so operations within a layer need no shuffle at all.
Two layers meet on the tile key: one row per tile instead of one per cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import normalized_difference, pick_bands, scale_offset

TilePart = tuple[DataFrame, int]

TILE_POSITION = ["zoom", "tile_x", "tile_y", "time_index", "cols", "rows"]


def one_layer(tiles: DataFrame) -> DataFrame:
    """tiles, with an error at run time where they hold more than one layer.

    The names are looked at by a scalar subquery of their own, of a stored layer its partition column only, so tiles are not shuffled.
    """
    several = tiles.select((F.min("layer") != F.max("layer")).alias("several")).scalar()
    error = F.raise_error(F.lit("tiles hold several layers: select one"))
    return tiles.withColumn("bands", F.when(several, error.cast(tiles.schema["bands"].dataType)).otherwise(F.col("bands")))


def _arrays(inputs: list[TilePart]) -> DataFrame:
    """One row per tile present in all inputs, with an array column a<i> per input.

    Inputs of one layer are read once; layers meet in inner joins on the tile key. A frame that holds several layers is an
    error, as it is for cells: its tiles of one key would come out as several under one name.
    """
    layers: list[tuple[DataFrame, list[int]]] = []
    for i, (layer, _band) in enumerate(inputs):
        for known, slots in layers:
            if known is layer:
                slots.append(i)
                break
        else:
            layers.append((layer, [i]))
    parts = [
        one_layer(layer).select(*TILE_POSITION, *[F.get("bands", F.lit(inputs[i][1] - 1)).alias(f"a{i}") for i in slots])
        for layer, slots in layers
    ]
    return reduce(lambda a, b: a.join(b, TILE_POSITION), parts)


def _result(rows: DataFrame, name: str, *bands: Column) -> DataFrame:
    return rows.select(
        F.lit(name).alias("layer"), "zoom", "tile_x", "tile_y", "time_index", "cols", "rows", F.array(*bands).alias("bands")
    )


def tile_select_bands(tiles: DataFrame, numbers: list[int]) -> DataFrame:
    return tiles.withColumn("bands", pick_bands("bands", numbers))


def tile_ndi(a: TilePart, b: TilePart, name: str = "ndi") -> DataFrame:
    """Normalized difference, cell by cell."""
    return _result(_arrays([a, b]), name, F.zip_with("a0", "a1", normalized_difference))


def tile_local_avg(inputs: list[TilePart], name: str = "avg") -> DataFrame:
    """Mean of n inputs over cells present in all of them."""
    rows = _arrays(inputs)
    total = reduce(lambda acc, i: F.zip_with(acc, f"a{i}", lambda x, y: x + y), range(1, len(inputs)), F.col("a0"))
    return _result(rows, name, F.transform(total, lambda v: v / len(inputs)))


def tile_map(tiles: DataFrame, function, name: str = "mapped") -> DataFrame:
    """A Column function applied to every cell of every band."""
    return tiles.withColumn("bands", F.transform("bands", lambda band: F.transform(band, function))).withColumn(
        "layer", F.lit(name)
    )


def tile_scale_offset(tiles: DataFrame, scale: float, offset: float) -> DataFrame:
    return tile_map(tiles, lambda v: scale_offset(v, F.lit(scale), F.lit(offset)), "scaled")


def tile_min_max(tiles: DataFrame) -> DataFrame:
    """Minimum and maximum per layer and band: two numbers per tile and band are grouped, not cells."""
    per_tile = tiles.select("layer", F.posexplode("bands").alias("pos", "data"))
    return per_tile.groupBy("layer", (F.col("pos") + 1).alias("band")).agg(
        F.min(F.array_min("data")).alias("min_value"), F.max(F.array_max("data")).alias("max_value")
    )
