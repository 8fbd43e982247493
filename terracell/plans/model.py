"""An operation graph over named layers, applied in list order, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.algebra import local_avg, ndi
from ..operators.cover import aoi_tile_refs
from ..operators.layout import SlippyGrid, select_bands, tiles_to_cells
from ..operators.series import savgol
from ..operators.tiles import tile_local_avg, tile_ndi, tile_select_bands
from ..operators.tilestack import tile_savgol
from ..operators.zonal import clip_tiles
from ..functions.grid import MAX_ZOOM
from .joins import small_join

#: names under which each operation may be asked for
ALIASES = {
    "op_ndi": "ndi",
    "op_normalized_difference": "ndi",
    "NDI": "ndi",
    "ndi": "ndi",
    "op_local_avg": "local_avg",
    "local_avg": "local_avg",
    "op_savgol": "savgol",
    "savgol": "savgol",
}


def _tiled(inputs) -> bool:
    """Whether all inputs are tile layers; mixed inputs are met as cells."""
    return all("bands" in layer.columns for layer, _ in inputs)


def _as_cells(inputs):
    seen: dict[int, DataFrame] = {}
    out = []
    for layer, band in inputs:
        if "bands" in layer.columns:  # the same frame stays one frame, so that it is read once
            layer = seen.setdefault(id(layer), tiles_to_cells(layer))
        out.append((layer, band))
    return out


def _ndi(inputs, spec):
    if len(inputs) != 2:
        raise ValueError("a normalized difference takes two inputs")
    return tile_ndi(*inputs) if _tiled(inputs) else ndi(*_as_cells(inputs))


def _local_avg(inputs, spec):
    return tile_local_avg(inputs) if _tiled(inputs) else local_avg(_as_cells(inputs))


def _savgol(inputs, spec):
    if len(inputs) != 1:
        raise ValueError("smoothing takes one input")
    if _tiled(inputs):
        layer, band = inputs[0]
        picked = layer if band is None else tile_select_bands(layer, [band])
        return tile_savgol(picked, spec.get("window", 5), spec.get("degree", 2))
    layer, band = _as_cells(inputs)[0]
    picked = layer if band is None else select_bands(layer, [band])
    return savgol(picked, spec.get("window", 5), spec.get("degree", 2))


OPERATIONS = {"ndi": _ndi, "local_avg": _local_avg, "savgol": _savgol}


def _reference(ref: dict) -> tuple[str, int | None]:
    name = ref.get("id", ref.get("layer"))
    if name is None:
        raise ValueError("an input needs an id or a layer")
    return name, ref.get("band")


def run_model(spec: dict, layers: dict[str, DataFrame]) -> DataFrame:
    """Apply spec["operations"] in order and return the layer named by spec["output"]["id"].

    Each operation reads its inputs by id, with a 1-based band, and binds its output id. An
    unknown operation or id is an error. Layers may be cells or tiles; operations whose inputs are
    all tiles work array against array, without shuffling cells.
    """
    bound = dict(layers)
    for op in spec["operations"]:
        kind = ALIASES.get(op["type"])
        if kind is None:
            raise ValueError(f"unknown operation {op['type']}")
        inputs = []
        for ref in op["inputs"]:
            name, band = _reference(ref)
            if name not in bound:
                raise KeyError(f"unknown input {name}")
            if band is None and kind != "savgol":
                band = 1
            inputs.append((bound[name], band))
        bound[op.get("output", {}).get("id", op.get("id"))] = OPERATIONS[kind](inputs, op)
    wanted = spec["output"]["id"]
    if wanted not in bound:
        raise KeyError(f"unknown output {wanted}")
    return bound[wanted]


def process_inputs(
    inputs: list[dict],
    aois: DataFrame,
    datasets: DataFrame,
    tile_refs: DataFrame,
    tiles: DataFrame,
    level: int = MAX_ZOOM,
    as_tiles: bool = False,
    clip: bool = False,
    size: int = 256,
) -> dict[str, DataFrame]:
    """Named inputs (id, aoiCode, dsName, tIndexes) to layers of cells, or of tiles.

    All listed times are read and stay apart by time_index. Cells keep global coordinates. Tiles are matched by dataset_id
    where they have that column, else by the dataset's name as their layer. The tile keys under each area are
    computed while the inputs are bound; the layers themselves are lazy. With clip, cells outside the area's polygon (`ring` or
    `rings` of aois) are nulled in the arrays of the tiles, which then must have size x size cells.
    """
    shape = [c for c in ("ring", "rings") if c in aois.columns]
    if clip and not shape:
        raise ValueError("clipping needs the areas' ring or rings")
    out = {}
    for spec in inputs:
        area = aois.filter(F.col("aoi_code") == spec["aoiCode"]).select("aoi_id", "xmin", "ymin", "xmax", "ymax", *shape)
        named = tile_refs.join(datasets.filter(F.col("ds_name") == spec["dsName"]).select("dataset_id"), "dataset_id")
        refs = aoi_tile_refs(area, named, level, times=spec.get("tIndexes"))
        keys = refs.select(
            F.col("dataset_id"),
            F.col("zoom_level").alias("zoom"),
            F.col("spatial_index_x").alias("tile_x"),
            F.col("spatial_index_y").alias("tile_y"),
            "time_index",
        )
        stored = tiles.filter(F.col("zoom") == level)
        if "dataset_id" not in tiles.columns:
            stored = stored.filter(F.col("layer") == spec["dsName"])
        if spec.get("tIndexes") is not None:
            stored = stored.filter(F.col("time_index").isin(spec["tIndexes"]))
        join_on = [c for c in keys.columns if c in tiles.columns]
        wanted = keys.select(*join_on).distinct()
        found = small_join(stored, wanted, join_on, join_on, "left_semi")
        if clip:
            found = clip_tiles(found, area, SlippyGrid(level, size, size), size, size)
        out[spec["id"]] = found if as_tiles else tiles_to_cells(found)
    return out
