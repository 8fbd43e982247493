"""Scenes arriving as files are covered and catalogued as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions._col import intdiv
from ..operators.cover import BLOCK, BOX, scene_tile_cover, tile_refs_of
from ..plans.joins import rebalance
from ..plans.storage import path_exists
from ..sources.catalog import SCENE_KEY, TILE_REF_KEY, in_z_order, stored_within, write_scenes, write_tile_catalog

#: what all catalog rows of a scene have in common
REF_SCENE = [*SCENE_KEY, "time_index"]
#: partitions of spans, each of which makes up to 64 catalog rows, are smaller by this than partitions of rows
SPANS_SMALLER = 8


def refs_once(scenes: DataFrame, levels: list[int] | None = None, path: str | None = None) -> DataFrame:
    """Catalog rows of the cover of scenes, one a key and none stored under path; by blocks and in Z order, as catalog files have them.

    A cover names no tile twice, so a key can only come twice where scenes share dataset, ingest and time, in the batch or with what is
    stored. This is found out on the scenes, which are few, and only tiles of such scenes are grouped and compared with what is stored.
    Tiles of the others are made from spans when these have been shuffled.
    """
    levels = levels and list(dict.fromkeys(levels))
    parts = [c for c in scenes.columns if c in (*REF_SCENE, *BOX, "ring", "rings", "sensor")]
    scenes = scenes.select(*parts)
    counted = scenes.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*REF_SCENE)))
    known = path is not None and path_exists(scenes.sparkSession, path)
    own = F.col("_same") == 1
    if known:
        stored = stored_within(scenes, path, REF_SCENE)
        counted = counted.join(stored.select(*REF_SCENE).distinct().withColumn("_seen", F.lit(True)), REF_SCENE, "left")
        own = own & F.col("_seen").isNull()
    alone, shared = (counted.filter(c).select(*parts) for c in (own, ~own))
    key = ["zoom", "tile_x", "tile_y"]
    tiles = scene_tile_cover(shared, levels).dropDuplicates([*REF_SCENE, *key])
    if known:
        names = dict(zip(("zoom_level", "spatial_index_x", "spatial_index_y"), key))
        tiles = tiles.join(stored.select(*TILE_REF_KEY).withColumnsRenamed(names), [*REF_SCENE, *key], "left_anti")
    blocks = {"_bx": intdiv("tile_x", BLOCK), "_by": intdiv("tile_y", BLOCK)}
    tiles = rebalance(tiles.withColumns(blocks), "dataset_id", "zoom", *blocks).drop(*blocks)
    cover = scene_tile_cover(alone, levels, together=["dataset_id"])
    placed, others = (tile_refs_of(in_z_order(c, *key)) for c in (cover, tiles))
    return placed.unionByName(others)


def stream_scene_ingest(
    scenes: DataFrame,
    catalog_path: str,
    checkpoint: str,
    levels: list[int] | None = None,
    scenes_path: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the ingest of a streaming scenes DataFrame (SCENES columns plus sensor).

    Scenes come in any order of acquisition: an archive may be delivered after the newest scene. There is therefore no
    watermark and no state; what was ingested before is known from the catalog, whose keys make a scene sent again and a batch
    replayed after a failure add nothing. With scenes_path the scene rows are stored, too, after their tiles.
    """
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    given = scenes.sparkSession.conf.get(size)
    small = f"{max(1, scenes.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(given) // SPANS_SMALLER)}b"

    def append(batch: DataFrame, _epoch: int) -> None:
        conf = batch.sparkSession.conf  # of the stream's own session
        conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # with the query that needed them
        conf.set(size, small)
        write_tile_catalog(refs_once(batch, levels, catalog_path), catalog_path, placed=True)
        conf.set(size, given)
        if scenes_path is not None:
            write_scenes(batch, scenes_path)

    writer = scenes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
