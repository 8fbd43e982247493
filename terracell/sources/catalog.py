"""Catalog tables: datasets, scenes, stored tiles, AOIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions._col import intdiv
from ..functions.geom import boxes_overlap
from ..functions.grid import z_parts
from ..operators.cover import BLOCK
from ..operators.series import time_range
from ..plans.joins import rebalance, small_join
from ..plans.storage import cut, path_exists
from ..schema import BAND_META

CATALOG_TABLES = ["datasets", "scenes", "tile_refs", "aois"]


def read_catalog(spark: SparkSession, path: str, tables: list[str] | None = None, fmt: str = "parquet", **options) -> dict[str, DataFrame]:
    """Catalog tables as lazy DataFrames from a folder of Parquet tables.

    For a database catalog pass fmt="jdbc" and its options; filters are then pushed into the
    database.
    """
    out = {}
    for name in tables or CATALOG_TABLES:
        reader = spark.read.format(fmt).options(**options)
        out[name] = reader.option("dbtable", name).load() if fmt == "jdbc" else reader.load(f"{path}/{name}")
    return out


def dataset_lookup(datasets: DataFrame, dataset_id: int | None = None, name: str | None = None) -> DataFrame:
    """The dataset with an id or a name; the lowest id where a name repeats."""
    if (dataset_id is None) == (name is None):
        raise ValueError("give either an id or a name")
    hit = F.col("dataset_id") == dataset_id if name is None else F.col("ds_name") == name
    return datasets.filter(hit).orderBy("dataset_id").limit(1)


def querable_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.filter("is_querable")


def with_dataset(rows: DataFrame, datasets: DataFrame, columns: list[str]) -> DataFrame:
    """Attach dataset columns. A stored dimension's size is known, so Spark broadcasts it if small."""
    return rows.join(datasets.select("dataset_id", *columns), "dataset_id")


def parse_band_meta(datasets: DataFrame, column: str = "band_meta") -> DataFrame:
    """One row per band: dataset_id, band (1-based), name, description, min, max.

    Accepts unquoted field names; malformed text gives no rows instead of an error.
    """
    parsed = F.from_json(
        F.col(column), BAND_META, {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "mode": "PERMISSIVE"}
    )
    return (
        datasets.select("dataset_id", F.posexplode(parsed).alias("pos", "m"))
        .filter(F.col("m").isNotNull())
        .select("dataset_id", (F.col("pos") + 1).alias("band"), "m.name", "m.description", "m.min", "m.max")
    )


def tile_point_lookup(tile_refs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored tile for each (dataset_id, zoom_level, z_index) asked for; the smallest path if several.

    The wanted key ranges prune the scan. Stored rows are reduced per key on the map side, so a key stored many
    times stays cheap.
    """
    keys = ["dataset_id", "zoom_level", "z_index"]
    hits = small_join(tile_refs, wanted.select(*keys).distinct(), keys, keys, "left_semi")
    return hits.groupBy(*keys).agg(F.min("file_path").alias("file_path"))


def scene_search(scenes: DataFrame, dataset_id: int | None, box: tuple[float, float, float, float], start=None, end=None) -> DataFrame:
    """Scenes of a dataset whose box meets a box, within a closed time range."""
    found = time_range(scenes, start, end)
    if dataset_id is not None:
        found = found.filter(F.col("dataset_id") == dataset_id)
    row = {k: F.col(k) for k in ("xmin", "ymin", "xmax", "ymax")}
    return found.filter(boxes_overlap(row, dict(zip(("xmin", "ymin", "xmax", "ymax"), box))))


def time_indexes(scenes: DataFrame, dataset_id: int | None = None, start=None, end=None) -> DataFrame:
    """Distinct (dataset_id, time_index), optionally of one dataset and within a range."""
    found = time_range(scenes, start, end)
    if dataset_id is not None:
        found = found.filter(F.col("dataset_id") == dataset_id)
    return found.select("dataset_id", "time_index").distinct()


def time_index_list(scenes: DataFrame) -> DataFrame:
    """Per dataset, each scene time and how many scenes have it."""
    return scenes.groupBy("dataset_id", "time_index").agg(F.count(F.lit(1)).alias("scenes"))


def sorted_time_indexes(scenes: DataFrame, dataset_id: int | None = None) -> DataFrame:
    return time_indexes(scenes, dataset_id).orderBy("dataset_id", "time_index")


def limit_one(df: DataFrame, *order) -> DataFrame:
    """The first row in a stated order."""
    return df.orderBy(*order).limit(1)


def latest_scenes(scenes: DataFrame, k: int = 1) -> DataFrame:
    """The k most recent scenes."""
    return scenes.orderBy(F.desc("time_index"), "ingest_id").limit(k)


def latest_scenes_by(scenes: DataFrame, by: list[str], k: int = 1) -> DataFrame:
    """The k most recent scenes per key. Each task keeps k per key before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("time_index"), F.col("ingest_id"))
    return scenes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


TILE_REF_KEY = ["dataset_id", "ingest_id", "zoom_level", "spatial_index_x", "spatial_index_y", "time_index"]
SCENE_KEY = ["dataset_id", "ingest_id"]
#: level 1 is quicker than 3 and makes Z keys in their order smaller
CATALOG_FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


def write_tile_catalog(tile_refs: DataFrame, path: str, once: bool = False, placed: bool = False) -> None:
    """Append catalog rows, clustered by Z key for point and range lookups.

    The key (dataset, ingest, zoom, x, y, time) is the identity; tile_id is a stable hash of it, so a task that runs
    twice gives the same id. A key is stored once, whether it comes twice in a batch, in two batches or in a
    replayed batch, and two ingests of one dataset and time both stay. `once` says that no key comes twice in tile_refs, `placed` that
    none of them is stored, either, and that the rows lie by blocks and in_z_order already.
    """
    rows = tile_refs
    if not placed:
        rows = append_new(rows, path, TILE_REF_KEY, once)
        blocks = {"_bx": intdiv("spatial_index_x", BLOCK), "_by": intdiv("spatial_index_y", BLOCK)}
        rows = in_z_order(rebalance(rows.withColumns(blocks), "dataset_id", "zoom_level", *blocks).drop(*blocks))
    # the id is a hash, which does not compress: it is made after the shuffle and the sort
    rows.withColumn("tile_id", F.xxhash64(*TILE_REF_KEY)).write.mode("append").options(**CATALOG_FILES).parquet(path)


def in_z_order(rows: DataFrame, zoom: str = "zoom_level", x: str = "spatial_index_x", y: str = "spatial_index_y") -> DataFrame:
    """Rows of each partition as a catalog file has them: by dataset, level and Z key."""
    # the two longs of the Z key sort as it does, without a decimal made for each comparison
    order = dict(zip(("_high", "_low"), z_parts("time_index", y, x)))
    return rows.withColumns(order).sortWithinPartitions("dataset_id", zoom, *order).drop(*order)


def write_scenes(scenes: DataFrame, path: str) -> None:
    """Append scene rows; a (dataset, ingest) already stored is left out."""
    rows = append_new(scenes, path, SCENE_KEY)
    rebalance(rows, "dataset_id").sortWithinPartitions(*SCENE_KEY).write.mode("append").parquet(path)


def append_new(rows: DataFrame, path: str, key: list[str], once: bool = False) -> DataFrame:
    """Rows whose key is not stored yet, one a key; `once` says that no key comes twice in rows, so that they need not be grouped.

    The batch is computed once. Its key ranges, one row, are handed to the scan of what is stored, so an
    append reads the parts of the table that can hold its keys and not the whole table.
    """
    spark = rows.sparkSession
    rows = rows if once else rows.dropDuplicates(key)
    if not path_exists(spark, path):
        return rows
    rows = cut(rows)
    return rows.join(stored_within(rows, path, key).select(*key), key, "left_anti").select(*rows.columns)


def stored_within(rows: DataFrame, path: str, key: list[str]) -> DataFrame:
    """What is stored, within the ranges that rows have of each column of a key; rows are read once for them."""
    ends = rows.agg(*[f(c).alias(f"{name}_{c}") for c in key for name, f in (("low", F.min), ("high", F.max))]).first()
    stored = rows.sparkSession.read.parquet(path)
    for c in key:
        if ends[f"low_{c}"] is not None:
            stored = stored.filter(F.col(c).between(ends[f"low_{c}"], ends[f"high_{c}"]))
    return stored
