"""Layers, scenes, AOIs and points derived from the given tables; all of them grow with the tables.

Coordinates are whole multiples of powers of two, so box and centre comparisons are exact.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions._col import intdiv
from terracell.functions.grid import box_ring
from terracell.functions.timeindex import ts_to_time_index
from terracell.operators.cover import scene_tile_cover, tile_refs_of
from terracell.operators.layout import Grid, cells_to_tiles, wide_to_cells
from terracell.plans.storage import scratch_path

WIDTH = 64
STEP = 864000  # ten days in seconds
GRID = Grid(68.0, 36.0, 0.03125, 0.03125)
TILE = 16
BANDS = ["b1", "b2", "b3", "b4", "b5"]


class Fixture:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)

    @cached_property
    def wide(self) -> DataFrame:
        """One row per pixel and time: quantity, lines, price cents, discount and tax in percent."""
        pixel = intdiv("l_orderkey", 4)

        def whole(column):
            return F.sum(F.round(F.col(column) * 100).cast("bigint"))

        return (
            self.table("lineitem")
            .groupBy(
                F.lit("lineitem").alias("layer"),
                ((F.col("l_linenumber") - 1).cast("bigint") * STEP).alias("time_index"),
                F.pmod(pixel, F.lit(WIDTH)).cast("int").alias("col"),
                intdiv(pixel, WIDTH).cast("int").alias("row"),
            )
            .agg(
                F.sum(F.col("l_quantity").cast("bigint")).alias("b1"),
                F.count(F.lit(1)).alias("b2"),
                whole("l_extendedprice").alias("b3"),
                whole("l_discount").alias("b4"),
                whole("l_tax").alias("b5"),
            )
        )

    @cached_property
    def cells(self) -> DataFrame:
        return wide_to_cells(self.wide, BANDS)

    @cached_property
    def tiles(self) -> DataFrame:
        return cells_to_tiles(self.cells, TILE, len(BANDS))

    @cached_property
    def scenes(self) -> DataFrame:
        size = 0.25 + F.pmod("o_custkey", F.lit(4)) / 16
        xmin = 67.5 + F.pmod(F.col("o_orderkey") * 37, F.lit(160)) / 64
        ymin = 35.75 - F.col("o_orderkey") / 8192
        return self.table("orders").select(
            F.col("o_orderkey").alias("ingest_id"),
            F.pmod("o_custkey", F.lit(10)).alias("dataset_id"),
            ts_to_time_index("o_orderdate").alias("time_index"),
            xmin.alias("xmin"),
            ymin.alias("ymin"),
            (xmin + size).alias("xmax"),
            (ymin + size).alias("ymax"),
        )

    @cached_property
    def ring_scenes(self) -> DataFrame:
        """Even ids are boxes, odd ids diamonds on the box's edge midpoints."""
        return self.scenes.withColumn(
            "ring",
            F.when(F.col("ingest_id") % 2 == 0, box_ring("xmin", "ymin", "xmax", "ymax")).otherwise(self._diamond()),
        )

    @staticmethod
    def _diamond():
        cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
        corners = [(F.col("xmin"), cy), (cx, F.col("ymax")), (F.col("xmax"), cy), (cx, F.col("ymin")), (F.col("xmin"), cy)]
        return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])

    @cached_property
    def aois(self) -> DataFrame:
        size = (2 + F.col("c_nationkey") % 8) / 32
        xmin = 68.0 + F.pmod(F.col("c_custkey") * 37, F.lit(56)) / 32
        ymin = 35.875 - F.col("c_custkey") / 1024
        return (
            self.table("customer")
            .select(
                F.col("c_custkey").alias("aoi_id"),
                F.col("c_name").alias("aoi_code"),
                xmin.alias("xmin"),
                ymin.alias("ymin"),
                (xmin + size).alias("xmax"),
                (ymin + size).alias("ymax"),
            )
            .withColumn("ring", self._diamond())
        )

    @cached_property
    def points(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("point_id"),
            (68.0 + F.pmod(F.col("event_id") * 31, F.lit(2048)) / 1024).alias("lon"),
            (35.9990234375 - F.col("event_id") / 8192).alias("lat"),
            F.floor("value").cast("double").alias("weight"),
        )

    @cached_property
    def datasets(self) -> DataFrame:
        entry = "[{name:\"n%s\",description:\"band one\",min:0,max:%s},{name:\"m%s\",description:\"band two\",min:1,max:2}"
        whole = F.format_string(entry, "s_suppkey", F.col("s_nationkey"), "s_suppkey")
        return self.table("supplier").select(
            F.col("s_suppkey").alias("dataset_id"),
            F.col("s_name").alias("ds_name"),
            F.lit(5).alias("no_of_bands"),
            ((1 + F.col("s_nationkey") % 4) / 64).alias("scale_factor"),
            ((F.col("s_nationkey") % 5) / 8).alias("value_offset"),
            (F.col("s_suppkey") % 2 == 0).alias("is_querable"),
            F.when(F.col("s_suppkey") % 7 == 3, whole).otherwise(F.concat(whole, F.lit("]"))).alias("band_meta"),
        )

    @cached_property
    def tile_refs(self) -> DataFrame:
        cover = scene_tile_cover(self.scenes).withColumn("sensor", F.concat(F.lit("S"), "dataset_id"))
        return tile_refs_of(cover)
