"""Finding of round 4: the stream's ingest fills the disk. Its tiles are made after the shuffle, and a later batch is not written out to be compared."""

import glob
import math
import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from terracell.operators import cover
from terracell.plans.storage import checkpoint_dir
from terracell.sources import catalog
from terracell.streaming.ingest import refs_once, stream_scene_ingest

SCENE = "ingest_id long, dataset_id long, time_index long, xmin double, ymin double, xmax double, ymax double, sensor string"
KEY = ["zoom", "tile_x", "tile_y"]


def scenes_of(spark, boxes):
    rows = [(i, None if i % 5 == 4 else i % 3, None if i % 7 == 6 else 700000000 + i, *box, f"S{i % 2}") for i, box in enumerate(boxes)]
    return spark.createDataFrame(rows, SCENE)


def counts(df):
    return sorted(map(str, df.groupBy(*df.columns).count().collect()))


def test_spans_make_the_tiles_of_the_cover(spark):
    inf, nan = math.inf, math.nan
    boxes = [
        (90.0, 25.0, 90.3, 25.3), (-180.0, -85.06, 180.0, 85.06), (0.0, 0.0, 0.0, 0.0), (22.5, 0.0, 45.0, 21.943045533438177), (-180.0, -90.0, -179.9, 90.0),
        (179.9, 84.0, 180.0, 90.0), (10.0, 86.0, 11.0, 88.0), (10.0, -89.0, 11.0, -86.0), (179.0, 10.0, -179.0, 11.0), (10.1, 11.0, 10.0, 10.9),
        (10.0, 11.0, 11.0, 3.0), (None, 1.0, 2.0, 3.0), (1.0, None, 2.0, 3.0), (1.0, 1.0, None, 3.0), (1.0, 1.0, 2.0, None), (22.5, 0.0, nan, 5.0),
        (nan, 0.0, 5.0, 5.0), (0.0, nan, 5.0, 5.0), (0.0, 0.0, 5.0, nan), (-inf, -inf, -170.0, inf), (170.0, 0.0, inf, 5.0), (-500.0, 0.0, -400.0, 5.0), (400.0, 0.0, 500.0, 5.0),
    ]
    step = 360 / 2**7
    boxes += [(n * step - 180, 10.0 + n, (n + 3 + n % 9) * step - 180, 10.0 + n + n % 4 * 5.6) for n in range(60)]
    scenes = scenes_of(spark, boxes)
    for levels in ([0, 1, 4], [7, 8]):
        want = cover.scene_tile_cover(scenes, levels)
        got = cover.scene_tile_cover(scenes, levels, together=["dataset_id"])
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert counts(got) == counts(want)


def test_spans_of_footprints_make_the_tiles_of_the_cover(spark):
    scenes = scenes_of(spark, [(88.0 + i, 20.0, 91.0 + i, 24.0) for i in range(4)])

    def ring(*points):
        return F.array(*[F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in points])

    comb = ring((88, 20), (88, 24), (88.4, 24), (88.4, 20.5), (89.5, 20.5), (89.5, 24), (91, 24), (91, 20), (88, 20))
    square = ring((88.2, 20.2), (88.2, 22), (90, 22), (90, 20.2), (88.2, 20.2))
    forms = {
        "ring": scenes.withColumn("ring", F.when(F.col("ingest_id") != 2, comb)),
        "rings": scenes.withColumn("rings", F.when(F.col("ingest_id") != 3, F.array(comb, square))),
    }
    for name, given in forms.items():
        want = cover.scene_tile_cover(given, [4, 9, 10])
        got = cover.scene_tile_cover(given, [4, 9, 10], together=["dataset_id"])
        assert got.columns == want.columns and want.count() > 300, name
        assert counts(got) == counts(want), name


def test_a_span_is_bounded_and_stays_in_its_block(spark):
    scenes = scenes_of(spark, [(-180.0, -80.0, 180.0, 80.0), (90.0, 25.0, 95.3, 30.3)])
    spans = cover.cover_spans(scenes, [7])
    rows = cover.span_tiles(spans.withColumn("b", F.col("_block")).withColumn("s", F.monotonically_increasing_id()))
    assert rows.groupBy("s").count().agg(F.max("count")).first()[0] == cover.SPAN**2
    blocks = rows.select("b", "zoom", F.floor(F.col("tile_x") / cover.BLOCK).alias("x"), F.floor(F.col("tile_y") / cover.BLOCK).alias("y")).distinct()
    assert blocks.count() == blocks.select("b").distinct().count() == 4


def test_spans_are_shuffled_and_not_tiles(spark):
    scenes = scenes_of(spark, [(90.0 + i, 25.0, 90.3 + i, 25.3) for i in range(6)])
    alone = refs_once(scenes, [8, 9])._jdf.queryExecution().optimizedPlan().children().apply(0)
    text = alone.toString()
    shuffle = text.index("RebalancePartitions")
    assert "tile_x" in text[:shuffle] and "Sort " in text[:shuffle]
    assert "tile_x" not in text[shuffle:] and "_span" in text[shuffle:]
    assert text.count("Rebalance") == 1 and "Repartition" not in text


def stored_rows(spark, path):
    return sorted(map(str, spark.read.parquet(path).select("tile_id", *catalog.TILE_REF_KEY, "z_index", "file_path").collect()))


def ingest(spark, inbox, store, state, levels):
    arriving = spark.readStream.schema(SCENE).parquet(inbox)
    stream_scene_ingest(arriving, store, state, levels).awaitTermination()


def test_batches_meet_what_is_stored_by_scene(spark, tmp_path):
    inbox, store, state, want = (str(tmp_path / n) for n in ("in", "store", "state", "want"))
    scenes = scenes_of(spark, [(90.0 + i / 3, 25.0, 90.3 + i / 3, 25.3) for i in range(12)]).fillna(0)
    half = cover.tile_refs_of(cover.scene_tile_cover(scenes.filter("ingest_id < 3"), [8])).filter("spatial_index_x % 2 = 0")
    catalog.write_tile_catalog(half, store)  # as an ingest that was cut short leaves them: some tiles of a scene
    scenes.filter("ingest_id < 6").write.parquet(inbox)
    ingest(spark, inbox, store, state, [8, 9])
    scenes.filter("ingest_id between 4 and 9").withColumn("xmax", F.col("xmax") + 1).write.mode("append").parquet(inbox)  # two have other boxes now
    ingest(spark, inbox, store, state, [8, 9])
    moved = scenes.filter("ingest_id between 4 and 9").withColumn("xmax", F.col("xmax") + 1)
    catalog.write_tile_catalog(cover.tile_refs_of(cover.scene_tile_cover(scenes.filter("ingest_id < 6").unionByName(moved), [8, 9])), want)
    assert stored_rows(spark, store) == stored_rows(spark, want)


def test_a_later_batch_is_not_written_out_to_be_compared(spark, tmp_path):
    inbox, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    scenes = scenes_of(spark, [(90.0 + i / 3, 25.0, 90.3 + i / 3, 25.3) for i in range(12)])
    checkpoints = checkpoint_dir(spark).removeprefix("file:")

    def kept():
        return {f for f in glob.glob(f"{checkpoints}/**/part-*", recursive=True) if os.path.getsize(f) > 0}

    before = kept()
    for part in ("ingest_id < 6", "ingest_id >= 6"):
        scenes.filter(part).write.mode("append").parquet(inbox)
        ingest(spark, inbox, store, state, [8, 9])
    assert kept() == before
    assert spark.read.parquet(store).count() == cover.scene_tile_cover(scenes, [8, 9]).count()


def test_files_of_a_catalog_have_one_order_of_columns(spark, tmp_path):
    path = str(tmp_path / "refs")
    refs = cover.tile_refs_of(cover.scene_tile_cover(scenes_of(spark, [(90.0 + i, 25.0, 90.3 + i, 25.3) for i in range(6)]), [7, 8]))
    catalog.write_tile_catalog(refs.filter("zoom_level = 7"), path)
    catalog.write_tile_catalog(refs, path)
    orders = {tuple(pq.read_schema(f).names) for f in glob.glob(f"{path}/*.parquet")}
    assert orders == {(*refs.columns, "tile_id")}


def test_catalog_files_are_compressed(spark, fx, tmp_path):
    path = str(tmp_path / "refs")
    catalog.write_tile_catalog(fx.tile_refs.filter("zoom_level = 8"), path)
    files = [pq.read_metadata(f).row_group(0) for f in glob.glob(f"{path}/*.parquet")]
    assert files and {f.column(n).compression for f in files for n in range(f.num_columns)} == {"ZSTD"}


def test_settings_stay_in_the_streams_session(spark, tmp_path):
    inbox, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    before = [spark.conf.get(n) for n in names]
    scenes_of(spark, [(90.0, 25.0, 90.3, 25.3)]).write.parquet(inbox)
    ingest(spark, inbox, store, state, [8])
    assert [spark.conf.get(n) for n in names] == before
