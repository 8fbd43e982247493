"""Skew, plans and sinks: the properties that matter at size."""

import json

import pytest
from pyspark.sql import functions as F

import checks
from checks.fixture import GRID
from terracell.operators import cover, layout, render, series
from terracell.plans import joins
from terracell.sources import catalog, layers, rasters
from terracell.streaming.ingest import stream_scene_ingest

from .conftest import SMALL
from .test_golden import cells_of


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_skew_join_equals_plain_join(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    other = spark.range(60).select((F.col("id") % 55).alias("k"), F.col("id").alias("o"))
    for how in ("inner", "left", "left_semi"):
        plain = big.join(other, "k", how)
        spread = joins.skew_join(big, other, ["k"], ["id"], how, rows_per_task=100)
        assert sorted(map(tuple, spread.select(plain.columns).fillna(-1).collect())) == sorted(map(tuple, plain.fillna(-1).collect()))


def test_skew_join_spreads_the_hot_key(spark):
    big = spark.range(4000).select(F.lit(7).alias("k"), "id")
    other = spark.createDataFrame([(7, "x")], "k int, o string")
    joined = joins.skew_join(big, other, ["k"], ["id"], rows_per_task=100, multiplies=True)
    assert joined.count() == 4000
    assert joined.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_summary_join_beyond_the_broadcast_bound(spark):
    big = spark.range(2000).select((F.col("id") % 300).alias("k"), "id")
    summary = big.groupBy("k").agg(F.max("id").alias("top"))
    small = joins.summary_join(big, summary, ["k"])
    salted = joins.summary_join(big, summary, ["k"], max_rows=10)
    assert "BroadcastHashJoin" in plan_of(small)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, salted.select(small.columns).collect()))


def test_small_join_beyond_the_broadcast_bound(spark):
    big = spark.range(2000).select((F.col("id") % 300).alias("k"), "id")
    small = spark.range(500).select((F.col("id") % 350).alias("k"), F.col("id").alias("o"))
    for how in ("inner", "left", "left_semi"):
        near = joins.small_join(big, small, ["k"], ["o"], how)
        far = joins.small_join(big, small, ["k"], ["o"], how, max_rows=10)
        rows = lambda df: sorted(map(tuple, df.select(near.columns).fillna(-1).collect()))
        assert rows(near) == rows(far)


def test_box_join_equals_brute_force(spark):
    a = spark.range(300).select(
        "id", ((F.col("id") * 37 % 100) / 10).alias("xmin"), ((F.col("id") * 53 % 90) / 10).alias("ymin")
    ).withColumns({"xmax": F.col("xmin") + F.col("id") % 7 / 4, "ymax": F.col("ymin") + F.col("id") % 5 / 4})
    b = a.select((F.col("id") * 2).alias("o"), *[F.col(c).alias(f"b_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    got = sorted((r["id"], r["o"]) for r in joins.box_join(a, b, ["id"]).collect())
    shuffled = joins.box_join(a, b, ["id"], rows_per_task=20, max_rows=5)
    assert sorted((r["id"], r["o"]) for r in shuffled.collect()) == got
    rows_a, rows_b = a.collect(), b.collect()
    want = sorted(
        (x["id"], y["o"])
        for x in rows_a
        for y in rows_b
        if x["xmin"] <= y["b_xmax"] and x["xmax"] >= y["b_xmin"] and x["ymin"] <= y["b_ymax"] and x["ymax"] >= y["b_ymin"]
    )
    assert got == want




@pytest.mark.parametrize("name", ["mean_ndi_by_aoi", "aoi_scenes", "zonal_mean", "aoi_tile_refs", "pixel_drill", "tile_render_query", "fpca_reconstruct", "clip_to_aoi", "minmax_stretch", "focal_conv", "resample_bicubic"])
def test_no_cross_join(spark, name):
    plan = plan_of(checks.QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_ndi_of_one_layer_reads_it_once(spark):
    plan = plan_of(checks.QUERIES["ndi"](spark, SMALL))
    assert plan.count("FileScan") == 1


def test_stretch_does_not_shuffle_cells(spark, tmp_path):
    cells = cells_of(spark, [(0, c, 0, 1, float(c)) for c in range(10)])
    cells.write.parquet(str(tmp_path / "c"))
    plan = plan_of(series.minmax_stretch(spark.read.parquet(str(tmp_path / "c")), ["band"]))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "hashpartitioning" not in plan


def test_layer_query_prunes(spark, fx, tmp_path):
    path = str(tmp_path / "layer")
    layers.write_layer(fx.tiles, path)
    layers.write_layer(fx.tiles.withColumn("layer", F.lit("other")), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = layers.layer_query(layers.read_layer(spark, path), "lineitem", 0, (1, 0, 2, 0), 0, 864000)
    plan = plan_of(found)
    filters = plan[plan.index("PartitionFilters"):]
    assert "layer" in filters.split("PushedFilters")[0] and "GreaterThanOrEqual(tile_x,1)" in filters
    assert "LessThanOrEqual(time_index,864000)" in filters
    assert {r["layer"] for r in found.select("layer").distinct().collect()} == {"lineitem"}


def test_metadata_reads_no_arrays(spark, fx, tmp_path):
    path = str(tmp_path / "layer")
    layers.write_layer(fx.tiles, path)
    plan = plan_of(layout.layer_metadata(layers.read_layer(spark, path)))
    assert "bands" not in plan[plan.index("ReadSchema"):].split("\n")[0]


def test_upsert_replaces_the_tiles_written(spark, fx, tmp_path):
    path = str(tmp_path / "layer")
    layers.upsert_layer(fx.tiles, path)
    before = layers.read_layer(spark, path).count()
    one = fx.tiles.filter("time_index = 0").limit(1).withColumn("bands", F.array(F.array(F.lit(-1.0))))
    layers.upsert_layer(one, path)
    after = layers.read_layer(spark, path)
    assert after.count() == before
    assert after.filter(F.col("bands")[0][0] == -1.0).count() == 1


def test_two_results_at_one_time_both_stay(spark, fx, tmp_path):
    layer, refs = str(tmp_path / "layer"), str(tmp_path / "refs")
    result = rasters.scan_singleband(fx.tiles.filter("time_index = 0"), 1)
    left, right = result.filter("tile_x < 2"), result.filter("tile_x >= 2")
    layers.reingest_output(left, layer, refs, 77, 3, 5, "result")
    layers.reingest_output(right, layer, refs, 77, 3, 6, "result")
    layers.reingest_output(right, layer, refs, 77, 3, 6, "result")  # sent again
    stored = layers.read_layer(spark, layer)
    assert stored.count() == result.count() == spark.read.parquet(refs).count()
    assert left.count() and right.count()


def test_tiles_round_trip(spark, fx):
    again = layout.tiles_to_cells(layout.retile(fx.tiles, 7, 5))
    assert again.exceptAll(fx.cells.select(again.columns)).count() == 0
    assert again.count() == fx.cells.count()
    padded = layout.cells_to_tiles(cells_of(spark, [(0, 3, 5, 2, 9.0)]), 4, 3).first()
    assert (padded["tile_x"], padded["tile_y"]) == (0, 1)
    assert [len(b) for b in padded["bands"]] == [16, 16, 16]
    assert padded["bands"][1][7] == 9.0 and padded["bands"][0] == [None] * 16


def decode(path, content):
    t = json.loads(content)
    yield {"tile_x": 0, "tile_y": 0, "cols": t["cols"], "rows": t["rows"], "bands": t["bands"]}


def test_files_through_a_decoder(spark, tmp_path):
    for year in (1998, 2001):
        body = {"cols": 2, "rows": 1, "bands": [[year, 2.0], [3.0, None]]}
        (tmp_path / f"Test{year}-99.json").write_text(json.dumps(body))
    (tmp_path / "notes.txt").write_text("not a raster")
    tiles = rasters.scan_glob_timestamped(spark, str(tmp_path), decode, "*.json")
    got = layout.tiles_to_cells(tiles)
    assert {(r["time_index"], r["value"]) for r in got.filter("band = 1 and col = 0").collect()} == {
        (252460800, 1998.0),
        (347155200, 2001.0),
    }
    assert got.count() == 6


def test_mtl_files(spark, tmp_path):
    body = {"LANDSAT_METADATA_FILE": {"IMAGE_ATTRIBUTES": {"DATE_ACQUIRED": "2018-12-13", "SCENE_CENTER_TIME": "04:30:04.38Z"}}}
    (tmp_path / "a_MTL.json").write_text(json.dumps(body, indent=2))
    assert str(rasters.read_scene_metadata(spark, str(tmp_path)).first()["scene_time"]) == "2018-12-13 04:30:04"


def test_file_names_that_do_not_fit(spark):
    df = spark.createDataFrame([("LC08_x_y_2018_12.tif",), ("x.tif",), ("a_b_c_2018_13.tif",)], "name string")
    got = [r["scene_time"] for r in rasters.scenes_from_filenames(df).collect()]
    assert str(got[0]) == "2018-12-01 00:00:00" and got[1:] == [None, None]


SCENE = "ingest_id long, dataset_id long, time_index long, ts timestamp, xmin double, ymin double, xmax double, ymax double, sensor string"


def test_stream_ignores_what_is_sent_again(spark, tmp_path):
    inbox, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))

    def deliver(ids):
        rows = spark.range(max(ids) + 1).filter(F.col("id").isin(ids)).select(
            F.col("id").alias("ingest_id"),
            F.lit(1).cast("long").alias("dataset_id"),
            (F.col("id") * 86400).alias("time_index"),
            F.timestamp_seconds(F.col("id") * 3600 + 631152000).alias("ts"),
            F.lit(90.0).alias("xmin"),
            F.lit(25.0).alias("ymin"),
            F.lit(90.3).alias("xmax"),
            F.lit(25.3).alias("ymax"),
            F.lit("S").alias("sensor"),
        )
        rows.write.mode("append").parquet(inbox)

    def run():
        arriving = spark.readStream.schema(SCENE).parquet(inbox)
        stream_scene_ingest(arriving, store, state, levels=[8, 9]).awaitTermination()
        return spark.read.parquet(store).count()

    deliver([0, 1, 2])
    first = run()
    deliver([1, 2])  # the same scenes in another file
    assert run() == first
    deliver([3])
    assert run() == first // 3 * 4
    # a lost checkpoint replays everything; the catalog's key keeps it harmless
    arriving = spark.readStream.schema(SCENE).parquet(inbox)
    stream_scene_ingest(arriving, store, state + "2", levels=[8, 9]).awaitTermination()
    assert spark.read.parquet(store).count() == first // 3 * 4


def test_catalog_is_the_same_however_it_is_batched(spark, fx, tmp_path):
    refs = fx.tile_refs.filter("zoom_level = 8 and ingest_id < 400")
    half = F.col("ingest_id") % 2 == 0
    batches = {
        "one": [refs],
        "two": [refs.filter(half), refs.filter(~half)],
        "replay": [refs.filter(half), refs, refs],
        "doubled": [refs.unionByName(refs)],
    }
    stored = {}
    for name, parts in batches.items():
        for part in parts:
            catalog.write_tile_catalog(part, str(tmp_path / name))
        stored[name] = sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).select("tile_id", *refs.columns).collect()))
    assert stored["one"] == stored["two"] == stored["replay"] == stored["doubled"]
    assert len(stored["one"]) == refs.count() == len({r[0] for r in stored["one"]})
    # scenes of one dataset and time share tiles, and both stay
    assert refs.select(*[c for c in catalog.TILE_REF_KEY if c != "ingest_id"]).distinct().count() < refs.count()


def test_append_reads_only_the_key_ranges_of_the_batch(spark, fx, tmp_path):
    path = str(tmp_path / "refs")
    refs = fx.tile_refs.filter("zoom_level in (8, 9) and ingest_id < 400")
    catalog.write_tile_catalog(refs.filter("zoom_level = 8"), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(catalog.append_new(refs.filter("zoom_level = 9"), path, catalog.TILE_REF_KEY))
    pushed = plan[plan.rindex("PushedFilters"):]
    assert "(zoom_level,9)" in pushed and "GreaterThanOrEqual(spatial_index_x" in pushed


def test_an_older_scene_after_a_newer_one_is_stored(spark, tmp_path):
    inbox, store, scenes, state = (str(tmp_path / n) for n in ("in", "store", "scenes", "state"))
    for n, (ingest, time) in enumerate([(1, 913543204), (2, 157766400), (3, 913543204)]):
        row = (ingest, 1, time, None, 90.0, 25.0, 90.3, 25.3, "S")
        spark.createDataFrame([row], SCENE).coalesce(1).write.mode("append").parquet(inbox)
        arriving = spark.readStream.schema(SCENE).parquet(inbox)
        stream_scene_ingest(arriving, store, state, [8], scenes).awaitTermination()
        assert spark.read.parquet(store).select("ingest_id").distinct().count() == n + 1
        assert spark.read.parquet(scenes).count() == n + 1


def test_checkpoints_go_where_the_session_says(spark):
    from terracell.plans.storage import checkpoint_dir, scratch_path

    assert scratch_path(spark, "x").startswith(checkpoint_dir(spark).rstrip("/"))


def test_small_sides_prune_the_scan(spark, fx, tmp_path):
    """Key ranges of the small side reach the scan of what is stored."""
    refs_path, tiles_path = str(tmp_path / "refs"), str(tmp_path / "tiles")
    fx.tile_refs.filter("zoom_level = 12 and ingest_id < 400").write.parquet(refs_path)
    fx.tiles.withColumn("zoom", F.lit(12)).write.parquet(tiles_path)
    fx.cells.write.parquet(str(tmp_path / "cells"))
    refs, tiles, cells = (spark.read.parquet(str(tmp_path / n)) for n in ("refs", "tiles", "cells"))
    aois = fx.aois.filter("aoi_id = 100")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    asked = spark.createDataFrame([(1, 12, 2, 1, 0, 100)], "request_id long, z int, x int, y int, time_index long, aoi_id long")
    plans = {
        "spatial_index_x": plan_of(cover.aoi_tile_refs(aois, refs, 12)),
        "tile_x": plan_of(cover.aoi_data(aois, tiles, 12)),
        "col": plan_of(series.pixel_drill(fx.points.filter("point_id = 3"), cells, GRID)),
        "tile_y": plan_of(render.tile_render_query(asked, tiles, fx.aois.withColumns({"xmin": F.lit(-180.0), "xmax": F.lit(180.0), "ymin": F.lit(-90.0), "ymax": F.lit(90.0)}))),
    }
    for key, plan in plans.items():
        assert f"({key}," in plan[plan.index("PushedFilters"):], key
