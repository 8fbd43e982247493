"""Catalog lookups, covers and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions import grid
from terracell.operators import cover
from terracell.operators.series import time_range as range_of
from terracell.sources import catalog

from .registry import check

_T0, _T1 = 200_000_000, 320_000_000


@check(
    "scan_catalog_tables",
    """select 'datasets' as name, count(*) as n, cast(sum(dataset_id) as bigint) as total from {{datasets}}
       union all select 'scenes', count(*), cast(sum(ingest_id) as bigint) from {{scenes}}
       union all select 'aois', count(*), cast(sum(aoi_id) as bigint) from {{aois}}""",
)
def scan_catalog_tables(fx):
    path = fx.scratch("catalog")
    frames = {"datasets": fx.datasets, "scenes": fx.scenes, "aois": fx.aois}
    for name, df in frames.items():
        df.write.parquet(f"{path}/{name}")
    read = catalog.read_catalog(fx.spark, path, list(frames))
    ids = {"datasets": "dataset_id", "scenes": "ingest_id", "aois": "aoi_id"}
    out = None
    for name, df in read.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(ids[name]).alias("total")).select(F.lit(name).alias("name"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


@check("dataset_lookup", "select dataset_id, ds_name from {{datasets}} where ds_name = (select s_name from supplier where s_suppkey = 7)")
def dataset_lookup(fx):
    name = fx.datasets.filter(F.col("dataset_id") == 7).first()["ds_name"]
    return catalog.dataset_lookup(fx.datasets, name=name).select("dataset_id", "ds_name")


@check("querable_datasets", "select dataset_id, ds_name from {{datasets}} where is_querable")
def querable_datasets(fx):
    return catalog.querable_datasets(fx.datasets).select("dataset_id", "ds_name")


@check(
    "scene_search",
    f"""select ingest_id, dataset_id, time_index, xmin, ymin, xmax, ymax from {{{{scenes}}}}
        where dataset_id = 3 and time_index between {_T0} and {_T1}
          and xmin <= 69.25e0 and xmax >= 68.5e0 and ymin <= 35.5e0 and ymax >= 34.75e0""",
)
def scene_search(fx):
    return catalog.scene_search(fx.scenes, 3, (68.5, 34.75, 69.25, 35.5), _T0, _T1)


@check("time_range", f"select ingest_id, time_index from {{{{scenes}}}} where time_index >= {_T0} and time_index <= {_T1}")
def time_range(fx):
    return range_of(fx.scenes, _T0, _T1).select("ingest_id", "time_index")


@check("time_indexes", f"select distinct dataset_id, time_index from {{{{scenes}}}} where time_index >= {_T0}")
def time_indexes(fx):
    return catalog.time_indexes(fx.scenes, start=_T0)


@check("time_index_list", "select dataset_id, time_index, count(*) as scenes from {{scenes}} group by 1, 2")
def time_index_list(fx):
    return catalog.time_index_list(fx.scenes)


@check("sorted_time_indexes", "select distinct dataset_id, time_index from {{scenes}} order by 1, 2")
def sorted_time_indexes(fx):
    return catalog.sorted_time_indexes(fx.scenes)


@check("distinct_rows", "select distinct dataset_id, time_index, xmin from {{scenes}}")
def distinct_rows(fx):
    return fx.scenes.select("dataset_id", "time_index", "xmin").distinct()


@check("limit_one", "select ingest_id, time_index from {{scenes}} where dataset_id = 4 order by time_index, ingest_id limit 1")
def limit_one(fx):
    return catalog.limit_one(fx.scenes.filter("dataset_id = 4"), "time_index", "ingest_id").select("ingest_id", "time_index")


@check(
    "latest_scene",
    """select dataset_id, ingest_id, time_index, cast(rank as integer) as rank from
       (select *, row_number() over (partition by dataset_id order by time_index desc, ingest_id) as rank from {{scenes}})
       where rank <= 3""",
)
def latest_scene(fx):
    return catalog.latest_scenes_by(fx.scenes, ["dataset_id"], 3).select("dataset_id", "ingest_id", "time_index", "rank")


@check("latest_scenes_top_k", "select ingest_id, time_index from {{scenes}} order by time_index desc, ingest_id limit 10")
def latest_scenes_top_k(fx):
    return catalog.latest_scenes(fx.scenes, 10).select("ingest_id", "time_index")


@check(
    "dataset_dim_join",
    "select s.ingest_id, s.dataset_id, d.ds_name, d.no_of_bands from {{scenes}} s join {{datasets}} d using (dataset_id)",
)
def dataset_dim_join(fx):
    return catalog.with_dataset(fx.scenes, fx.datasets, ["ds_name", "no_of_bands"]).select(
        "ingest_id", "dataset_id", "ds_name", "no_of_bands"
    )


_COVER_SUM = """cast(count(*) as bigint) as tiles, cast(sum(tile_x) as bigint) as sx, cast(sum(tile_y) as bigint) as sy,
    cast(sum(cast(tile_x as bigint) * tile_y) as bigint) as sxy"""


def _cover_sum(df, *keys):
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tiles"),
        F.sum("tile_x").alias("sx"),
        F.sum("tile_y").alias("sy"),
        F.sum(F.col("tile_x").cast("bigint") * F.col("tile_y")).alias("sxy"),
    )


@check("tiles_in_bbox", f"select aoi_id, {_COVER_SUM} from {{{{aoi_cover}}}} group by 1")
def tiles_in_bbox(fx):
    return _cover_sum(cover.tiles_in_bbox(fx.aois, [12]), "aoi_id")


@check("scene_tile_cover", f"select ingest_id, zoom, {_COVER_SUM} from {{{{cover}}}} group by 1, 2")
def scene_tile_cover(fx):
    return _cover_sum(cover.scene_tile_cover(fx.scenes), "ingest_id", "zoom")


@check(
    "polygon_intersects",
    f"""select ingest_id, zoom, {_COVER_SUM} from {{{{candidates}}}}
        where tx0 <= xmax and tx1 >= xmin and ty0 <= ymax and ty1 >= ymin and (ingest_id % 2 = 0 or
          greatest(tx0 - (xmin + xmax) / 2, 0, (xmin + xmax) / 2 - tx1)
          + greatest(ty0 - (ymin + ymax) / 2, 0, (ymin + ymax) / 2 - ty1) <= (xmax - xmin) / 2)
        group by 1, 2""",
)
def polygon_intersects(fx):
    return _cover_sum(cover.scene_tile_cover(fx.ring_scenes), "ingest_id", "zoom")


@check(
    "scene_aoi_filter",
    """select a.aoi_id, count(*) as scenes, cast(sum(s.ingest_id) as bigint) as ids
       from {{scenes}} s join {{aois}} a on s.xmin <= a.xmax and s.xmax >= a.xmin and s.ymin <= a.ymax and s.ymax >= a.ymin
       where s.ingest_id % 2 = 0 or
          greatest(a.xmin - (s.xmin + s.xmax) / 2, 0, (s.xmin + s.xmax) / 2 - a.xmax)
          + greatest(a.ymin - (s.ymin + s.ymax) / 2, 0, (s.ymin + s.ymax) / 2 - a.ymax) <= (s.xmax - s.xmin) / 2
       group by 1""",
)
def scene_aoi_filter(fx):
    pairs = cover.aoi_scenes(fx.aois, fx.ring_scenes)
    return pairs.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("scenes"), F.sum("ingest_id").alias("ids"))


@check(
    "aoi_scenes",
    f"""select a.aoi_id, s.ingest_id, s.dataset_id, s.time_index
        from {{{{scenes}}}} s join {{{{aois}}}} a on s.xmin <= a.xmax and s.xmax >= a.xmin and s.ymin <= a.ymax and s.ymax >= a.ymin
        where s.dataset_id = 3 and s.time_index between {_T0} and {_T1}""",
)
def aoi_scenes(fx):
    return cover.aoi_scenes(fx.aois, fx.scenes, _T0, _T1, dataset_id=3)


@check(
    "aoi_tile_refs",
    """select c.aoi_id, count(*) as refs, count(distinct (v.tile_x, v.tile_y)) as tiles, cast(sum(v.ingest_id) as bigint) as ids
       from {{aoi_cover}} c join {{cover}} v on v.zoom = 12 and v.tile_x = c.tile_x and v.tile_y = c.tile_y
       where v.dataset_id = 3 group by 1""",
)
def aoi_tile_refs(fx):
    refs = cover.aoi_tile_refs(fx.aois, fx.tile_refs, dataset_id=3)
    return refs.groupBy("aoi_id").agg(
        F.count(F.lit(1)).alias("refs"),
        F.count_distinct("spatial_index_x", "spatial_index_y").alias("tiles"),
        F.sum("ingest_id").alias("ids"),
    )


@check(
    "tile_point_lookup",
    """select distinct v.dataset_id, v.tile_x, v.tile_y, v.time_index,
              'S' || v.dataset_id || '/10/' || v.tile_x || '/' || v.tile_y || '/' || v.time_index || '.tif' as file_path
       from {{cover}} v join (select cast(floor((lon + 180) / 360 * 1024) as integer) as tile_x,
            cast(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 1024) as integer) as tile_y, s.dataset_id, s.time_index
            from {{points}} join {{scenes}} s on s.ingest_id = point_id) p
       on p.dataset_id = v.dataset_id and v.zoom = 10 and p.tile_x = v.tile_x and p.tile_y = v.tile_y and p.time_index = v.time_index""",
)
def tile_point_lookup(fx):
    at = fx.points.select(F.col("point_id").alias("ingest_id"), grid.point_to_tile("lon", "lat", F.lit(10)).alias("t"))
    wanted = at.join(fx.scenes, "ingest_id").select(
        "dataset_id",
        F.lit(10).alias("zoom_level"),
        grid.z_index("time_index", F.col("t.tile_y"), F.col("t.tile_x")).alias("z_index"),
    )
    hits = catalog.tile_point_lookup(fx.tile_refs, wanted)
    parts = F.split(F.regexp_replace("file_path", r"\.tif$", ""), "/")
    return hits.select(
        "dataset_id", parts[2].cast("int").alias("tile_x"), parts[3].cast("int").alias("tile_y"),
        parts[4].cast("bigint").alias("time_index"), "file_path",
    )


_STORED = "(select distinct tile_x, tile_y from {{cover}} where zoom = 12 and dataset_id = 3 and time_index between 200000000 and 210000000)"


@check(
    "scenes_with_tiles",
    f"select aoi_id, cast(c.tile_x as integer) as tile_x, cast(c.tile_y as integer) as tile_y from {{{{aoi_cover}}}} c semi join {_STORED} v on v.tile_x = c.tile_x and v.tile_y = c.tile_y",
)
def scenes_with_tiles(fx):
    return _covered(fx, cover.with_tiles)


@check(
    "missing_tiles",
    f"select aoi_id, cast(c.tile_x as integer) as tile_x, cast(c.tile_y as integer) as tile_y from {{{{aoi_cover}}}} c anti join {_STORED} v on v.tile_x = c.tile_x and v.tile_y = c.tile_y",
)
def missing_tiles(fx):
    return _covered(fx, cover.without_tiles)


def _covered(fx, join):
    wanted = cover.tiles_in_bbox(fx.aois.select("aoi_id", "xmin", "ymin", "xmax", "ymax"), [12]).select("aoi_id", "tile_x", "tile_y")
    stored = fx.tile_refs.filter("zoom_level = 12 and dataset_id = 3 and time_index between 200000000 and 210000000").select(
        F.col("spatial_index_x").alias("tile_x"), F.col("spatial_index_y").alias("tile_y")
    )
    return join(wanted, stored, ["tile_x", "tile_y"]).select("aoi_id", "tile_x", "tile_y")


@check(
    "grid_masked_cover",
    f"""select zoom, {_COVER_SUM} from {{{{cover}}}} semi join
        (select distinct cast(floor((lon + 180) / 360 * 1024) as integer) as mx,
                cast(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 1024) as integer) as my from {{{{points}}}}) m
        on zoom = 10 and tile_x = mx and tile_y = my group by 1""",
)
def grid_masked_cover(fx):
    mask = fx.points.select(grid.point_to_tile("lon", "lat", F.lit(10)).alias("t")).select(F.lit(10).alias("zoom"), "t.*")
    return _cover_sum(cover.scene_tile_cover(fx.scenes, [10], mask), "zoom")


