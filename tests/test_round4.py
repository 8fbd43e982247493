"""Pairs that share nothing end before they are added up, tasks that follow a join's result, axes that are looked up, templates of hosts of any size."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from terracell.llm import url_templates
from terracell.operators import halo, resample, zonal
from terracell.operators.layout import Grid, cells_to_tiles
from terracell.plans import joins

CELL = "layer string, time_index bigint, col int, row int, band int, value double"
UNIT = Grid(0.0, 0.0, 1.0, 1.0)


def square(spark, x0, y0, x1, y1):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return spark.createDataFrame([(1, ring)], "aoi_id int, ring array<struct<x:double,y:double>>")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_histogram_pairs_without_cells_are_not_added_up(spark):
    cells = spark.createDataFrame([("a", 0, c, r, 1, float(c)) for c in range(60) for r in range(3)], CELL)
    found = zonal.zonal_histogram(cells, square(spark, 2.0, -2.0, 4.0, 0.0), UNIT)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 2), (1, 3, 2)]
    lines = plan_of(found).splitlines()
    added_up = next(k for k, line in enumerate(lines) if "sum(_shared" in line)
    assert not any("Filter" in line and "n#" in line for line in lines[: added_up + 1])
    assert any("bit_count" in line and "> 0" in line for line in lines[added_up + 1 :])


def test_zonal_means_read_the_rows_of_the_polygons(spark):
    cells = spark.createDataFrame([("a", 0, c, r, 1, 1.0) for c in range(8) for r in range(400)], CELL)
    aois = square(spark, 1.0, -5.0, 3.0, -4.0)
    means = zonal.zonal_mean(cells, aois, UNIT)
    plan = plan_of(means)
    assert "row" in plan[plan.index("MapInArrow") :] and "<= 4" in plan[plan.index("MapInArrow") :]
    tiles = zonal.zonal_mean_tiles(cells_to_tiles(cells, 8, 1), aois, UNIT, 8)
    plan = plan_of(tiles)
    assert "<= 4" in plan[plan.index("MapInArrow") :]
    assert [tuple(r) for r in means.collect()] == [tuple(r) for r in tiles.collect()] == [(1, 2, 2.0, 1.0)]


def test_overzoom_of_one_tile_is_many_tasks_work(spark, monkeypatch):
    stored = spark.createDataFrame([("a", 2, 1, 1, 0, 1, c, r, float(4 * r + c)) for c in range(4) for r in range(4)], "layer string, zoom int, tile_x int, tile_y int, time_index bigint, band int, col int, row int, value double")
    asked = spark.createDataFrame([(k, 3, 2 + k % 2, 3) for k in range(200)], "request_id bigint, z int, x int, y int")
    few = sorted(map(tuple, resample.overzoom(asked, stored, max_zoom=2, size=4).collect()))
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 160)
    monkeypatch.setattr(joins, "BROADCAST_RESULT", 160, raising=False)
    spread = resample.overzoom(asked, stored, max_zoom=2, size=4)
    assert sorted(map(tuple, spread.collect())) == few and len(few) == 200 * 16
    rows = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) > 8 and max(rows) < len(few) // 4


def test_a_block_looks_up_its_targets():
    kernel = halo.resampling(np.arange(50) / 2, np.arange(8_000_000) / 2, "cubic")
    values, there = np.arange(256.0).reshape(16, 16), np.ones((16, 16), bool)
    start = time.perf_counter()
    for k in range(200):
        i, j, *_ = kernel(values, there, 0, 16 * k)
    assert time.perf_counter() - start < 1.5
    assert (j.min(), j.max()) == (2 * (16 * 199 - 2) + 1, 2 * (16 * 199 + 17) - 1)


def test_targets_in_any_order():
    u = np.array([3.25, 0.5, 9.0, -1.5, 2.0, 2.0])
    values, there = np.arange(16.0).reshape(4, 4), np.ones((4, 4), bool)
    i, j, s, *_ = halo.resampling(u, u, "cubic")(values, there, 0, 0)
    near = [k for k, x in enumerate(u) if -2 < x < 5]
    assert sorted(set(i.tolist())) == near
    weights = halo.kernel_weights(u[near][:, None] - np.arange(4)[None, :], "cubic")
    assert np.allclose(s.reshape(len(near), -1), weights @ values @ weights.T)


def test_cancelled_weights_keep_a_value_where_asked_for(spark, monkeypatch):
    monkeypatch.setattr(halo, "ROUNDING", 1e-3)
    cells = spark.createDataFrame([("a", 0, c, 0, 1, v) for c, v in ((0, 2.0), (2, 6.0))], CELL)
    dst = Grid(-1e-5, 0.0, 1.0, 1.0)  # beside column 1, which has no value: the weights left and right of it cancel
    for found in (lambda **o: resample.resample(cells, UNIT, dst, 3, 1, "cubic", **o), lambda **o: resample.resample_tiles(cells_to_tiles(cells, 4, 1), UNIT, dst, 3, 1, "cubic", **o)):
        assert sorted(r["col"] for r in found().collect()) == [0, 2]
        whole = {r["col"]: r["value"] for r in found(fill_cancelled=True).collect()}
        assert sorted(whole) == [0, 1, 2] and abs(whole[1] - 4.0) < 1e-2


def test_templates_do_not_depend_on_the_size_of_a_host(spark, monkeypatch):
    rng = random.Random(4)
    sections = ["news", "blog", "spam", "shop", "de", "fr", "10", "a"]
    urls = [f"http://h{rng.randrange(3)}.com" for _ in range(5)]
    for _ in range(1500):
        depth = rng.randrange(1, 6)
        urls.append(f"http://h{rng.randrange(3)}.com/" + "/".join(rng.choice(sections) + rng.choice(["", "", "x"]) for _ in range(depth)))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rules = [("block", "com", "/spam/"), ("allow", "com", "/news/"), ("block", "h1.com", "/shop/a/")]

    def verdicts():
        return {r["page_id"]: tuple(r) for r in url_templates.url_verdicts(pages, rules).collect()}

    here = verdicts()
    assert any("|" in r[5] for r in here.values())
    for limit in ("MERGED_PATHS", "MERGED_DEPTH"):
        with monkeypatch.context() as m:
            m.setattr(url_templates, limit, 1)
            assert verdicts() == here


def test_boxes_have_no_rows_on_levels_where_nothing_meets_them(spark, monkeypatch):
    rng = random.Random(6)

    def boxes(n, size, p):
        at = [(k, rng.uniform(0, 20), rng.uniform(0, 20)) for k in range(n)]
        names = ["xmin", "ymin", "xmax", "ymax"]
        return spark.createDataFrame([(k, x, y, x + size, y + size) for k, x, y in at], ["o" if p else "id", *(p + c for c in names)])

    made = []
    monkeypatch.setattr(joins, "cut", lambda df: made.append(df) or df)
    small, other = boxes(40, 0.3, ""), boxes(30, 0.25, "b_")
    pairs = joins.box_join(small, other, ["id"]).select("id", "o")
    assert made[0].select("_level").distinct().collect() == [(0,)]
    brute = small.crossJoin(other).filter("xmin <= b_xmax and xmax >= b_xmin and ymin <= b_ymax and ymax >= b_ymin").select("id", "o")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, brute.collect()))
    mixed = small.unionByName(boxes(9, 7.0, "").withColumn("id", F.col("id") + 100))
    wide = other.unionByName(boxes(8, 3.0, "b_").withColumn("o", F.col("o") + 100))
    brute = mixed.crossJoin(wide).filter("xmin <= b_xmax and xmax >= b_xmin and ymin <= b_ymax and ymax >= b_ymin").select("id", "o")
    assert sorted(map(tuple, joins.box_join(mixed, wide, ["id"]).select("id", "o").collect())) == sorted(map(tuple, brute.collect()))
