"""First components of many layers in one job, against the layer-by-layer model."""

import random

import pytest
from pyspark.sql import functions as F

from terracell.operators import fpca

CELL = "layer string, time_index bigint, col int, row int, band int, value double"


def layers_of(spark, n):
    pick = random.Random(11)
    rows = []
    for k in range(n):
        steps = [10 * s for s in range(1 + k % 5)]  # layers differ in their steps
        for c in range(6):
            for r in range(4):
                rows += [(f"l{k}", t, c, r, 1, pick.uniform(-5, 9)) for t in steps if pick.random() > 0.2]
    rows += [("zero", t, c, 0, 1, 0.0) for t in (0, 10) for c in range(3)]
    rows += [("l1", 777, 0, 0, 1, None), ("l2", 10, 1, 1, 1, 4.0), ("l2", 10, 1, 1, 1, 8.0)]
    return spark.createDataFrame(rows, CELL)


def test_components_of_every_layer(spark):
    cells = layers_of(spark, 7)
    found = {(r["layer"], r["col"], r["row"]): r["component"] for r in fpca.layer_components(cells).collect()}
    pixel, expected = ["layer", "col", "row"], {}
    for name in [f"l{k}" for k in range(7)] + ["zero"]:
        one = cells.filter(F.col("layer") == name)
        model = fpca.fpca_fit(one.filter("value is not null"), pixel=pixel)
        for r in fpca.fpca_components(one, model, pixel=pixel).collect():
            expected[name, r["col"], r["row"]] = r["component"]
    assert found.keys() == expected.keys()
    for k, v in expected.items():
        assert found[k] == (pytest.approx(v, abs=1e-9) if v is not None else None)
    assert {v for k, v in found.items() if k[0] == "zero"} == {None}


def test_image_has_no_layer_limit(spark):
    cells = layers_of(spark, 130)
    found = fpca.fpca_image(cells, 10).select("layer", "stretched").collect()
    assert len({r["layer"] for r in found}) == 131
    jobs = []
    for n in (3, 40):
        spark.sparkContext.setJobGroup(f"layers-{n}", "")
        fpca.layer_components(layers_of(spark, n)).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"layers-{n}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_too_many_steps_and_empty(spark):
    cells = spark.range(20).selectExpr("'a' as layer", "id as time_index", "0 as col", "0 as row", "1 as band", "1.0D as value")
    with pytest.raises(Exception, match="more than 10 time steps"):
        fpca.layer_components(cells, max_steps=10).collect()
    assert fpca.layer_components(cells.filter("false")).collect() == []
