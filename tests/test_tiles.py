"""Tiles against whole windows, and tasks that do not grow with the slice."""

import numpy as np
import pytest


def pixels(spark, shapes):
    r = np.random.default_rng(6)
    rows = [(s, i, int(v)) for s, (w, h) in enumerate(shapes) for i, v in enumerate(r.integers(0, 256, w * h))]
    return spark.createDataFrame(rows, "s int, i int, v int")


@pytest.mark.parametrize(("width", "heights", "block"), [(9, (1, 2, 30), 10), (1, (1, 40), 3), (50, (17, 3), 128), (7, (100,), 16384)])
def test_residuals_on_tiles(spark, width, heights, block):
    from slicewise.operators import predict, tiles

    px = pixels(spark, [(width, h) for h in heights])
    for p in ("none", "left", "gradient", "median"):
        got, want = (sorted(map(tuple, x.select("s", "i", "v", "residual").collect())) for x in (tiles.residual(px, p, width, ["s"], block), predict.residual(px, p, width, ["s"])))
        assert got == want, p


@pytest.mark.parametrize(("width", "heights", "tile"), [(9, (1, 2, 30), 4), (1, (1, 40), 8), (50, (17, 3), 16), (7, (100,), 128)])
def test_inverses_on_tiles(spark, width, heights, tile):
    from slicewise.operators import predict, tiles

    px = pixels(spark, [(width, h) for h in heights])
    for p in ("left", "gradient"):
        res = predict.residual(px, p, width, ["s"]).drop("v")
        out = tiles.inverse_left(res, ["s"], tile * 5) if p == "left" else tiles.inverse_gradient(res, width, ["s"], tile)
        assert sorted(map(tuple, out.select("s", "i", "v").collect())) == sorted(map(tuple, px.collect())), p


def test_a_block_does_not_grow_with_its_slice(spark):
    from slicewise.operators import tiles

    for h in (20, 200):
        assert tiles.with_halo(pixels(spark, [(16, h)]), 16, 64).groupBy("s", "block").count().selectExpr("max(count)").first()[0] == 64 + 17


def test_no_rows(spark):
    from slicewise.operators import tiles

    none = spark.createDataFrame([], "s int, i int, v int")
    assert tiles.residual(none, "median", 5, ["s"]).count() == 0 and tiles.inverse_gradient(none.withColumnRenamed("v", "residual"), 5, ["s"]).count() == 0


@pytest.mark.parametrize(("width", "heights"), [(9, (1, 2, 30)), (1, (1, 2, 40)), (50, (17, 3))])
def test_the_medians_inverse_as_a_fold(spark, width, heights):
    from slicewise.operators import predict

    px = pixels(spark, [(width, h) for h in heights])
    res = predict.residual(px, "median", width, ["s"]).drop("v")
    assert sorted(map(tuple, predict.inverse_median(res, width, ["s"]).select("s", "i", "v").collect())) == sorted(map(tuple, px.collect()))


def test_blocks_are_dealt_to_as_many_tasks_as_the_samples_need(spark):
    from slicewise.operators import tiles

    assert [tiles.tasks(n, 4) for n in (0, tiles.TASK, 100 * tiles.TASK + 1)] == [4, 4, 101]
    px = spark.range(6000).selectExpr("id DIV 3000 AS k", "CAST(id % 3000 AS INT) AS i", "CAST(id * id % 251 AS INT) AS v")
    out = tiles.residual(px, "median", 16, ["k"], 64, partitions=9)
    assert out.rdd.getNumPartitions() == 9
    assert sorted(out.collect()) == sorted(tiles.residual(px, "median", 16, ["k"], 64).collect())
