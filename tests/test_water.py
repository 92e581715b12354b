import numpy as np
import pytest

from gridloom.operators import grid as G
from gridloom.operators import water as W
from pyspark.sql import functions as F


def frame(spark, **layers):
    """Arrays [x, z] as a table of cells."""
    shape = next(iter(layers.values())).shape
    rows = [(i, k, *(v[i, k].item() for v in layers.values())) for i in range(shape[0]) for k in range(shape[1])]
    return spark.createDataFrame(rows, ["x", "z", *layers]).withColumns({c: F.col(c).cast("int") for c in ("x", "z")})


def array(df, name, shape):
    out = np.zeros(shape, dtype=object)
    for r in df.collect():
        out[r.x, r.z] = r[name]
    return out.tolist()


def lake(size=40):
    i, k = np.indices((size, size))
    return (np.hypot(i - 19, k - 17) < 13) | ((k == 20) & (i > 25))


def test_distance_tiles_do_not_show(spark):
    cells = frame(spark, water=lake())
    whole = array(W.chamfer(cells, tile=64), "distance", (40, 40))
    assert whole == array(W.chamfer(cells, tile=16, halo=30), "distance", (40, 40))
    land = np.argwhere(~lake())
    for i, k in ((19, 17), (10, 17), (30, 20)):
        d = np.abs(land - (i, k))
        assert whole[i][k] == pytest.approx((3 * d.max(1) + d.min(1)).min() / 3)


def test_depth_is_shallow_at_the_shore_and_capped(spark):
    wet = np.zeros((200, 3), dtype=bool)
    wet[5:] = True
    rows = {r.x: r.depth for r in W.base_depth(frame(spark, water=wet)).where("z = 1").collect()}
    assert rows[4] == 0 and rows[5] == 1 and rows[199] == 30 and max(rows.values()) == 30


def test_edges_keep_streams_and_core(spark):
    cells = frame(spark, water=lake())
    got = W.naturalise(cells)
    assert got.where("core and not natural").count() == 0
    assert got.where("z = 20 and x > 34 and not natural").count() == 0
    small = W.naturalise(cells, tile=16, halo=40)
    assert array(got, "natural", (40, 40)) == array(small, "natural", (40, 40))


def levels(spark, base, water, depth, **options):
    return array(W.lake_levels(frame(spark, base_y=base, water=water, depth=depth), **options), "y", base.shape)


def test_lake_core_and_shelf_share_a_level(spark):
    base, water, depth = np.full((15, 15), 10), np.zeros((15, 15), bool), np.zeros((15, 15), int)
    for k, d in ((4, 1), (5, 2), (6, 3)):
        water[k : 15 - k, k : 15 - k], depth[k : 15 - k, k : 15 - k], base[k : 15 - k, k : 15 - k] = True, d, 9
    assert levels(spark, base, water, depth, search=4) == np.full((15, 15), 10).tolist()


def test_streams_keep_their_height_and_inlets_ramp(spark):
    base = np.tile(np.arange(15)[:, None], (1, 5))
    water = np.zeros((15, 5), bool)
    water[:, 2] = True
    assert levels(spark, base, water, water * 2) == base.tolist()
    base, depth, water = np.full((9, 9), 9), np.zeros((9, 9), int), np.zeros((9, 9), bool)
    depth[3:6, 3:6], water[3:6, 3:6], water[2, 4], depth[2, 4], base[2, 4] = 3, True, True, 1, 13
    assert levels(spark, base, water, depth)[2][4] == 11


def test_level_tiles_do_not_show(spark):
    i, k = np.indices((60, 60))
    base = 20 + (i // 7 + k // 11) % 5
    water = (i - 30) ** 2 + (k - 25) ** 2 < 400
    depth = np.where(water, 1 + ((i - 30) ** 2 + (k - 25) ** 2 < 120) * 3, 0)
    assert levels(spark, base, water, depth, tile=256) == levels(spark, base, water, depth, tile=20)


def test_running_minima_are_distances(spark):
    rng = np.random.default_rng(4)
    v = np.where(rng.random((17, 23)) < 0.1, rng.integers(0, 9, (17, 23)), -1)
    cells = frame(spark, v=v)
    got = array(G.l1_min(cells, F.when(F.col("v") >= 0, F.col("v")), "d"), "d", v.shape)
    src = np.argwhere(v >= 0)
    for i in range(17):
        for k in range(23):
            assert got[i][k] == min(v[a, b] + abs(a - i) + abs(b - k) for a, b in src)
    assert all(r.d is None for r in G.l1_min(cells, F.lit(None).cast("int"), "d").collect())
