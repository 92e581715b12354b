"""Shapes, guards and noise layers, against plain Python and fixed values."""

import numpy as np
import pytest

from gridloom.functions.dialect import SPARK, column
from gridloom.operators import features, polygons
from gridloom.operators import points as P
from gridloom.operators import rules as R
from gridloom.operators import voxels as V
from gridloom.operators.noise_layers import Smooth, with_noise
from pyspark.sql import functions as F

SHAPE = "id int, geom_type string, parts array<array<struct<x: double, z: double>>>"


def test_noise_layers_like_expressions(spark):
    """The Arrow pass and the expression give the same numbers, on dense cells, far-away ones, negative ones and nulls."""
    dense = [(x, z) for x in range(-20, 30) for z in range(-5, 25)]
    far = [(int(a), int(b)) for a, b in np.random.default_rng(1).integers(-(10**7), 10**7, (200, 2))]
    rows = spark.createDataFrame([*dense, *far, (None, 3), (4, None)], "x int, z int").repartition(3)
    layers = {"a": Smooth(440, 1234, 3), "b": Smooth(16, 5, 2), "c": Smooth(3, 99, 4)}
    met = with_noise(rows, layers).select("*", *[column(v.text("x", "z", SPARK)).alias(f"{k}2") for k, v in layers.items()])
    for r in met.collect():
        for k in layers:
            assert r[k] == r[f"{k}2"] if r[k] is None else abs(r[k] - r[f"{k}2"]) < 1e-12
    assert with_noise(rows.limit(0), layers).count() == 0


def test_noise_values_do_not_change(spark):
    """Worked out by hand from the hash of lattice points: at a lattice point the value is the hash itself."""

    def hash01(i, k, seed):
        wrap = lambda v: (v + 2**63) % 2**64 - 2**63
        h = wrap(i * 374761393 + k * 668265263 + seed * 1442695041)
        h = wrap((h ^ (h >> 13)) * 1274126177)
        return ((h ^ (h >> 16)) & 0xFFFFFF) / 0xFFFFFF

    rows = with_noise(spark.createDataFrame([(0, 0), (32, -16), (-48, 64)], "x int, z int"), {"n": Smooth(16, 7, 1)})
    for r in rows.collect():
        assert abs(r.n - (2 * hash01(r.x // 16, r.z // 16, 7) - 1)) < 1e-12


@pytest.fixture(scope="module")
def shapes(spark):
    ring = lambda *ps: [(float(x), float(z)) for x, z in ps]
    rows = [
        (1, "Polygon", [ring((2.5, 2.5), (9.5, 3.1), (8.2, 9.7), (3.3, 8.8)), ring((5.1, 5.2), (6.9, 5.3), (6.1, 7.4))]),
        (2, "Polygon", [ring((-5.3, -4.1), (3.7, -2.2), (1.1, 6.6), (-5.3, -4.1))]),
        (3, "LineString", [ring((0.5, 14.5), (12.25, 14.5), (12.25, 3.5))]),
        (4, "Point", [ring((7, 7))]),
        (5, "Polygon", [ring((30, 30), (40, 30), (35, 40))]),
        (6, "Polygon", []), (7, "Polygon", None), (8, "Polygon", [ring((4.2, 4.2))]), (9, "LineString", [ring((1, 1), (1, 1))]),
    ]
    return spark.createDataFrame(rows, SHAPE)


def _touches(rings, x, z):
    edges = [(a, b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if a != b]
    for (ax, az), (bx, bz) in edges:
        t0, t1 = 0.0, 1.0
        for d, low, high, start in ((bx - ax, x, x + 1, ax), (bz - az, z, z + 1, az)):
            if d == 0:
                if not low <= start <= high:
                    t0, t1 = 1.0, 0.0
            else:
                a, b = sorted(((low - start) / d, (high - start) / d))
                t0, t1 = max(t0, a), min(t1, b)
        if t0 <= t1:
            return True
    cx, cz, odd = x + 0.5, z + 0.5, False
    for (ax, az), (bx, bz) in edges:
        odd ^= (az <= cz) != (bz <= cz) and ax + (cz - az) * (bx - ax) / (bz - az) > cx
    return odd


def test_cells_that_polygons_touch(spark, shapes):
    found = polygons.touched(polygons.of_kind(shapes, polygons.POLYGONS), 16, 16)
    got = {(r.id, r.x, r.z) for r in found.collect()}
    want = {(r.id, x, z) for r in shapes.collect() if r.geom_type == "Polygon" and r.parts for x in range(16) for z in range(16) if _touches(r.parts, x, z)}
    assert got == want and (1, 5, 5) in got and {i for i, _, _ in got} == {1, 2}


def test_lines_are_buffered_with_flat_ends_and_round_joints(spark, shapes):
    made = polygons.buffered(polygons.of_kind(shapes, polygons.LINES), F.lit(2.0))
    assert made.where("id = 3").count() == 3 and made.where("id = 9").count() == 0
    cells = {(r.x, r.z) for r in polygons.touched(made, 16, 16).select("x", "z").distinct().collect()}
    assert {(0, 13), (0, 15), (6, 14), (11, 3), (13, 3), (13, 14), (12, 15)} <= cells
    assert not {(6, 12), (12, 2), (14, 8), (10, 8), (14, 14)} & cells


def test_tags_give_the_class_of_the_greatest_priority(spark):
    rows = spark.createDataFrame([(1, {"a": "x", "b": "y"}), (2, {"a": "x"}), (3, {"a": "z"}), (4, None), (5, {})], "id int, tags map<string, string>")
    classes = spark.createDataFrame([("low", 1, "a", "x", 1), ("high", 2, "b", "y", 9)], "name string, code int, key string, value string, priority int")
    assert {(r.id, r["name"], r.code) for r in features.tagged(rows, classes).collect()} == {(1, "high", 2), (2, "low", 1)}


def test_trees_by_hand(spark):
    blocks = P.shapes(spark.createDataFrame([("spruce", 6), ("krummholz", 2), ("oak", 4)], "tree string, height int")).collect()
    of = lambda tree, kind: {(r.dx, r.dy, r.dz) for r in blocks if r.tree == tree and r.kind == kind}
    assert of("spruce", "log") == {(0, y, 0) for y in range(6)}
    # radii 0, 1, 1, 2 from the layer below the top down
    assert {y: max(x for x, dy, _ in of("spruce", "leaf") if dy == y) for y in range(2, 8)} == {2: 2, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0}
    assert (0, 5, 0) in of("spruce", "leaf") and (0, 4, 0) not in of("spruce", "leaf") and (2, 2, 2) not in of("spruce", "leaf") and (2, 2, 1) in of("spruce", "leaf")
    assert len(of("krummholz", "leaf")) == 21 + 9 and len(of("oak", "leaf")) == 2 * 20 + 2 * 9
    assert P.crown(spark, 4).where("kind = 'leaf'").count() == 58


def test_guards(spark):
    volume = spark.createDataFrame([(1, 5, 1, "stone"), (2, 5, 1, "fern"), (3, 5, 1, "void_air")], "x int, y int, z int, block string")
    writes = [(x, 5, 1, "log", guard) for x in (1, 2, 3, 4) for guard in ("air", "soft", None)] + [(1, 400, 1, "log", None), (1, -65, 1, "log", None), (9, 5, 1, "log", None)]
    found = V.guarded(spark.createDataFrame(writes, "x int, y int, z int, block string, guard string"), volume, (0, 5, 0, 5)).collect()
    assert {(r.x, r.guard) for r in found} == {(1, None), (2, "soft"), (2, None), *((x, g) for x in (3, 4) for g in ("air", "soft", None))}
    assert len(found) == 9


def test_only_used_tiles_stay(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1, 0, 4), (9, 0, 0), (9, 9, None), (-1, 0, 7)], "x int, z int, v int")
    assert {(r.x, r.z) for r in V.used_tiles(rows, "v", 8).collect()} == {(0, 0), (1, 0), (-1, 0)}


def test_plant_zones_by_hand(spark):
    rows = [("mud", False, 0.9, 100), ("grass", True, 0.9, 100), ("stone", False, 0.29, 100), ("stone", False, 0.28, 1751), ("moss", False, 0.0, 1750), ("grass", False, 0.1, 10), ("stone", False, 0.0, 10)]
    found = spark.createDataFrame(rows, "s string, w boolean, p double, e int").select(column(R.plant_zone("s", "w", "p", "e"))).collect()
    assert [r[0] for r in found] == ["wetland", "wetland", "forest", "alpine", "meadow", "meadow", None]


def test_lakebed_colours_by_hand(spark):
    rows = [("sand", 0, "none", True), ("sand", 30, "none", True), ("mud", 15, "tall", True), ("mud", 15, "none", False), ("gravel", 60, "none", True)]
    found = spark.createDataFrame(rows, "bed string, depth int, plant string, water boolean").select(*[column(R.lakebed_colour(k, "bed", "depth", "plant", "water")).alias(c) for k, c in enumerate("rgb")])
    assert [tuple(r) for r in found.collect()] == [(219, 207, 163), (162, 153, 120), (45, 139, 56), (22, 27, 24), (97, 94, 93)]


def test_points_beyond_the_grid(spark):
    cells = spark.createDataFrame([(0, 0, 7), (1, 0, 8)], "x int, z int, v int")
    points = spark.createDataFrame([(-3, 0), (1, 0), (5, 2)], "x int, z int")
    assert [(r.x, r.v) for r in P.sampled(points, cells, 2, 1).collect()] == [(1, 8)]
    assert {(r.x, r.v) for r in P.sampled(points, cells, 2, 1, clamp=True).collect()} == {(-3, 7), (1, 8), (5, 8)}


def test_europe_of_a_known_point(spark):
    """The example of the projection's definition: 50 N, 5 E."""
    rows = spark.createDataFrame([(5.0, 50.0), (10.0, 52.0)], "lon double, lat double")
    east, north = features.europe(F.col("lon"), F.col("lat"))
    got = rows.select(east, north).collect()
    assert abs(got[0][0] - 3962799.45) < 0.01 and abs(got[0][1] - 2999718.85) < 0.01
    assert abs(got[1][0] - 4321000) < 1e-6 and abs(got[1][1] - 3210000) < 1e-6
    lon, lat = features.europe_back(F.lit(4321000.0), F.lit(3210000.0))
    assert tuple(spark.range(1).select(lon, lat).first()) == pytest.approx((10.0, 52.0))


def test_source_tiles_of_a_window(spark):
    found = features.source_tiles(spark, (-10.0, 55.0, 100.5, 100.0), 50, "t_{x}_{z}.png").collect()
    assert {(r.path, r.x0, r.z0, r.x1) for r in found} == {(f"t_{x}_50.png", x, 50, x + 50) for x in (-50, 0, 50, 100)}
    assert features.source_tiles(spark, (5.0, 5.0, 5.0, 5.0), 50, "t_{x}_{z}").count() <= 1
