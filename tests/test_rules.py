import pytest

from gridloom.functions.dialect import column
from gridloom.functions.hashing import bhash24, hash24
from gridloom.functions.noise import smooth_noise
from gridloom.operators import features
from gridloom.operators import rules as R
from gridloom.operators import voxels as V
from gridloom.operators.noise_layers import Smooth, with_noise
from gridloom.plans.table_queries import preflight_of, validation_of
from pyspark.sql import functions as F


def test_hashes_like_wrapping_integers(spark):
    points = [(x, z) for x in (-70_000, -3, 0, 5, 9_999_999) for z in (-8, 0, 77, 123_456)]
    rows = spark.createDataFrame(points, "x int, z int").select("x", "z", column(hash24("x", "z", 1237)).alias("h"), column(bhash24("x", "z", 99)).alias("b")).collect()

    def wrap(v):
        return (v + 2**63) % 2**64 - 2**63

    for r in rows:
        h = wrap(r.x * 374761393 + r.z * 668265263 + 1237 * 1442695041)
        h = wrap((h ^ (h >> 13)) * 1274126177)
        assert r.h == (h ^ (h >> 16)) & 0xFFFFFF
        b = (r.x * 374761393 + r.z * 668265263 + 99 * 1442695041) & 0xFFFFFFFF
        b = ((b ^ (b >> 13)) * 1274126177) & 0xFFFFFFFF
        assert r.b == (b ^ (b >> 16)) & 0xFFFFFF


def test_noise_is_bound_to_coordinates(spark):
    rows = spark.range(40).select(column(smooth_noise("id", "7", 20, 3)).alias("a"), column(smooth_noise("(id - 100)", "7", 20, 3)).alias("b"))
    shifted = spark.range(100, 140).select(column(smooth_noise("(id - 100)", "7", 20, 3)).alias("a"))
    assert [r.a for r in rows.collect()] == [r.a for r in shifted.collect()]
    assert all(-1 <= r.a <= 1 for r in rows.collect())


def test_preflight_values(spark):
    rows = spark.createDataFrame([(0, 30, True)] * 4, "hm int, depth int, water boolean")
    got = preflight_of(rows).first()
    assert (got.columns, got.clipped_columns, got.clipped_blocks, got.required_fill_bottom) == (4, 4, 28, -71)
    none = preflight_of(rows.limit(0)).first()
    assert (none.columns, none.clipped_blocks, none.required_fill_bottom) == (0, 0, 318)


def test_validation_values(spark):
    rows = spark.createDataFrame([(True, 0), (False, 5), (True, 31), (False, 0)], "water boolean, depth int")
    assert tuple(validation_of(rows).first()) == (1, 1, 1, 31)


def test_snow_phase_values(spark):
    rows = spark.createDataFrame([(8, 0.49), (16, 0.49), (8, -0.49), (16, -0.49), (0, 0.5)], "u int, o double")
    assert [r[0] for r in rows.select(column(R.snow_phase("u", "o"))).collect()] == [12, 20, 4, 12, 0]


def test_derived_landcover(spark):
    rows = spark.createDataFrame([(9, False), (1, True), (3, False), (None, False)], "l int, w boolean")
    assert [r[0] for r in rows.select(column(R.derived_landcover("l", "w"))).collect()] == [5, 9, 3, None]


def test_writes_resolve(spark):
    writes = spark.createDataFrame([(0, 0, 0, "a", 1), (0, 0, 0, "b", 2), (1, 0, 0, "c", 5)], "x int, y int, z int, block string, p int")
    assert {(r.x, r.block) for r in V.resolved(writes, "p").collect()} == {(0, "b"), (1, "c")}
    assert {(r.x, r.block) for r in V.resolved(writes, "p", keep="first").collect()} == {(0, "a"), (1, "c")}


def test_lakebed_statistics(spark):
    cells = spark.range(192 * 192).select((F.col("id") % 192).alias("x"), F.expr("id div 192").alias("z"))
    cells = with_noise(cells, R.LAKEBED_NOISE)
    deep = cells.select(column(R.lakebed("22", "0", "true")).alias("b")).groupBy("b").count().collect()
    fine = sum(r["count"] for r in deep if r.b in ("clay", "mud"))
    assert fine > 0.6 * 192 * 192
    rocky = cells.select(column(R.lakebed("22", "3", "true")).alias("b")).distinct().collect()
    assert {r.b for r in rocky} <= {"stone", "cobble", "gravel"}


def test_utm_of_known_points(spark):
    rows = spark.createDataFrame([(13.663306, 47.589381, 33), (-3.0, 0.0, 30), (0.0, -45.0, 31)], "lon double, lat double, zone int")
    east, north = features.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    got = [tuple(r) for r in rows.select(east, north).collect()]
    # on a central meridian the easting is half a million and the northing the scaled meridian arc
    assert abs(got[1][0] - 500_000) < 1e-6 and abs(got[1][1]) < 1e-6
    assert abs(got[0][0] - 399_500) < 500 and abs(got[0][1] - 5_271_500) < 1500
    assert abs(got[2][1] - (10_000_000 - 4_985_000)) < 8_000


def test_written_voxels_are_checked(spark, tmp_path):
    voxels = spark.createDataFrame([(0, 1, 0, "a"), (0, 2, 0, "b")], "x int, y int, z int, block string")
    voxels.write.parquet(str(tmp_path / "v"))
    V.verify_written(voxels, str(tmp_path / "v"))
    with pytest.raises(ValueError, match="not written"):
        V.verify_written(spark.createDataFrame([(0, 2, 0, "c")], voxels.schema), str(tmp_path / "v"))
