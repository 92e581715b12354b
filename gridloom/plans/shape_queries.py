"""Queries on shapes: polygons and buffered lines, trees and decoration, guarded writes, pictures, source tiles, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.dialect import DUCK, SPARK, column
from gridloom.functions.hashing import bhash
from gridloom.operators import features, polygons
from gridloom.operators import grid as G
from gridloom.operators import points as P
from gridloom.operators import rules as R
from gridloom.operators import voxels as V
from gridloom.plans.fixture import cells, sql
from gridloom.plans.grid_queries import BED_SQL, SLOPES_SQL, SURFACE_SQL, bedded, painted
from gridloom.plans.plant_queries import decor_points
from gridloom.plans.registry import ORACLES, query
from gridloom.sources import binary

# ---- polygons and lines: of three nations one is a polygon with a hole, one a line of two steps, one a point ------------------
_MIDDLE = ("(n * 37 % 60 + 2.3)", "(n * 23 % 60 + 1.7)", "(5.15 + n % 4)")
_RING = [("{cx} + {r}", "{cz} + 0.07"), ("{cx} + 0.4", "{cz} + {r} * 0.9"), ("{cx} - {r} * 0.8", "{cz} + 0.35"), ("{cx} - 0.3", "{cz} - {r}")]
_HOLE = [("{cx} + 1.13", "{cz} + 0.21"), ("{cx} - 0.9", "{cz} + 1.27"), ("{cx} - 0.6", "{cz} - 1.09")]
_LINE = [("n * 11 % 50 - 3.37", "n * 7 % 64 + 0.41"), ("n * 11 % 50 + 13.83", "n * 7 % 64 + 6.71"), ("n * 11 % 50 + 18.53", "n * 7 % 64 - 9.19")]


def _at(points: list[tuple[str, str]]) -> list[tuple[str, str]]:
    cx, cz, r = _MIDDLE
    return [tuple(f"cast({c.format(cx=cx, cz=cz, r=r)} as double)" for c in p) for p in points]


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, geom_type, kind, parts)"""
    array = lambda ps: "array(" + ", ".join(f"named_struct('x', {x}, 'z', {z})" for x, z in _at(ps)) + ")"
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey as n")
    return nations.selectExpr(
        "n as id", "element_at(array('Polygon', 'LineString', 'Point'), n % 3 + 1) as geom_type", "element_at(array('river', 'stream', 'brook'), n % 4 % 3 + 1) as kind",
        f"case n % 3 when 0 then array({array(_RING)}, {array(_HOLE)}) when 1 then array({array(_LINE)}) else array({array(_LINE[:1])}) end as parts",
    )


def _edges_sql(points: list[tuple[str, str]], closed: bool = True) -> str:
    """The steps of a ring or line of each n, one select a step."""
    at = _at(points)
    return " union all ".join(f"select n, {a[0]} as x0, {a[1]} as z0, {b[0]} as x1, {b[1]} as z1 from s" for a, b in zip(at, [*at[1:], at[0]][: len(at) if closed else len(at) - 1], strict=False))


_SIDES = [f"((x1 - x0) * (c.z + {k} - z0) - (z1 - z0) * (c.x + {i} - x0))" for i in (0, 1) for k in (0, 1)]
_TOUCH_SQL = f"""touch as (select c.x, c.z, piece, code from edges e join (select a.range as x, b.range as z from range(64) a cross join range(64) b) c
    on least(x0, x1) <= c.x + 1 and greatest(x0, x1) >= c.x and least(z0, z1) <= c.z + 1 and greatest(z0, z1) >= c.z and least({', '.join(_SIDES)}) <= 0 and greatest({', '.join(_SIDES)}) >= 0
  union all select x, z, piece, code from (select c.x, c.z, piece, code, count(*) as n from edges e join (select a.range as x, b.range as z from range(64) a cross join range(64) b) c
    on (z0 <= c.z + 0.5) <> (z1 <= c.z + 0.5) and x0 + (c.z + 0.5 - z0) * (x1 - x0) / (z1 - z0) > c.x + 0.5 group by 1, 2, 3, 4) where n % 2 = 1)"""
_POLYGONS_SQL = f"polys as (select n, x0, z0, x1, z1 from ({_edges_sql(_RING)} union all {_edges_sql(_HOLE)}) where n % 3 = 0)"
_WIDTH_SQL = "(case n % 4 % 3 when 0 then 12 else 4 end / 8.0)"
_LINES_SQL = f"""steps as (select *, {_WIDTH_SQL} as h, sqrt((x1 - x0) * (x1 - x0) + (z1 - z0) * (z1 - z0)) as len from ({_edges_sql(_LINE, False)}) where n % 3 = 1),
  boxes as (select n, x0, z0, x1, z1, -(z1 - z0) / len * h as nx, (x1 - x0) / len * h as nz from steps),
  joints as (select n, {_at(_LINE)[1][0]} as x, {_at(_LINE)[1][1]} as z, {_WIDTH_SQL} as h, k.range as k from s cross join range(32) k where n % 3 = 1),
  lines as (select n, concat('b', n, '_', x0) as piece, x0 + nx as x0, z0 + nz as z0, x1 + nx as x1, z1 + nz as z1 from boxes union all select n, concat('b', n, '_', x0), x1 + nx, z1 + nz, x1 - nx, z1 - nz from boxes
    union all select n, concat('b', n, '_', x0), x1 - nx, z1 - nz, x0 - nx, z0 - nz from boxes union all select n, concat('b', n, '_', x0), x0 - nx, z0 - nz, x0 + nx, z0 + nz from boxes
    union all select n, concat('j', n), x + h * cos(2 * pi() * k / 32), z + h * sin(2 * pi() * k / 32), x + h * cos(2 * pi() * (k + 1) / 32), z + h * sin(2 * pi() * (k + 1) / 32) from joints)"""


@query("rasterise_polygon", f"with s as (select n_nationkey as n from nation), {_POLYGONS_SQL}, edges as (select concat('p', n) as piece, n as code, * from polys), {_TOUCH_SQL} select distinct cast(code as int) as id, cast(x as int) as x, cast(z as int) as z from touch")
def rasterise_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that each polygon touches; other kinds of geometry are left out."""
    found = polygons.of_kind(_shapes(spark, sf_dir), polygons.POLYGONS).select("id", "parts")
    return polygons.touched(found, 64, 64).select(F.col("id").cast("int").alias("id"), "x", "z")


@query("water_features", f"""with s as (select n_nationkey as n from nation), {_POLYGONS_SQL}, {_LINES_SQL}, edges as (select concat('p', n) as piece, 1 + n % 2 as code, x0, z0, x1, z1 from polys union all select piece, 9, x0, z0, x1, z1 from lines), {_TOUCH_SQL}
  select cast(x as int) as x, cast(z as int) as z, cast(max(code) as int) as code from touch group by x, z""")
def water_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons and buffered lines burnt into one grid; lines, whose width is that of their kind, lie over polygons."""
    shapes = _shapes(spark, sf_dir)
    widths = spark.createDataFrame([(k, float(w)) for k, w in R.WIDTHS.items()], "kind string, width double")
    lines = features.with_width(polygons.of_kind(shapes, polygons.LINES), widths, "kind", float(R.WIDTH))
    both = polygons.of_kind(shapes, polygons.POLYGONS).select("id", (F.col("id") % 2 + 1).alias("code"), "parts").unionByName(polygons.buffered(lines, F.col("width") / 4).select("id", F.lit(9).alias("code"), "parts"))
    return features.rasterised(polygons.touched(both, 64, 64), "code", "code").select("x", "z", F.col("code").cast("int").alias("code"))


_CLASSES = [(R.LANDCOVER[3], 3, "p_type", "PROMO", 3), (R.LANDCOVER[4], 4, "p_type", "SMALL", 4), (R.LANDCOVER[5], 5, "p_brand", "Brand#12", 5), (R.LANDCOVER[7], 7, "p_brand", "Brand#23", 7)]


@query("tagged_classes", "with c as (select * from (values " + ", ".join(f"('{n}', {c}, '{k}', '{v}', {p})" for n, c, k, v, p in _CLASSES) + """) t(name, code, key, value, priority)),
  tags as (select p_partkey, 'p_type' as key, split_part(p_type, ' ', 1) as value from part union all select p_partkey, 'p_brand', p_brand from part)
  select p_partkey as id, arg_max(name, priority) as name, cast(max(priority) as int) as code from tags join c using (key, value) group by p_partkey""")
def tagged_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as features, with the class of their tags."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tags = F.create_map(F.lit("p_type"), F.substring_index("p_type", " ", 1), F.lit("p_brand"), F.col("p_brand"))
    classes = spark.createDataFrame(_CLASSES, "name string, code int, key string, value string, priority int")
    return features.tagged(part.select(F.col("p_partkey").alias("id"), tags.alias("tags")), classes).select("id", "name", "code")


# ---- trees and decoration ---------------------------------------------------------------------------------------------------
_HEIGHTS_SQL = "trees as (select * from (values " + ", ".join(f"('{t}', {h})" for t, (a, b) in P.HEIGHTS.items() for h in range(a, b + 1)) + ") t(tree, height))"


@query("tree_shapes", f"""with {_HEIGHTS_SQL}, plane as (select cast(a.range as int) as dx, cast(b.range as int) as dz, a.range * a.range + b.range * b.range as q from range(-2, 3) a cross join range(-2, 3) b),
  ys as (select cast(range as int) as dy from range(0, 13)),
  spruce as (select tree, height, dx, dy, dz, q, case when dy >= height then 0 else [0, 1, 1, 2, 2, 1, 1, 2, 2, 1, 1][least(height - 1 - dy, 10) + 1] end as r from trees cross join plane cross join ys where tree = 'spruce' and dy between 2 and height + 1)
  select tree, height, 0 as dx, dy, 0 as dz, 'log' as kind from trees join ys on dy < height
  union all select tree, height, dx, dy, dz, 'leaf' from spruce where q <= r * r + r and not (dx = 0 and dz = 0 and dy < height - 1)
  union all select tree, height, dx, dy, dz, 'leaf' from trees cross join plane cross join ys where tree in ('oak', 'birch') and dy between height - 2 and height + 1 and q <= case when dy < height then 6 else 2 end and not (dx = 0 and dz = 0 and dy < height)
  union all select tree, height, dx, dy, dz, 'leaf' from trees cross join plane cross join ys where tree = 'krummholz' and (dy = height - 1 and q <= 5 or dy = height and q <= 2)""")
def tree_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every kind of tree at every height it grows to."""
    trees = spark.createDataFrame([(t, h) for t, (a, b) in P.HEIGHTS.items() for h in range(a, b + 1)], "tree string, height int")
    return P.shapes(trees).select("tree", "height", "dx", "dy", "dz", "kind")


_D = lambda salt, x="x", z="z": bhash(x, z, salt, DUCK)


@query("decor_shapes", f"""with found as ({ORACLES['decor_points']}),
  logs as (select x, z, kind, unnest(range(least(6, 3 + cast(floor({_D(71)} * 4) as int)))) as k, {_D(72)} < 0.5 as along from found where kind = 'log'),
  bush as (select x, z, kind, cast(a.range as int) as dx, cast(b.range as int) as dz from found cross join range(-1, 2) a cross join range(-1, 2) b where kind = 'bush')
  select x, z, kind, cast(case when along then k else 0 end as int) as dx, 0 as dy, cast(case when along then 0 else k end as int) as dz, 'log' as block, case when along then 'x' else 'z' end as axis from logs
  union all select x, z, kind, 0, cast(unnest(range(1 + least(1, cast(floor({_D(73)} * 2) as int)))) as int), 0, 'log', 'y' from found where kind = 'stump'
  union all select x, z, kind, dx, 0, dz, 'leaves', null from bush where abs(dx) + abs(dz) < 2 or {_D(74, 'x * 4 + dx', 'z * 4 + dz')} >= 0.5
  union all select x, z, kind, 0, 1, 0, 'leaves', null from found where kind = 'bush'
  union all select x, z, kind, 0, 0, 0, 'log', 'y' from found where kind = 'bush' and {_D(75)} < 0.4""")
def decor_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the logs, stumps and bushes that decorate the grid."""
    return P.decor_blocks(decor_points(spark, sf_dir))


# ---- guards, tiles, pictures ---------------------------------------------------------------------------------------------------
_HELD = "case when depth > 2 then 'stone' when landcover = 3 then 'fern' when landcover = 5 then 'cave_air' end"
_ASKED = "case when x % 3 = 0 then 'air' when x % 3 = 1 then 'soft' end"


@query("guarded_writes", sql(f"""select x, cast(317 + y.range as int) as y, z, 'oak_log' as block from cells cross join range(3) y
  where x between 5 and 59 and z between 0 and 49 and 317 + y.range <= 318 and (y.range <> 0 or coalesce(case {_ASKED} when 'air' then coalesce({_HELD}, 'air') in ('air', 'cave_air') when 'soft' then coalesce({_HELD}, 'air') <> 'stone' end, true))"""))
def guarded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs written to the top of the volume, on air only, on soft blocks, or on anything."""
    rows = cells(spark, sf_dir)
    volume = rows.select("x", F.lit(317).alias("y"), "z", column(_HELD).alias("block")).where("block is not null")
    writes = rows.select("x", F.explode(F.sequence(F.lit(317), F.lit(319))).alias("y"), "z", F.lit("oak_log").alias("block"), column(_ASKED).alias("guard"))
    return V.guarded(writes, volume, (5, 60, 0, 50)).select("x", "y", "z", "block")


@query("used_tiles", sql("select x, z, depth from cells where (x // 8, z // 8) in (select (x // 8, z // 8) from cells where depth > 3)"))
def used_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of tiles that hold deep water somewhere."""
    rows = cells(spark, sf_dir).select("x", "z", "depth").withColumn("deep", F.greatest(F.col("depth") - 3, F.lit(0)))
    return V.used_tiles(rows, "deep", 8).select("x", "z", "depth")


_SOIL = f"surface in ({', '.join(repr(k) for k in R.SOIL)})"
_WET, _SNOWY = "(landcover = 5 and x % 4 = 0)", "(case when elev > 2300 then 1 else 0 end)"
_PLANTABLE = R.plantable(_SOIL, "surface = 'mud'", _WET, _SNOWY, "water", "surface = 'ice'", "(landcover = 1 and z % 9 = 0)")


@query("plant_zone", sql(f"select x, z, zone from (select x, z, {R.plant_zone('surface', _WET, 'p', 'elev')} as zone from painted where {_PLANTABLE}) where zone is not null", SLOPES_SQL, SURFACE_SQL))
def plant_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where low plants may grow, and the zone whose plants they are."""
    rows = painted(spark, sf_dir).withColumn("zone", column(R.plant_zone("surface", _WET, "p", "elev")))
    return G.kept(rows, column(_PLANTABLE) & F.col("zone").isNotNull()).select("x", "z", "zone")


_BED_RGB = lambda d: {c: R.lakebed_colour(k, "bed", "depth", "plant", "water", d) for k, c in enumerate("rgb")}


@query("lakebed_rgb", sql("select x, z, " + ", ".join(f"{e} as {c}" for c, e in _BED_RGB(DUCK).items()) + f" from (select *, {R.aquatic_plant('depth', 'bed', 'relief', 'x', 'z', DUCK)} as plant from material)", BED_SQL))
def lakebed_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lakebed's picture: materials darker with depth, plants over them."""
    rows = bedded(spark, sf_dir).withColumn("plant", column(R.aquatic_plant("depth", "bed", "relief", "x", "z")))
    return rows.select("x", "z", *[column(e).alias(c) for c, e in _BED_RGB(SPARK).items()])


_SHADED = lambda d: {c: R.colour(k, "surface", "leaf", "p", "(landcover % 9)", d, R.relief_shade("(gx * 4)", "(gz * 4)", d)) for k, c in enumerate("rgb")}


@query("rgb_shaded", sql("select x, z, " + ", ".join(f"{e} as {c}" for c, e in _SHADED(DUCK).items()) + " from painted", SLOPES_SQL, SURFACE_SQL))
def rgb_shaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface's picture with the light on its slopes."""
    return painted(spark, sf_dir).select("x", "z", *[column(e).alias(c) for c, e in _SHADED(SPARK).items()])


@query("raster_info", sql("""select concat_ws(chr(10), printf('size %d x %d', 64, 64), 'y -40 to 300', 'horizontal 1 block = 4.00 m', printf('vertical 1 block = %.2f m', (high - low) / 340), printf('%.0f m is y -40', low), printf('%.0f m is y 300', high)) as info,
  round(low, 3) as elev_min_m, round(high, 3) as elev_max_m, round((high - low) / 340, 6) as meters_per_block_v, 64 as grid from (select min(elev) as low, max(elev) as high from cells)"""))
def raster_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands beside a heightmap: its text, and numbers read back from its JSON."""
    made = features.raster_info(cells(spark, sf_dir), "elev", 4.0, R.Y_MIN, R.Y_MAX)
    read = F.from_json("meta", "elev_min_m double, elev_max_m double, meters_per_block_v double, grid int")
    return made.select("info", read.alias("m")).select("info", "m.*")


@query("resize_nearest", sql("select cast(a.range as int) as x, cast(b.range as int) as z, landcover from range(25) a cross join range(25) b join cells c on c.x = cast(floor((a.range + 0.5) * 64 / 25) as int) and c.z = cast(floor((b.range + 0.5) * 64 / 25) as int)"))
def resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landcover at 25 x 25: of each new cell the old one at its middle."""
    at = lambda c: F.floor((F.col(c) + 0.5) * 64 / 25).cast("int")
    wanted = spark.range(625).select((F.col("id") % 25).cast("int").alias("i"), F.floor(F.col("id") / 25).cast("int").alias("k")).withColumns({"x": at("i"), "z": at("k")})
    return cells(spark, sf_dir).select("x", "z", "landcover").join(wanted, ["x", "z"]).select(F.col("i").alias("x"), F.col("k").alias("z"), "landcover")


@query("mosaic_scan", sql("select x, z, hm as px from cells where x >= 13 and x < 47 and z >= 9 and z < 51 and not (x >= 20 and x < 40 and z >= 20 and z < 40) and (x - 13) % 2 = 0 and (z - 9) % 2 = 0"))
def mosaic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of the heightmap's files, every second cell: the files that meet it are listed, and one that is broken is skipped."""
    files = binary.rasters(cells(spark, sf_dir), ["hm"], 20)
    files = files.withColumn("content", F.when(F.col("path") == "hm_x20_z20.png", F.lit("broken").cast("binary")).otherwise(F.col("content")))
    bounds = (13, 9, 47, 51)
    tiles = features.source_tiles(spark, bounds, 20, "hm_x{x}_z{z}.png")
    return features.windowed(binary.png16(files.join(tiles.select("path"), "path", "left_semi")), tiles, bounds, 2)


_PLACES = "c_custkey, c_custkey * 37 % 3600 / 10.0 - 180 as lon, c_custkey * 17 % 1600 / 10.0 - 80 as lat"


@query("utm_round_trip", f"select c_custkey, round(lon, 6) as lon, round(lat, 6) as lat from (select {_PLACES} from customer)")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' invented places, to their zones and back."""
    placed = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*_PLACES.replace("10.0", "10.0D").split(", ")).withColumn("zone", column("cast((lon + 180) / 6 as int) + 1"))
    east, north = features.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    met = placed.withColumns({"e": east, "n": north})
    lon, lat = features.utm_back(F.col("e"), F.col("n"), F.col("zone"), F.col("lat") < 0)
    return met.select("c_custkey", (F.round(lon, 6) + 0).alias("lon"), (F.round(lat, 6) + 0).alias("lat"))


_EUROPE = "c_custkey, c_custkey * 37 % 500 / 10.0 - 15 as lon, c_custkey * 17 % 400 / 10.0 + 31 as lat"


@query("europe_round_trip", f"select c_custkey, round(lon, 6) as lon, round(lat, 6) as lat from (select {_EUROPE} from customer)")
def europe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' invented places in Europe, to the equal-area projection and back."""
    placed = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*_EUROPE.replace("10.0", "10.0D").split(", "))
    east, north = features.europe(F.col("lon"), F.col("lat"))
    lon, lat = features.europe_back(F.col("e"), F.col("n"))
    return placed.withColumns({"e": east, "n": north}).select("c_custkey", (F.round(lon, 6) + 0).alias("lon"), (F.round(lat, 6) + 0).alias("lat"))
