"""Queries on the grid: hashes, noise, ladders, stencils, distances, water."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.dialect import DUCK, SPARK, Dialect, column
from gridloom.functions.hashing import bhash, bhash24, hash24, hash01
from gridloom.functions.noise import smooth_noise, value_noise, white_noise
from gridloom.functions.palette import BLOCKS, band, pick, uniform
from gridloom.operators import grid as G
from gridloom.operators import rules as R
from gridloom.operators import water as W
from gridloom.operators.noise_layers import texts, with_noise
from gridloom.plans.fixture import cells, sql
from gridloom.plans.registry import query


def projection(name: str, build: Callable[[Dialect], dict[str, str]]) -> None:
    """A query of x, z and expressions over the grid's layers."""
    text = sql("select x, z, " + ", ".join(f"{e} as {c}" for c, e in build(DUCK).items()) + " from cells")

    @query(name, text)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cells(spark, sf_dir).select("x", "z", *[column(e).alias(c) for c, e in build(SPARK).items()])


six = lambda e: f"(round({e}, 6) + 0)"

# shifted coordinates reach negative ones, where flooring and shifting matter
projection("hash01_cells", lambda d: {"h": hash24("x - 40", "z * 1000003 - 7", 1237, d), "h2": hash24("z", "x", 5, d), "u": six(hash01("x", "z", 42, d))})
projection("bhash_cells", lambda d: {"h": bhash24("x - 40", "z - 9", 99, d), "h0": bhash24("x", "z", 0, d), "u": six(bhash("x", "z", 5, d))})
projection("white_noise_cells", lambda d: {"w": six(white_noise("x", "z", 1236, d))})
projection("value_noise_cells", lambda d: {"v": six(value_noise("x - 30", "z + 5", 9, 3, d))})
projection("smooth_noise_cells", lambda d: {"s2": six(smooth_noise("x", "z", 20, 1237, 2, d)), "s3": six(smooth_noise("x - 64", "z", 104, 1235, 3, d))})
projection("palette_pick", lambda d: {zone: pick(hash01("x", "z", 7 + k, d), zone, d, names=True) for k, zone in enumerate(("meadow", "rock_high", "wetland"))})
projection("palette_codes", lambda d: {"code": pick(white_noise("x", "z", 1, d), "floor_conifer", d)})
projection("uniform_pick", lambda d: {"block": uniform(bhash("x", "z", 5, d), R.STREAM_BED, d)})
projection("banded_pick", lambda d: {"band": band(hash01("x", "z", 3, d), 3, d), "ice": f"case {band(hash01('x', 'z', 3, d), 3, d)} when 0 then 'ice' when 1 then 'packed_ice' else 'blue_ice' end"})
projection("weighted_or_none", lambda d: {"plant": f"case when {hash01('x', 'z', 8, d)} < 0.34 then 'short_grass' when {hash01('x', 'z', 8, d)} < {d.num(0.64)} then 'fern' end"})
projection("dequantise_y", lambda d: {"y": R.dequantised_y("hm", d), "metres": six(R.dequantised_metres("hm", d.num(508.0), d.num(2995.0), d)), "offset": six(f"({R.Y_MIN} + hm / {d.num(65535.0)} * {R.Y_MAX - R.Y_MIN}) - {R.dequantised_y('hm', d)}")})
projection("depth_curve", lambda d: {"depth": R.depth_curve("(x + z)", "water", d)})
projection("biome_ladder", lambda d: {"biome": R.biome("elev")})
projection("derived_landcover", lambda d: {"landcover": R.derived_landcover("landcover", "water")})
projection("mask_priority", lambda d: {"river": "water", "forest": "(landcover = 3 and not water)", "kind": "case when water then 2 when landcover = 3 then 1 else 0 end"})
projection("chunk_address", lambda d: {"cx": d.shr("(x - 40)", 4), "cz": d.shr("(z - 9)", 4), "in_chunk": "((x - 40) & 15)", "region": d.shr(d.shr("(x - 40)", 4), 5), "floored": d.div_floor("x - 40", 16)})
projection("utm_zone", lambda d: {"epsg": R.utm_epsg("(x * 5.6 - 180)", "(z - 32)", d)})
projection("subsoil_layers", lambda d: {f"layer{k}": R.subsoil(k, "elev", "x", "z", d) for k in (1, 2, 3)})
projection("clamped_depth", lambda d: {"depth": R.clamped_depth("(x - 70)", "depth", "water"), "clipped": f"(water and {R.clamped_depth('(x - 70)', 'depth', 'water')} < depth)"})
projection("snow_phase", lambda d: {"units": R.snow_phase("cast(x % 17 as int)", "(z / 63.0 - 0.5)")})
projection("snow_units", lambda d: {"units": R.snow_units("(elev / 1000 - 1)", d)})
projection("shore_material", lambda d: {"material": R.shore_material("(not water)", "(depth = 0)", d.num(0.6), hash01("x", "z", 1, d), hash01("x", "z", 2, d), hash01("x", "z", 3, d), hash01("x", "z", 4, d), "(x * 0.5)", "x", "z", d)})
projection("effective_slope", lambda d: {"slope": six(f"x * {d.num(0.9)} - 7 * (z / {d.num(64.0)} - {d.num(0.5)})"), "shift": six(f"120 * {smooth_noise('x', 'z', 440, 1234, 3, d)} - 85 * (z / {d.num(64.0)})")})


_SAME = lambda layers: {k: k for k in layers}


@query("underwater_relief", sql(f"select x, z, {R.underwater_relief('depth', 'water', texts(R.relief_noise(), 'x', 'z', DUCK), DUCK)} as depth from cells"))
def underwater_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_noise(cells(spark, sf_dir).select("x", "z", "depth", "water"), R.relief_noise())
    return rows.select("x", "z", column(R.underwater_relief("depth", "water", _SAME(R.relief_noise()))).alias("depth"))


def _h(k: int, d: Dialect) -> str:
    return hash01("x", "z", 100 + k, d)


projection("ground_cover", lambda d: {"plant": R.ground_cover("(case landcover % 4 when 0 then 'wetland' when 1 then 'alpine' when 2 then 'forest' else 'meadow' end)", _h(1, d), _h(2, d), _h(3, d), _h(4, d), _h(5, d), _h(6, d), "elev", d)})


# ---- stencils ----------------------------------------------------------------------------------------------------------
ALONG = {"x": "partition by z order by x", "z": "partition by x order by z"}


def _gradient_sql(v: str, axis: str, spacing: float) -> str:
    low, high = f"lag({v}) over ({ALONG[axis]})", f"lead({v}) over ({ALONG[axis]})"
    return f"((coalesce({high}, {v}) - coalesce({low}, {v})) / ((case when {low} is null or {high} is null then 1 else 2 end) * {spacing}))"


SLOPES_SQL = f"""grad as (select *, {_gradient_sql('elev', 'x', 4.0)} as gx, {_gradient_sql('elev', 'z', 4.0)} as gz,
  (-4 * elev + coalesce(lag(elev) over ({ALONG['x']}), last_value(elev) over ({ALONG['x']} rows between unbounded preceding and unbounded following))
   + coalesce(lead(elev) over ({ALONG['x']}), first_value(elev) over ({ALONG['x']} rows between unbounded preceding and unbounded following))
   + coalesce(lag(elev) over ({ALONG['z']}), last_value(elev) over ({ALONG['z']} rows between unbounded preceding and unbounded following))
   + coalesce(lead(elev) over ({ALONG['z']}), first_value(elev) over ({ALONG['z']} rows between unbounded preceding and unbounded following))) / 16.0 as lap from cells),
slopes as (select *, degrees(atan(sqrt(gx * gx + gz * gz))) as slope, -gx / (sqrt(gx * gx + gz * gz) + 0.000001) as north,
  least(greatest(lap / (3 * ((select stddev_pop(lap) from grad) + 0.000001)), -1), 1) as curv from grad)"""


def slopes(rows: DataFrame, value: str = "elev", spacing: float = 4.0) -> DataFrame:
    """gx, gz, lap, slope in degrees, north and curv; the curvature is scaled by the whole grid's deviation.

    The one deviation is joined as a single broadcast row, of fixed size.
    """
    out = rows.withColumns({"gx": G.gradient(value, "x", spacing), "gz": G.gradient(value, "z", spacing), "lap": G.laplacian(value, spacing)})
    scale = out.agg(F.stddev_pop("lap").alias("_s"))
    steep = F.sqrt(F.col("gx") * F.col("gx") + F.col("gz") * F.col("gz"))
    out = out.crossJoin(F.broadcast(scale)).withColumns({"slope": F.degrees(F.atan(steep)), "north": -F.col("gx") / (steep + 0.000001)})
    return out.withColumn("curv", F.least(F.greatest(F.col("lap") / (3 * (F.col("_s") + 0.000001)), F.lit(-1.0)), F.lit(1.0))).drop("_s")


def rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("x", "z", *[F.round(n, 6).alias(n) for n in names])


def _rounded_sql(*names: str) -> str:
    return "select x, z, " + ", ".join(f"round({n}, 6) as {n}" for n in names)


@query("gradient_slope", sql(_rounded_sql("gx", "gz", "slope", "north") + " from slopes", SLOPES_SQL))
def gradient_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(slopes(cells(spark, sf_dir)), "gx", "gz", "slope", "north")


@query("laplacian_wrap", sql(_rounded_sql("lap") + " from grad", SLOPES_SQL))
def laplacian_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cells(spark, sf_dir).withColumn("lap", G.laplacian("elev", 4.0)), "lap")


@query("curvature", sql(_rounded_sql("curv") + " from slopes", SLOPES_SQL))
def curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(slopes(cells(spark, sf_dir)), "curv")


def _hillshade(azimuth: float, altitude: float) -> str:
    """Light from an azimuth and an altitude in degrees, over gx and gz."""
    slope, aspect = "atan(sqrt(gx * gx + gz * gz))", "atan2(-gx, gz)"
    return f"(sin(radians({altitude})) * cos({slope}) + cos(radians({altitude})) * sin({slope}) * cos(radians({azimuth}) - {aspect}))"


@query("hillshade", sql(f"select x, z, round({_hillshade(315.0, 45.0)}, 6) as shade from grad", SLOPES_SQL))
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).withColumns({"gx": G.gradient("elev", "x", 4.0), "gz": G.gradient("elev", "z", 4.0)})
    return rows.select("x", "z", F.round(column(_hillshade(315.0, 45.0)), 6).alias("shade"))


_NEAR = [f"abs(depth - {f}(depth) over ({ALONG[a]}))" for a in ("x", "z") for f in ("lag", "lead")]


@query("relief4", sql(f"select x, z, coalesce(greatest({', '.join(_NEAR)}), 0) as relief from cells"))
def relief4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("x", "z", G.relief4("depth").alias("relief"))


@query("count8", sql("""select a.x, a.z, cast(count(b.x) as int) as n from cells a left join cells b
  on abs(a.x - b.x) <= 1 and abs(a.z - b.z) <= 1 and (a.x <> b.x or a.z <> b.z) and b.water group by a.x, a.z"""))
def count8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.count8(cells(spark, sf_dir), "water", "n").select("x", "z", "n")


# ---- distances: the SQL looks at every pair of cells -----------------------------------------------------------------------
L1_SQL = "near as (select a.x, a.z, min(abs(a.x - b.x) + abs(a.z - b.z)) as steps from cells a cross join (select x, z from cells where water) b group by a.x, a.z)"


@query("dilate_cardinal", sql("select x, z, steps <= 3 as near from near", L1_SQL))
def dilate_cardinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dilate(cells(spark, sf_dir), F.col("water"), 3, "near").select("x", "z", "near")


@query("l1_rings", sql("select x, z, cast(case when steps <= 4 then steps else 99 end as int) as ring from near", L1_SQL))
def l1_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.l1_distance(cells(spark, sf_dir), F.col("water"), "steps")
    return found.select("x", "z", F.when(F.col("steps") <= 4, F.col("steps")).otherwise(99).cast("int").alias("ring"))


WIDEST_SQL = "widest as (select a.x, a.z, max(b.depth) as deepest from cells a join cells b on abs(a.x - b.x) + abs(a.z - b.z) <= 12 group by a.x, a.z)"


@query("max_in_ball", sql("select x, z, deepest from widest", WIDEST_SQL))
def max_in_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.l1_ball_max(cells(spark, sf_dir), "depth", 12, "deepest").select("x", "z", "deepest")


@query("shore_probability", sql(f"select x, z, round({R.shore_probability('steps', 'deepest', DUCK)}, 6) as p from near join widest using (x, z)", L1_SQL, WIDEST_SQL))
def shore_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = G.l1_distance(cells(spark, sf_dir), F.col("water"), "steps")
    found = G.l1_ball_max(near, "depth", 12, "deepest")
    return found.select("x", "z", F.round(column(R.shore_probability("steps", "deepest")), 6).alias("p"))


UNITS_SQL = f"units as (select x, z, case when water then 0 else {R.snow_units('(elev / 1000 - 1)', DUCK)} end as u from cells)"


@query("snow_limiter", sql("select a.x, a.z, cast(min(b.u + abs(a.x - b.x) + abs(a.z - b.z)) as int) as units from units a cross join units b group by a.x, a.z", UNITS_SQL))
def snow_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.when(F.col("water"), 0).otherwise(column(R.snow_units("(elev / 1000 - 1)")))
    return G.l1_min(cells(spark, sf_dir), units, "units").select("x", "z", F.col("units").cast("int").alias("units"))


CHAMFER_SQL = """chamfer as (select a.x, a.z, a.water, case when a.water then min(3 * greatest(abs(a.x - b.x), abs(a.z - b.z)) + least(abs(a.x - b.x), abs(a.z - b.z))) else 0 end / 3.0 as distance
  from cells a cross join (select x, z from cells where not water) b group by a.x, a.z, a.water)"""


@query("chamfer_distance", sql("select x, z, round(distance, 6) as distance from chamfer", CHAMFER_SQL))
def chamfer_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.chamfer(cells(spark, sf_dir).select("x", "z", "water"))
    return found.select("x", "z", F.round("distance", 6).alias("distance"))


@query("water_depth", sql(
    f"select x, z, {R.underwater_relief('d', 'water', texts(R.relief_noise(), 'x', 'z', DUCK), DUCK)} as depth from (select x, z, water, {R.depth_curve('distance', 'water', DUCK)} as d from chamfer)", CHAMFER_SQL))
def water_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.water_depth(cells(spark, sf_dir).select("x", "z", "water")).select("x", "z", "depth")


@query("naturalise_edges", sql(
    f"""select a.x, a.z, case when core then true
      when water and near12 and neighbours >= 5 and {R.naturalise_score(texts(R.edge_noise(), 'a.x', 'a.z', DUCK), DUCK)} < -0.26 then false
      when not water and near13 and neighbours >= 3 and {R.naturalise_score(texts(R.edge_noise(), 'a.x', 'a.z', DUCK), DUCK)} > 0.34 then true else water end as water
    from (select c.x, c.z, c.water, c.water and c.d >= 3 as core,
      exists(select 1 from prelim b where b.water and b.d >= 3 and abs(b.x - c.x) + abs(b.z - c.z) <= 12) as near12,
      exists(select 1 from prelim b where b.water and b.d >= 3 and abs(b.x - c.x) + abs(b.z - c.z) <= 13) as near13,
      (select count(*) from prelim b where b.water and abs(b.x - c.x) <= 1 and abs(b.z - c.z) <= 1 and (b.x <> c.x or b.z <> c.z)) as neighbours
      from prelim c) a""",
    CHAMFER_SQL, f"prelim as materialized (select x, z, water, {R.depth_curve('distance', 'water', DUCK)} as d from chamfer)"))
def naturalise_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.naturalise(cells(spark, sf_dir).select("x", "z", "water")).select("x", "z", F.col("natural").alias("water"))


def _lake_sql(search: int = W.SEARCH, flat: int = 4, relax: int = 4) -> str:
    """A step of spreading or relaxing after another, each over the four neighbours."""
    near = [f"{f}(level) over ({ALONG[a]})" for a in ("x", "z") for f in ("lag", "lead")]
    kept = "x, z, base, water, depth, core"
    steps = [f"lake0 as (select x, z, base, water, depth, water and depth >= {W.CORE} as core, case when water and depth >= {W.CORE} then base + 1 end as level from (select *, cast(floor(elev / 12) as int) as base from cells))"]
    for k in range(search):
        ramp = "least(greatest(base, near - 1), near + 1)"
        ramp = f"case when abs(base - near) <= 1 then near else {ramp} end" if k < flat else ramp
        steps.append(f"lake{k + 1} as materialized (select {kept}, case when water and level is null and near is not null then {ramp} else level end as level from (select *, greatest({', '.join(near)}) as near from lake{k}))")
    for k in range(search, search + relax):
        moves = "level is not null and not core and low <= high and (level < low or level > high)"
        steps.append(f"lake{k + 1} as materialized (select {kept}, case when {moves} then least(greatest(level, low), high) else level end as level from (select *, greatest({', '.join(near)}) - 1 as low, least({', '.join(near)}) + 1 as high from lake{k}))")
    return sql(f"select x, z, base as base_y, water, depth, cast(coalesce(level, base) as int) as y, level is not null as lake from lake{search + relax}", *steps)


@query("lake_levels", _lake_sql())
def lake_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).select("x", "z", "water", "depth", F.expr("cast(floor(elev / 12) as int)").alias("base_y"))
    return W.lake_levels(rows)


BED_SQL = f"""bed as (select x, z, depth, water, coalesce(greatest({', '.join(_NEAR)}), 0) as relief,
  {', '.join(f'{e} as {c}' for c, e in texts(R.LAKEBED_NOISE, 'x', 'z', DUCK).items())}, {R.habitat(texts(R.HABITAT_NOISE, 'x', 'z', DUCK), DUCK)} as habitat from cells),
material as (select *, {R.lakebed('depth', 'relief', '(x % 16 > 2)', DUCK)} as bed from bed)"""


def bedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).withColumn("relief", G.relief4("depth"))
    rows = with_noise(rows, R.LAKEBED_NOISE | R.HABITAT_NOISE).withColumn("habitat", column(R.habitat(_SAME(R.HABITAT_NOISE))))
    return rows.withColumn("bed", column(R.lakebed("depth", "relief", "(x % 16 > 2)")))


@query("lakebed_material", sql("select x, z, bed from material", BED_SQL))
def lakebed_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bedded(spark, sf_dir).select("x", "z", "bed")


@query("aquatic_vegetation", sql(f"select x, z, {R.aquatic_plant('depth', 'bed', 'relief', 'x', 'z', DUCK)} as plant from material", BED_SQL))
def aquatic_vegetation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bedded(spark, sf_dir).select("x", "z", column(R.aquatic_plant("depth", "bed", "relief", "x", "z")).alias("plant"))


@query("lakebed_share", sql("select bed, count(*) as n, round(count(*) / (select count(*) from material where water), 6) as share from material where water group by bed", BED_SQL))
def lakebed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bedded(spark, sf_dir).where("water").groupBy("bed").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("bed", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


# ---- the surface -------------------------------------------------------------------------------------------------------------
SURFACE_SQL = f"""noisy as (select *, {', '.join(f'{e} as {c}' for c, e in R.fields(texts(R.field_noise(), 'x', 'z', DUCK), 'x', 'z', 1234, DUCK).items())} from slopes),
ground as (select *, {R.surface(d=DUCK, names=True)} as surface, {R.snow_amount('elev', 'slope', 'north', DUCK)} as snow from noisy),
wooded as (select *, {R.forest_probability('elev', 'landcover', 'slope', 'north', 'surface', "(landcover % 9)", DUCK)} as p from ground),
painted as (select *, {R.leaf('p', 'elev', 'r')} as leaf from wooded)"""


def painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with its noise fields, surface, snow, forest and leaves."""
    rows = slopes(cells(spark, sf_dir))
    noise = R.field_noise()
    rows = with_noise(rows, noise).withColumns({c: column(e) for c, e in R.fields(_SAME(noise), "x", "z", 1234).items()})
    rows = rows.withColumns({"surface": column(R.surface(names=True)), "snow": column(R.snow_amount("elev", "slope", "north"))})
    rows = rows.withColumn("p", column(R.forest_probability("elev", "landcover", "slope", "north", "surface", "(landcover % 9)")))
    return rows.withColumn("leaf", column(R.leaf("p", "elev", "r")))


@query("surface_ladder", sql("select x, z, surface from painted", SLOPES_SQL, SURFACE_SQL))
def surface_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return painted(spark, sf_dir).select("x", "z", "surface")


@query("snow_amount", sql(_rounded_sql("snow") + " from painted", SLOPES_SQL, SURFACE_SQL))
def snow_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(painted(spark, sf_dir), "snow")


@query("forest_probability", sql(_rounded_sql("p") + " from painted", SLOPES_SQL, SURFACE_SQL))
def forest_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(painted(spark, sf_dir), "p")


@query("leaf_ladder", sql("select x, z, leaf from painted", SLOPES_SQL, SURFACE_SQL))
def leaf_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return painted(spark, sf_dir).select("x", "z", "leaf")


_RGB = lambda d: {c: R.colour(k, "surface", "leaf", "p", "(landcover % 9)", d) for k, c in enumerate("rgb")}


@query("rgb_composite", sql("select x, z, " + ", ".join(f"{e} as {c}" for c, e in _RGB(DUCK).items()) + " from painted", SLOPES_SQL, SURFACE_SQL))
def rgb_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return painted(spark, sf_dir).select("x", "z", *[column(e).alias(c) for c, e in _RGB(SPARK).items()])


_DECOR_SQL = ", ".join(f"round({e}, 6) as {c}" for c, e in R.decor_fields(texts(R.DECOR_NOISE, "x", "z", DUCK), DUCK).items())


@query("decor_fields", sql(f"select x, z, {_DECOR_SQL} from slopes", SLOPES_SQL))
def decor_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_noise(slopes(cells(spark, sf_dir)), R.DECOR_NOISE)
    return rows.select("x", "z", *[F.round(column(e), 6).alias(c) for c, e in R.decor_fields(_SAME(R.DECOR_NOISE)).items()])


@query("grid_class_share", sql(
    f"select block, count(*) as n, round(count(*) / 4096.0, 6) as share from (select {pick(white_noise('x', 'z', 1236, DUCK), 'meadow', DUCK, True)} as block from cells) group by block"))
def grid_class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lineitem to cells to noise to weighted blocks to shares."""
    picked = cells(spark, sf_dir).select(column(pick(white_noise("x", "z", 1236), "meadow", names=True)).alias("block"))
    counts = picked.groupBy("block").agg(F.count("*").alias("n"))
    # the blocks of a zone are few: a window over their counts, not over cells
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select("block", "n", F.round(F.col("n") / total, 6).alias("share"))


_LUMA, _SAT = "0.2126 * r + 0.7152 * g + 0.0722 * b", "(greatest(r, g, b) - least(r, g, b)) / (greatest(r, g, b) + 0.000001)"
_BLOCK_ROWS = ", ".join(f"('{k}', '{n}', {r}.0, {g}.0, {b}.0)" for k, n, r, g, b in BLOCKS)


@query("luma_sat_sorted", f"select key, round({_LUMA}, 1) as luma, round({_SAT}, 6) as sat from (select * from (values {_BLOCK_ROWS}) t(key, name, r, g, b)) where {_SAT} < 0.18")
def luma_sat_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greyish blocks from dark to light."""
    blocks = spark.createDataFrame([(k, n, float(r), float(g), float(b)) for k, n, r, g, b in BLOCKS], "key string, name string, r double, g double, b double")
    rows = blocks.select("key", F.round(F.expr(_LUMA), 1).alias("luma"), F.round(F.expr(_SAT), 6).alias("sat"), F.expr(_SAT).alias("s"))
    return rows.where("s < 0.18").drop("s").orderBy("luma", "key")


@query("quantise_u16", sql(f"select x, z, {R.quantised('elev', '(select min(elev) from cells)', '(select max(elev) from cells)', DUCK)} as px from cells"))
def quantise_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    ends = rows.agg(F.min("elev").alias("low"), F.max("elev").alias("high"))
    return rows.crossJoin(F.broadcast(ends)).select("x", "z", column(R.quantised("elev", "low", "high")).alias("px"))
