"""Queries of counting, sampling, ledgers and vector features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.dialect import DUCK, column
from gridloom.operators import features, ledger
from gridloom.operators import grid as G
from gridloom.operators import rules as R
from gridloom.plans.fixture import cells, sql
from gridloom.plans.grid_queries import SLOPES_SQL, SURFACE_SQL, painted
from gridloom.plans.registry import query

_DIM = "dim as (select * from (values " + ", ".join(f"({k}, '{n}')" for k, n in enumerate([*R.LANDCOVER, "unused"])) + ") t(landcover, name))"


@query("class_histogram", sql("select d.landcover, d.name, count(c.x) as n, round(count(c.x) / 4096.0, 6) as share from dim d left join cells c using (landcover) group by d.landcover, d.name", _DIM))
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class of the dictionary, those without cells too."""
    dim = spark.createDataFrame(list(enumerate([*R.LANDCOVER, "unused"])), "landcover int, name string")
    counts = cells(spark, sf_dir).groupBy("landcover").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    n = F.coalesce("n", F.lit(0))
    return dim.join(counts, "landcover", "left").crossJoin(F.broadcast(total)).select("landcover", "name", n.alias("n"), F.round(n / F.col("t"), 6).alias("share"))


@query("share_desc", sql("select landcover, count(*) as n, row_number() over (order by count(*) desc, landcover) as place from cells group by landcover"))
def share_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by their cells; the place is a window over as many rows as there are classes."""
    counts = cells(spark, sf_dir).groupBy("landcover").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("one").orderBy(F.desc("n"), "landcover"))).drop("one")


@query("median_depth", sql("select cast(trunc(median(depth)) as int) as median, min(depth) as low, max(depth) as high, round(stddev_pop(depth), 6) as spread from cells where water"))
def median_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where("water").agg(F.median("depth").cast("int").alias("median"), F.min("depth").alias("low"), F.max("depth").alias("high"), F.round(F.stddev_pop("depth"), 6).alias("spread"))


@query("mask_coverage", sql("select count(*) filter (water) as wet, round(avg(case when water then 1.0 else 0.0 end), 6) as share from cells"))
def mask_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).agg(F.count_if("water").alias("wet"), F.round(F.avg(F.col("water").cast("int")), 6).alias("share"))


@query("mask_diff", sql("select count(*) filter (landcover = 9 and not water) as removed, count(*) filter (landcover <> 9 and water) as added, count(*) filter (landcover = 9 and water) as both_ from cells"))
def mask_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    was = F.col("landcover") == 9
    return cells(spark, sf_dir).agg(F.count_if(was & ~F.col("water")).alias("removed"), F.count_if(~was & F.col("water")).alias("added"), F.count_if(was & F.col("water")).alias("both_"))


_Y, _AVAILABLE = R.dequantised_y("hm", DUCK), f"greatest(0, {R.dequantised_y('hm', DUCK)} - ({R.FILL_BOTTOM} + 1))"


def preflight_of(rows: DataFrame, px: str = "hm", depth: str = "depth", water: str = "water", bottom: int = R.FILL_BOTTOM) -> DataFrame:
    """One row: wet columns, those without room for their depth, the blocks that are missing, and the bottom they need."""
    wet = rows.where(water).withColumn("y", column(R.dequantised_y(px))).withColumn("room", F.greatest(F.lit(0), F.col("y") - (bottom + 1)))
    short = F.col(depth) - F.col("room")
    zero = F.lit(0)
    return wet.agg(
        F.count("*").alias("columns"), F.count_if(short > 0).alias("clipped_columns"), F.coalesce(F.sum(F.when(short > 0, short)), zero).cast("long").alias("clipped_blocks"),
        F.coalesce(F.max(depth), zero).alias("max_requested"), F.coalesce(F.max("room"), zero).alias("max_available"), F.least(F.lit(318), F.min(F.col("y") - F.col(depth) - 1)).alias("required_fill_bottom"),
    )


@query("preflight", sql(f"""select count(*) as columns, count(*) filter (depth * 20 > room) as clipped_columns, cast(coalesce(sum(depth * 20 - room) filter (depth * 20 > room), 0) as bigint) as clipped_blocks,
  coalesce(max(depth * 20), 0) as max_requested, coalesce(max(room), 0) as max_available, least(318, min(y - depth * 20 - 1)) as required_fill_bottom from (select depth, {_AVAILABLE} as room, {_Y} as y from cells where water)"""))
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight_of(cells(spark, sf_dir).withColumn("depth", F.col("depth") * 20))


def validation_of(rows: DataFrame, most: int = R.MAX_DEPTH) -> DataFrame:
    """One row: wet cells without depth, dry cells with some, depths that are too great, and the greatest."""
    return rows.agg(
        F.count_if(F.col("water") & (F.col("depth") == 0)).alias("wet_without_depth"), F.count_if(~F.col("water") & (F.col("depth") > 0)).alias("dry_with_depth"),
        F.count_if(F.col("depth") > most).alias("too_deep"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"),
    )


@query("validate_inputs", sql("select count(*) filter (water and d = 0) as wet_without_depth, count(*) filter (not water and d > 0) as dry_with_depth, count(*) filter (d > 30) as too_deep, max(d) as deepest from (select water, cast((depth * 7 + x) % 33 as int) as d from cells)"))
def validate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation_of(cells(spark, sf_dir).withColumn("depth", F.expr("cast((depth * 7 + x) % 33 as int)")))


_TILES = "tiles as (select cast(a.range * 16 as int) as x0, cast(b.range * 16 as int) as z0 from range(4) a cross join range(4) b)"


def pending_of(events: DataFrame) -> DataFrame:
    """The next five tiles that no event stands for."""
    tiles = G.grid(events.sparkSession, 4, 4).select((F.col("x") * 16).alias("x0"), (F.col("z") * 16).alias("z0"))
    done = events.select(F.concat_ws(",", F.col("event_id") % 4 * 16, F.col("user_id") % 3 * 16).alias("tile_key"))
    return ledger.pending(tiles, done, 5).select("tile_key", "x0", "z0")


@query("pending_tiles", f"with {_TILES}, done as (select distinct concat(event_id % 4 * 16, ',', user_id % 3 * 16) as tile_key from events) select concat(x0, ',', z0) as tile_key, x0, z0 from tiles where concat(x0, ',', z0) not in (select tile_key from done) order by x0, z0 limit 5")
def pending_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next five tiles that the ledger, here every event, does not name."""
    return pending_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("width_lookup_default", "select n_nationkey, kind, cast(coalesce(w, 4) as double) as width from (select n_nationkey, ['river','canal','stream','ditch','drain','brook','weir'][n_nationkey % 7 + 1] as kind from nation) n left join (values ('river', 12), ('canal', 8), ('stream', 4), ('ditch', 2), ('drain', 2)) t(k, w) on k = kind")
def width_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["river", "canal", "stream", "ditch", "drain", "brook", "weir"]))
    lines = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.element_at(kinds, (F.col("n_nationkey") % 7 + 1).cast("int")).alias("kind"))
    widths = spark.createDataFrame([(k, float(w)) for k, w in R.WIDTHS.items()], "kind string, width double")
    return features.with_width(lines, widths, "kind", float(R.WIDTH))


def boxes_of(orders: DataFrame, priority: Column) -> DataFrame:
    """The cells of each order's box; of several boxes on a cell the code of the greatest priority."""
    boxes = orders.select("o_orderkey", (F.col("o_orderkey") * 13 % 70 - 3 + F.lit(0.5)).alias("x0"), (F.col("o_orderkey") * 29 % 70 - 3 + F.lit(0.25)).alias("z0"), ((F.col("o_custkey") % 9).cast("int") + 1).alias("code"))
    boxes = boxes.withColumns({"x1": F.col("x0") + F.col("code"), "z1": F.col("z0") + 3, "priority": priority})
    return features.rasterised(features.cells_of_box(boxes, 64, 64), "code", "priority")


@query("rasterise_box", """with boxes as (select distinct o_orderkey * 13 % 70 - 3 + 0.5 as x0, o_orderkey * 29 % 70 - 3 + 0.25 as z0, cast(o_custkey % 9 as int) + 1 as code from orders)
  select cast(g.range as int) as x, cast(h.range as int) as z, max(code) as code from range(64) g cross join range(64) h
  join boxes b on x0 < g.range + 1 and x0 + code >= g.range and z0 < h.range + 1 and z0 + 3 >= h.range group by 1, 2""")
def rasterise_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of all orders; keys of any size leave the codes' order alone."""
    return boxes_of(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.struct("code", "o_orderkey"))


def buffered(nations: DataFrame) -> DataFrame:
    """Cells within two of a line: lines give the cells of their boxes, which then are tested one by one."""
    n, c = F.col("n_nationkey").cast("double"), F.col
    lines = nations.select((4 * n - 20).alias("ax"), (2 * n).alias("az"), (70 - 2 * n).alias("bx"), (60 - n).alias("bz"))
    boxes = lines.withColumns({"x0": F.least("ax", "bx") - 2, "x1": F.greatest("ax", "bx") + 2, "z0": F.least("az", "bz") - 2, "z1": F.greatest("az", "bz") + 2})
    touched = features.cells_of_box(boxes, 64, 64)
    return touched.where(features.near_segment(c("x"), c("z"), c("ax"), c("az"), c("bx"), c("bz"), F.lit(2.0))).select("x", "z").distinct()


@query("buffer_line", sql("""select c.x, c.z from cells c join (select 4.0 * n_nationkey - 20 as x0, 2.0 * n_nationkey as z0, 70.0 - 2 * n_nationkey as x1, 60.0 - n_nationkey as z1 from nation) s
  on ((c.x - x0) * (x1 - x0) + (c.z - z0) * (z1 - z0)) between 0 and (x1 - x0) * (x1 - x0) + (z1 - z0) * (z1 - z0)
  and pow((c.x - x0) * (z1 - z0) - (c.z - z0) * (x1 - x0), 2) <= 4 * ((x1 - x0) * (x1 - x0) + (z1 - z0) * (z1 - z0)) group by c.x, c.z"""))
def buffer_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all nations."""
    return buffered(spark.read.parquet(f"{sf_dir}/nation.parquet"))


@query("resample_bilinear", sql("""select a.range as x, b.range as z, round(sum(c.elev * (1 - abs(a.range * 1.75 + 0.3 - c.x)) * (1 - abs(b.range * 1.75 + 0.3 - c.z))) / sum((1 - abs(a.range * 1.75 + 0.3 - c.x)) * (1 - abs(b.range * 1.75 + 0.3 - c.z))), 5) as v
  from range(36) a cross join range(36) b join cells c on abs(a.range * 1.75 + 0.3 - c.x) < 1 and abs(b.range * 1.75 + 0.3 - c.z) < 1 where c.landcover <> 7 group by 1, 2"""))
def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = cells(spark, sf_dir).where("landcover <> 7").select("x", "z", F.col("elev").alias("v"))
    found = features.resampled(G.grid(spark, 36, 36), source, 1.75, 0.3)
    return found.select(F.col("x").cast("long").alias("x"), F.col("z").cast("long").alias("z"), F.round("v", 5).alias("v"))


@query("tag_scan", "select p_partkey, p_brand, p_size from part where p_brand in ('Brand#12', 'Brand#23', 'Brand#34') and p_size between 5 and 20 and p_type is not null")
def tag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by tag and box; both filters reach the scan."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.where(F.col("p_brand").isin("Brand#12", "Brand#23", "Brand#34") & F.col("p_size").between(5, 20) & F.col("p_type").isNotNull()).select("p_partkey", "p_brand", "p_size")


@query("top_k_counts", "select event_type, n, place from (select event_type, count(*) as n, row_number() over (order by count(*) desc, event_type) as place from events group by event_type) where place <= 4")
def top_k_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four commonest types."""
    top = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(4).withColumn("one", F.lit(1))
    return top.withColumn("place", F.row_number().over(Window.partitionBy("one").orderBy(F.desc("n"), "event_type"))).drop("one")


@query("even_sample", sql("select x, z, k from (select x, z, row_number() over (order by z, x) - 1 as k, count(*) over () as m from cells where water) where k in (select cast(floor((m - 1) * i.range / 9.0) as bigint) from range(10) i)"))
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten wet cells evenly spaced in row-major order; ranks come from counts per row, not from one sort of all cells."""
    wet = cells(spark, sf_dir).where("water").select("x", "z")
    rows = wet.groupBy("z").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    upto = Window.partitionBy("one").orderBy("z").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = rows.select("z", (F.sum("n").over(upto) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy("one")).alias("m"))
    ranked = wet.withColumn("r", F.row_number().over(Window.partitionBy("z").orderBy("x"))).join(starts, "z").withColumn("k", F.col("start") + F.col("r") - 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.floor((F.col("m") - 1) * i / 9.0))
    return ranked.where(F.array_contains(wanted, F.col("k"))).select("x", "z", "k")


@query("strided_subsample", sql("select x, z, landcover from cells where (x - 3) % 8 = 0 and z % 8 = 0 and x >= 3"))
def strided_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where("pmod(x - 3, 8) = 0 and pmod(z, 8) = 0 and x >= 3").select("x", "z", "landcover")


@query("patch_slice", sql("select x >> 4 as cx, z >> 4 as cz, count(*) as n from cells where x >= 10 and x < 42 and z >= 5 and z < 37 group by 1, 2"))
def patch_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where("x >= 10 and x < 42 and z >= 5 and z < 37").groupBy(F.shiftright("x", 4).alias("cx"), F.shiftright("z", 4).alias("cz")).agg(F.count("*").alias("n"))


@query("fill_missing", sql("select x, z, round(coalesce(v, (select min(elev) from cells where landcover <> 7)), 6) as v from (select x, z, case when landcover <> 7 then elev end as v from cells)"))
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing elevations, as nulls or NaN, take the least known one."""
    rows = cells(spark, sf_dir).select("x", "z", F.when(F.col("landcover") == 7, F.lit(float("nan"))).otherwise(F.col("elev")).alias("v"))
    clean = rows.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return clean.crossJoin(F.broadcast(clean.agg(F.min("v").alias("low")))).select("x", "z", F.round(F.coalesce("v", "low"), 6).alias("v"))


@query("box_intersect", "select r_regionkey, greatest(r_regionkey * 10, 12) as x0, least(r_regionkey * 10 + 15, 40) as x1 from region where greatest(r_regionkey * 10, 12) < least(r_regionkey * 10 + 15, 40)")
def box_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source tiles' extents cut to the wanted one; those that miss it are not read."""
    tiles = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", F.greatest(F.col("r_regionkey") * 10, F.lit(12)).alias("x0"), F.least(F.col("r_regionkey") * 10 + 15, F.lit(40)).alias("x1"))
    return tiles.where("x0 < x1")


@query("surface_histogram", sql("select surface, count(*) as n from painted group by surface", SLOPES_SQL, SURFACE_SQL))
def surface_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return painted(spark, sf_dir).groupBy("surface").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "surface")


@query("meta_json", sql("select round(min(elev), 3) as low, round(max(elev), 3) as high, count(*) as cells from cells"))
def meta_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster's metadata, written as JSON and parsed again with a fixed schema."""
    row = cells(spark, sf_dir).agg(F.round(F.min("elev"), 3).alias("low"), F.round(F.max("elev"), 3).alias("high"), F.count("*").alias("cells"))
    return row.select(F.from_json(F.to_json(F.struct("*")), "low double, high double, cells long").alias("m")).select("m.*")


@query("mosaic_merge", "select cast(x as int) as x, cast(z as int) as z, arg_min(v, t) as v from (select l_suppkey % 20 as x, l_partkey % 20 as z, l_linenumber * 100000000 + l_orderkey as t, l_quantity as v from lineitem where l_quantity > 10) group by 1, 2")
def mosaic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping tiles: the first known value of each cell."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    value = F.when(F.col("l_quantity") > 10, F.col("l_quantity")).otherwise(F.lit(float("nan")))
    tiles = items.select((F.col("l_suppkey") % 20).cast("int").alias("x"), (F.col("l_partkey") % 20).cast("int").alias("z"), (F.col("l_linenumber") * 100000000 + F.col("l_orderkey")).alias("t"), value.alias("v"))
    return features.mosaic(tiles, "v", "t")


def _utm_sql() -> str:
    """The forward series, term by term."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    e, big = 2 * n**0.5 / (1 + n), a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    terms = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    sums = [f"({start} + " + " + ".join(f"{c!r} * {p}({2 * k} * xi) * {q}({2 * k} * eta)" for k, c in enumerate(terms, 1)) + ")" for start, p, q in (("eta", "cos", "sinh"), ("xi", "sin", "cosh"))]
    return f"""with placed as (select c_custkey, (c_custkey * 37 % 3600) / 10 - 180 as lon, (c_custkey * 17 % 1600) / 10 - 80 as lat from customer),
      zoned as (select *, cast(trunc((lon + 180) / 6) as int) + 1 as zone from placed),
      bent as (select *, radians(lon - (zone * 6 - 183)) as away, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) as t from zoned),
      flat as (select *, atan2(t, cos(away)) as xi, atanh(sin(away) / sqrt(1 + t * t)) as eta from bent)
      select c_custkey, zone, round(500000 + {0.9996 * big!r} * {sums[0]}, 3) as east, round(case when lat < 0 then 10000000 else 0 end + {0.9996 * big!r} * {sums[1]}, 3) as north from flat"""


@query("utm_points", _utm_sql())
def utm_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' invented places in their zones."""
    who = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", ((F.col("c_custkey") * 37 % 3600) / 10 - 180).alias("lon"), ((F.col("c_custkey") * 17 % 1600) / 10 - 80).alias("lat"))
    placed = who.withColumn("zone", column("cast((lon + 180) / 6 as int) + 1"))
    east, north = features.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    return placed.select("c_custkey", "zone", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))
