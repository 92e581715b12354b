"""Queries on sparse points, templates and volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.dialect import DUCK, column
from gridloom.functions.hashing import bhash
from gridloom.operators import points as P
from gridloom.operators import voxels as V
from gridloom.plans.fixture import cells, sql
from gridloom.plans.grid_queries import BED_SQL, bedded
from gridloom.plans.registry import query

_BOX = (0, 64, 0, 64)


def _candidates_sql(layer: P.Layer) -> str:
    low, high = -32 // layer.step - 2, 96 // layer.step + 3
    return (
        f"{layer.name} as materialized (select gx, gz, {P.place('x', layer.salt, layer.step, layer.jitter, DUCK)} as x, {P.place('z', layer.salt, layer.step, layer.jitter, DUCK)} as z"
        f" from (select a.range as gx, b.range as gz from range({low}, {high}) a cross join range({low}, {high}) b) where {P.chance(layer.salt, DUCK)} <= {layer.chance})"
    )


_INSIDE = "x between 0 and 63 and z between 0 and 63"
_CLEAR = lambda layer, r: f"not exists (select 1 from {layer} o where (o.x - p.x) * (o.x - p.x) + (o.z - p.z) * (o.z - p.z) < {r * r})"
SLOTS_SQL = ", ".join(map(_candidates_sql, P.LAYERS)) + f""",
slots as materialized (select 'emergent' as layer, x, z, 'big' as size from emergent p where {_INSIDE}
  union all select 'canopy', x, z, 'normal' from canopy p where {_INSIDE} and {_CLEAR('emergent', 11)}
  union all select 'under', x, z, 'small' from under p where {_INSIDE} and {_CLEAR('emergent', 11)} and {_CLEAR('canopy', 5)})"""


@query("jittered_candidates", f"with {_candidates_sql(P.LAYERS[1])} select 'canopy' as layer, gx, gz, x, z from canopy where {_INSIDE}")
def jittered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.candidates(spark, P.LAYERS[1], -32, 96, -32, 96)
    return found.where(F.col("x").between(0, 63) & F.col("z").between(0, 63))


@query("proximity_anti", f"with {SLOTS_SQL} select * from slots")
def proximity_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.slots(spark, *_BOX)


_ROLL = bhash("x", "z", 77, DUCK)
_KIND, _GROWN = P.species("elev", "size", "roll")
TREES_SQL = f"trees as materialized (select *, {_KIND} as kind, {_GROWN} as grown from (select row_number() over (order by s.x, s.z, s.layer) as id, s.x, s.z, s.layer, s.size, c.elev, {bhash('s.x', 's.z', 77, DUCK)} as roll from slots s join cells c on c.x = s.x and c.z = s.z where not c.water))"


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = P.slots(spark, *_BOX).join(cells(spark, sf_dir).where(~F.col("water")).select("x", "z", "elev"), ["x", "z"])
    met = met.withColumn("roll", column(bhash("x", "z", 77)))
    return met.withColumns({"kind": column(_KIND), "grown": column(_GROWN)})


@query("point_sample", sql("select x, z, layer, kind, grown from trees", SLOTS_SQL, TREES_SQL))
def point_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir).select("x", "z", "layer", "kind", "grown")


# a catalogue of templates: kind, variant, size, snowy, and blocks as (dx, dy, dz, name)
_CATALOGUE = [
    (kind, f"{kind}_{size}{'_snowy' if snowy else ''}_{k}", size, snowy, [(0, y, 0, f"{kind}_log") for y in range(h)] + [(dx, h, dz, f"{kind}_leaves") for dx in (-1, 0, 1) for dz in (-1, 0, 1)] + ([(1, 0, 0, f"{kind}_log")] if h > 3 else []))
    for kind, size, snowy, k, h in [
        ("spruce", "big", False, 0, 5), ("spruce", "normal", False, 0, 4), ("spruce", "normal", False, 1, 3), ("spruce", "small", True, 0, 2),
        ("oak", "big", False, 0, 4), ("oak", "small", False, 0, 2), ("birch", "normal", False, 0, 4), ("azalea", "small", False, 0, 1),
    ]
]
_VARIANTS_SQL = "variants as (select * from (values " + ", ".join(f"('{k}', '{v}', '{s}', {str(w).lower()})" for k, v, s, w, _ in _CATALOGUE) + ") t(kind, variant, size, snowy))"
_BLOCKS_SQL = "template as (select * from (values " + ", ".join(f"('{v}', {dx}, {dy}, {dz}, '{n}')" for _, v, _, _, bs in _CATALOGUE for dx, dy, dz, n in bs) + ") t(variant, dx, dy, dz, name))"


def _catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CATALOGUE, "kind string, variant string, size string, snowy boolean, blocks array<struct<dx: int, dy: int, dz: int, name: string>>")


CHOSEN_SQL = """levels as (select t.id, t.x, t.z, t.roll, v.variant, case when v.size = t.grown and v.snowy = (t.elev > 1700) then 0 when v.snowy = (t.elev > 1700) then 1 when v.size = t.grown then 2 else 3 end as level
  from trees t join variants v on v.kind = t.kind),
ranked as (select *, row_number() over (partition by id order by variant) - 1 as k, count(*) over (partition by id) as m from (select *, min(level) over (partition by id) as best from levels) where level = best),
chosen as materialized (select x, z, variant from ranked where k = least(cast(floor(roll * m) as int), m - 1))"""


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _trees(spark, sf_dir).select("x", "z", "kind", F.col("grown").alias("size"), (F.col("elev") > 1700).alias("snowy"), "roll")
    return P.best_variants(wanted, _catalogue(spark)).select("x", "z", "variant")


@query("variant_cascade", sql("select * from chosen", SLOTS_SQL, TREES_SQL, _VARIANTS_SQL, CHOSEN_SQL))
def variant_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir)


@query("template_expand", sql("select c.variant, c.x as px, c.z as pz, c.x + dx as x, dy, c.z + dz as z, name from chosen c join template using (variant)", SLOTS_SQL, TREES_SQL, _VARIANTS_SQL, CHOSEN_SQL, _BLOCKS_SQL))
def template_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.expand(_chosen(spark, sf_dir), _catalogue(spark).select("variant", "blocks"), ["variant"])


@query("base_height", sql(
    """select c.x as px, c.z as pz, coalesce(min(s.y), max(m.y)) + 1 as base from chosen c
    left join template t on t.variant = c.variant and t.dy <= 2 and not contains(t.name, 'leaves')
    left join (select x, z, cast(floor(elev / 7) as int) as y from cells) s on s.x = c.x + t.dx and s.z = c.z + t.dz
    left join (select x, z, cast(floor(elev / 7) as int) as y from cells) m on m.x = c.x and m.z = c.z group by c.x, c.z""",
    SLOTS_SQL, TREES_SQL, _VARIANTS_SQL, CHOSEN_SQL, _BLOCKS_SQL))
def base_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = cells(spark, sf_dir).select("x", "z", F.floor(F.col("elev") / 7).cast("int").alias("y"))
    blocks = P.expand(_chosen(spark, sf_dir), _catalogue(spark).select("variant", "blocks"), ["variant"])
    return P.base_heights(blocks, surface)


@query("rotate_offsets", "select * from (values (0, 3, 1), (1, -1, 3), (2, -3, -1), (3, 1, -3), (5, -1, 3)) t(turns, dx, dz)")
def rotate_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(6).where("id <> 4").select(F.col("id").cast("int").alias("turns"))
    dx, dz = P.rotated(F.lit(3), F.lit(1), F.col("turns"))
    return rows.select("turns", dx.alias("dx"), dz.alias("dz"))


@query("template_stats", f"with {_BLOCKS_SQL} select variant, max(dy) + 1 as height, 2 * max(greatest(abs(dx), abs(dz))) + 1 as width, count(*) as n from template group by variant")
def template_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = "transform(blocks, b -> {})".format
    return _catalogue(spark).select(
        "variant", F.expr(f"array_max({b('b.dy')}) + 1").alias("height"), F.expr(f"2 * array_max({b('greatest(abs(b.dx), abs(b.dz))')}) + 1").alias("width"), F.size("blocks").cast("long").alias("n")
    )


# trunk middles are floored, also for negative sums
@query("template_centre", f"""with {_BLOCKS_SQL}, moved as (select variant, dx + 7 as x, dy - 2 as y, dz - 6 as z, name from template),
  low as (select variant, min(y) as y0 from moved group by variant),
  mid as (select m.variant, cast(floor((min(x) + max(x)) / 2.0) as int) as cx, cast(floor((min(z) + max(z)) / 2.0) as int) as cz from moved m join low using (variant) where y <= y0 + 1 and not contains(name, 'leaves') group by m.variant)
  select m.variant, x - cx as dx, y - y0 as dy, z - cz as dz, name from moved m join low using (variant) join mid using (variant)""")
def template_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = _catalogue(spark).select("variant", F.explode("blocks").alias("b")).select("variant", (F.col("b.dx") + 7).alias("x"), (F.col("b.dy") - 2).alias("y"), (F.col("b.dz") - 6).alias("z"), F.col("b.name").alias("name"))
    low = moved.groupBy("variant").agg(F.min("y").alias("y0"))
    trunk = moved.join(low, "variant").where((F.col("y") <= F.col("y0") + 1) & ~F.col("name").contains("leaves"))
    half = lambda c: F.floor((F.min(c) + F.max(c)) / 2.0).cast("int")
    mid = trunk.groupBy("variant").agg(half("x").alias("cx"), half("z").alias("cz"))
    met = moved.join(low, "variant").join(mid, "variant")
    return met.select("variant", (F.col("x") - F.col("cx")).alias("dx"), (F.col("y") - F.col("y0")).alias("dy"), (F.col("z") - F.col("cz")).alias("dz"), "name")


@query("tree_crown", """select 0 as dx, cast(range as int) as dy, 0 as dz, 'log' as kind from range(5) union all
  select cast(a.range as int), cast(y.range as int), cast(b.range as int), 'leaf' from range(-2, 3) a cross join range(-2, 3) b cross join range(3, 7) y
  where a.range * a.range + b.range * b.range <= case when y.range < 5 then 6 else 2 end and not (a.range = 0 and b.range = 0 and y.range < 5)""")
def tree_crown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.crown(spark, 5)


@query("boulder_shape", """select cast(a.range as int) as dx, cast(y.range as int) as dy, cast(b.range as int) as dz from range(-2, 3) a cross join range(-2, 3) b cross join range(0, 3) y
  where a.range * a.range + b.range * b.range + y.range * y.range <= 6""")
def boulder_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.boulder(spark, 2)


@query("column_runs", sql("""select * from (select x, z, -64 as low, cast(floor(elev / 12) as int) - depth as high, 'stone' as block from cells
  union all select x, z, cast(floor(elev / 12) as int) - depth + 1, cast(floor(elev / 12) as int), 'water' from cells) where low <= high"""))
def column_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.column_runs(cells(spark, sf_dir).withColumn("y", F.floor(F.col("elev") / 12).cast("int")), "y", "depth", -64)


_WRITES = """select x, cast(y as int) as y, z, block, p from (select x, z, unnest(range(100, 104)) as y, 'stone' as block, 1 as p from cells
  union all select x, z, unnest(range(102, 106)), 'water', 2 from cells where water union all select x, z, 103, 'plant', 3 from cells where depth > 2)"""


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    write = lambda low, high, block, p: ("x", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("y"), "z", F.lit(block).alias("block"), F.lit(p).alias("p"))
    solid, wet = rows.select(*write(100, 103, "stone", 1)), rows.where("water").select(*write(102, 105, "water", 2))
    return solid.unionByName(wet).unionByName(rows.where("depth > 2").select(*write(103, 103, "plant", 3)))


@query("voxel_resolve", sql(f"select x, y, z, arg_max(block, p) as block from ({_WRITES}) group by x, y, z"))
def voxel_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.resolved(_writes(spark, sf_dir), "p")


@query("first_write_wins", sql(f"select x, y, z, arg_min(block, p) as block from ({_WRITES}) group by x, y, z"))
def first_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.resolved(_writes(spark, sf_dir), "p", keep="first")


@query("chunk_mode", sql("select cx, cz, arg_min(landcover, rank) as landcover from (select x >> 4 as cx, z >> 4 as cz, landcover, -count(*) * 100 + landcover as rank from cells group by 1, 2, 3) group by cx, cz"))
def chunk_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.chunk_mode(cells(spark, sf_dir), "landcover")


@query("tile_manifest", sql("""select concat('hm_x', x0, '_z', z0, '.png') as name, x0, z0, max(x) as x1, max(z) as z1, max(x) - x0 + 1 as width, max(z) - z0 + 1 as height, min(hm) as low, max(hm) as high
  from (select *, x // 20 * 20 as x0, z // 20 * 20 as z0 from cells) group by x0, z0"""))
def tile_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tile_manifest(cells(spark, sf_dir), "hm", 20)


_WOOD = "(case when landcover % 3 = 0 then {} else 0.05 end)"


@query("tree_accept", sql(f"""select layer, x, z from (select s.layer, s.x, s.z, {_WOOD.format(bhash('s.x', 's.z', 55, DUCK))} as p from slots s join cells c on c.x = s.x and c.z = s.z)
  where p > 0.02 and {bhash('x', 'z', 177, DUCK)} <= p and not (layer = 'emergent' and p < 0.60)""", SLOTS_SQL))
def tree_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = P.slots(spark, *_BOX).join(cells(spark, sf_dir).select("x", "z", "landcover"), ["x", "z"])
    met = met.withColumns({"p": column(_WOOD.format(bhash("x", "z", 55))), "roll": column(bhash("x", "z", 177))})
    return P.accepted(met, "p", "roll").select("layer", "x", "z")


_CHANCE, _RADIUS = P.boulder_chance("bed", "relief", DUCK), f"case when {bhash('b.x', 'b.z', 4043, DUCK)} < 0.24 then 2 else 1 end"


@query("underwater_boulders", sql(f"""select r.px, r.pz, cast(r.px + a.range as int) as x, cast(r.pz + c.range as int) as z, cast(y.range as int) as dy
  from (select b.x as px, b.z as pz, {_RADIUS} as radius from boulder b join material m on m.x = least(greatest(b.x, 0), 63) and m.z = least(greatest(b.z, 0), 63)
    where b.x between -2 and 65 and b.z between -2 and 65 and m.water and m.depth between 4 and 22 and {bhash('b.x', 'b.z', 4042, DUCK)} <= {_CHANCE} * 4) r
  join range(-2, 3) a on abs(a.range) <= radius join range(-2, 3) c on abs(c.range) <= radius join range(2) y on y.range = 0 or (radius = 2 and abs(a.range) + abs(c.range) <= 1)
  where a.range * a.range + c.range * c.range <= radius * radius + radius - 1""", BED_SQL, _candidates_sql(P.BOULDERS)))
def underwater_boulders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boulders on beds of some depth, their columns; four times the usual chance, as the grid is small."""
    found = P.candidates(spark, P.BOULDERS, -32, 96, -32, 96).where("x between -2 and 65 and z between -2 and 65").select("x", "z")
    met = P.sampled(found, bedded(spark, sf_dir).select("x", "z", "water", "depth", "relief", "bed"), 64, 64, clamp=True)
    kept = met.where(F.col("water") & F.col("depth").between(4, 22) & column(f"{bhash('x', 'z', 4042)} <= {P.boulder_chance('bed', 'relief')} * 4"))
    return P.mounds(kept.withColumn("radius", F.when(column(f"{bhash('x', 'z', 4043)} < 0.24"), 2).otherwise(1)))


_ZONE = "case landcover % 3 when 0 then 'forest' when 1 then 'alpine' else 'meadow' end"


@query("decor_points", sql(f"""select * from (select p.x, p.z, {P.decor_kind(bhash('p.x', 'p.z', 61, DUCK), f'({_ZONE})')} as kind from decor p join cells c on c.x = p.x and c.z = p.z where not water) where kind is not null""", _candidates_sql(P.DECOR)))
def decor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = P.candidates(spark, P.DECOR, -32, 96, -32, 96).select("x", "z").join(cells(spark, sf_dir).where("not water").select("x", "z", "landcover"), ["x", "z"])
    return met.select("x", "z", column(P.decor_kind(bhash("x", "z", 61), f"({_ZONE})")).alias("kind")).where("kind is not null")
