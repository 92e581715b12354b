"""Sparse points on grids: jittered candidates, thinning by layers, templates, shapes.

Draws are hashes of the grid place and a salt, so that any partition of the plane sees the same points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.dialect import SPARK, Dialect, column
from gridloom.functions.hashing import bhash

#: How far candidates move from their place's middle, in places (fixed value).
JITTER = 0.42


@dataclass(frozen=True)
class Layer:
    name: str
    step: int
    chance: float
    radius: int
    salt: int
    size: str
    jitter: float = JITTER


# fixed values: grids of boulders under water and of decoration, with their own jitter
BOULDERS = Layer("boulder", 19, 1.0, 0, 4041, "any", 0.36)
DECOR = Layer("decor", 13, 1.0, 0, 5150, "any", 0.45)
# fixed values: layers from the tallest down
LAYERS = [
    Layer("emergent", 26, 0.55, 11, 101, "big"),
    Layer("canopy", 9, 0.90, 5, 138, "normal"),
    Layer("under", 5, 0.85, 0, 175, "small"),
]


def place(axis: str, salt: int, step: int, jitter: float = JITTER, d: Dialect = SPARK) -> str:
    """A candidate's coordinate, from its place gx, gz; truncated towards zero."""
    draw = bhash("gx", "gz", salt * 8 + (1 if axis == "x" else 2), d)
    return d.truncate(f"(g{axis} + {d.num(0.5)} + ({draw} - {d.num(0.5)}) * 2 * {d.num(jitter)}) * {step}")


def chance(salt: int, d: Dialect = SPARK) -> str:
    return bhash("gx", "gz", salt * 8 + 3, d)


def candidates(spark: SparkSession, layer: Layer, x0: int, x1: int, z0: int, z1: int) -> DataFrame:
    """(layer, gx, gz, x, z) of the candidates that hash to life, with a margin of two places around the box."""
    lows = [v // layer.step - 2 for v in (x0, z0)]
    spans = [v // layer.step + 3 - low for v, low in zip((x1, z1), lows, strict=True)]
    places = spark.range(spans[0] * spans[1]).select((F.col("id") % spans[0] + lows[0]).alias("gx"), F.expr(f"id div {spans[0]} + {lows[1]}").alias("gz"))
    alive = places.where(column(f"{chance(layer.salt)} <= {SPARK.num(layer.chance)}"))
    return alive.select(F.lit(layer.name).alias("layer"), "gx", "gz", *[column(place(c, layer.salt, layer.step, layer.jitter)).alias(c) for c in "xz"])


def without_near(points: DataFrame, others: DataFrame, radius: int) -> DataFrame:
    """points that have no other within the radius: an anti join on square bins of the radius' size.

    Others are sent to the nine bins around them, so the join is on equal bins, never all with all.
    """
    if radius <= 0:
        return points
    bins = [F.floor(F.col(c) / radius) for c in ("x", "z")]
    around = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    near = others.select(F.col("x").alias("ox"), F.col("z").alias("oz"), *[b.alias(f"_b{k}") for k, b in enumerate(bins)]).withColumn("_i", around).withColumn("_j", around)
    near = near.select("ox", "oz", (F.col("_b0") + F.col("_i")).alias("_x"), (F.col("_b1") + F.col("_j")).alias("_z"))
    own = points.withColumns({"_x": bins[0], "_z": bins[1]})
    dx, dz = F.col("ox") - F.col("x"), F.col("oz") - F.col("z")
    met = (own["_x"] == near["_x"]) & (own["_z"] == near["_z"]) & (dx * dx + dz * dz < radius * radius)
    return own.join(near, met, "left_anti").drop("_x", "_z")


def slots(spark: SparkSession, x0: int, x1: int, z0: int, z1: int) -> DataFrame:
    """(layer, x, z, size) in the box; lower layers stay clear of all higher candidates, whatever becomes of those."""
    above, out = [], None
    for layer in LAYERS:
        every = candidates(spark, layer, x0 - 32, x1 + 32, z0 - 32, z1 + 32)
        mine = every
        for other, points in above:
            mine = without_near(mine, points, other.radius)
        mine = mine.where(F.col("x").between(x0, x1 - 1) & F.col("z").between(z0, z1 - 1)).select("layer", "x", "z", F.lit(layer.size).alias("size"))
        out = mine if out is None else out.unionByName(mine)
        above.append((layer, every))
    return out


def species(elev: str, size: str, roll: str) -> tuple[str, str]:
    """(kind, size) by elevation, as SQL text; roll is uniform."""
    kind = f"case when {elev} > 900 then 'spruce' when {size} = 'small' and {roll} < 0.30 then 'azalea' when {roll} * 7 - floor({roll} * 7) < 0.25 then 'birch' else 'oak' end"
    grown = f"case when {elev} > 1600 then 'small' when {elev} > 1450 and {size} = 'big' then 'normal' else {size} end"
    return kind, grown


def accepted(points: DataFrame, p: str, roll: str) -> DataFrame:
    """Points that a wood of probability p grows; the tallest layer only in dense woods."""
    return points.where(f"{p} > 0.02 and {roll} <= {p} and not (layer = 'emergent' and {p} < 0.60)")


def boulder_chance(bed: str, relief: str, d: Dialect = SPARK) -> str:
    """Rocky beds and steps carry more boulders."""
    return f"({d.num(0.05)} + (case when {bed} in ('stone', 'cobble', 'gravel') then {d.num(0.10)} else 0 end) + {d.num(0.08)} * least(1, {relief} / {d.num(2.0)}))"


def decor_kind(roll: str, zone: str) -> str:
    """What decorates a place, as SQL text, or null."""
    return f"case when {roll} < 0.10 and {zone} = 'forest' then 'log' when {roll} < 0.18 and {zone} = 'forest' then 'stump' when {roll} < 0.26 then 'boulder' when {roll} < 0.40 and {zone} <> 'alpine' then 'bush' end"


def sampled(points: DataFrame, cells: DataFrame, width: int, depth: int, clamp: bool = False) -> DataFrame:
    """points with the layers of their cell; points beyond the grid's edge go, or with clamp take the nearest cell's."""
    if not clamp:
        return points.join(cells, ["x", "z"])
    at = points.withColumns({"_x": F.least(F.greatest("x", F.lit(0)), F.lit(width - 1)), "_z": F.least(F.greatest("z", F.lit(0)), F.lit(depth - 1))})
    return at.join(cells.withColumnsRenamed({"x": "_x", "z": "_z"}), ["_x", "_z"]).drop("_x", "_z")


def mounds(points: DataFrame) -> DataFrame:
    """(px, pz, x, z, dy) of boulders' columns: a disc of radius 1 or 2, two high in the middle of the greater."""
    span = lambda r: F.explode(F.sequence(-r, r))
    r = F.col("radius")
    disc_ = points.select(F.col("x").alias("px"), F.col("z").alias("pz"), "radius").withColumn("dx", span(r)).withColumn("dz", span(r))
    disc_ = disc_.where("dx * dx + dz * dz <= radius * radius + radius - 1")
    high = F.when((r == 2) & (F.abs("dx") + F.abs("dz") <= 1), 1).otherwise(0)
    return disc_.withColumn("dy", F.explode(F.sequence(F.lit(0), high))).select("px", "pz", (F.col("px") + F.col("dx")).alias("x"), (F.col("pz") + F.col("dz")).alias("z"), "dy")


def expand(points: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each block of each point's template: x + dx, dy, z + dz, name."""
    met = points.join(templates, keys).withColumn("b", F.explode("blocks"))
    return met.select(*[c for c in points.columns if c not in ("x", "z")], F.col("x").alias("px"), F.col("z").alias("pz"), (F.col("x") + F.col("b.dx")).alias("x"), F.col("b.dy").alias("dy"), (F.col("z") + F.col("b.dz")).alias("z"), F.col("b.name").alias("name"))


def base_heights(blocks: DataFrame, surface: DataFrame) -> DataFrame:
    """(px, pz, base) a point: one above the lowest surface under its trunk, or under its middle if none is known."""
    trunk = blocks.where((F.col("dy") <= 2) & ~F.col("name").contains("leaves")).join(surface.select("x", "z", "y"), ["x", "z"], "left")
    low = trunk.groupBy("px", "pz").agg(F.min("y").alias("low"))
    points = blocks.select("px", "pz").distinct().join(low, ["px", "pz"], "left")
    middle = surface.select(F.col("x").alias("px"), F.col("z").alias("pz"), F.col("y").alias("mid"))
    return points.join(middle, ["px", "pz"], "left").select("px", "pz", (F.coalesce("low", "mid") + 1).alias("base"))


def rotated(dx: Column, dz: Column, turns: Column) -> tuple[Column, Column]:
    """Quarter turns around the trunk: (x, z) to (-z, x)."""
    t = F.pmod(turns, F.lit(4))
    return F.when(t == 0, dx).when(t == 1, -dz).when(t == 2, -dx).otherwise(dz), F.when(t == 0, dz).when(t == 1, dx).when(t == 2, -dz).otherwise(-dx)


def disc(spark: SparkSession, radius: int) -> DataFrame:
    """Offsets of a filled disc: dx^2 + dz^2 <= r^2 + r."""
    span = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    return spark.range(1).select(span.alias("dx")).withColumn("dz", span).where(F.expr(f"dx * dx + dz * dz <= {radius * radius + radius}"))


def crown(spark: SparkSession, height: int) -> DataFrame:
    """The broad-leaved shape of a trunk height: (dx, dy, dz, kind)."""
    return shapes(spark.range(1).select(F.lit("oak").alias("tree"), F.lit(height).alias("height"))).select("dx", "dy", "dz", "kind")


# fixed values: a spruce's radii from its top layer down, the last for all below; the heights of each shape
SPRUCE_RADII = [0, 1, 1, 2, 2, 1, 1, 2, 2, 1, 1]
HEIGHTS = {"spruce": (6, 10), "oak": (4, 6), "birch": (5, 7), "krummholz": (2, 3)}


def shapes(trees: DataFrame) -> DataFrame:
    """trees(tree, height, ...) with dx, dy, dz, kind ('log' or 'leaf'), a row a block.

    Spruces are cones of layers whose radii swing, oaks and birches have a crown of four layers, krummholz one flat layer
    with a smaller one on it. Leaves fill discs of dx^2 + dz^2 <= r^2 + r.
    """
    h = F.col("height")
    span = lambda low, high: F.explode(F.sequence(low, high))
    trunk = trees.withColumn("dy", span(F.lit(0), h - 1)).withColumns({"dx": F.lit(0), "dz": F.lit(0), "kind": F.lit("log")})
    is_ = lambda *names: F.col("tree").isin(*names)
    low = F.when(is_("spruce"), F.lit(2)).when(is_("krummholz"), h - 1).otherwise(h - 2)
    high = F.when(is_("krummholz"), h).otherwise(h + 1)
    cone = F.when(F.col("dy") >= h, F.lit(0)).otherwise(F.element_at(F.array(*map(F.lit, SPRUCE_RADII)), F.least(h - F.col("dy"), F.lit(len(SPRUCE_RADII)))))
    layers = trees.withColumn("dy", span(low, high)).withColumn("r", F.when(is_("spruce"), cone).when(is_("krummholz"), F.lit(2)).otherwise(F.when(F.col("dy") < h, 2).otherwise(1)))
    plane = layers.withColumn("dx", span(-F.col("r"), F.col("r"))).withColumn("dz", span(-F.col("r"), F.col("r")))
    away = F.expr("dx * dx + dz * dz")
    middle = (F.col("dx") == 0) & (F.col("dz") == 0)
    fits = F.when(is_("krummholz"), F.when(F.col("dy") < h, away <= 5).otherwise((F.abs("dx") <= 1) & (F.abs("dz") <= 1))).otherwise(away <= F.col("r") * F.col("r") + F.col("r"))
    # trunks stay free of leaves, but for a spruce's top log and krummholz
    trunk_here = middle & F.when(is_("spruce"), F.col("dy") < h - 1).when(is_("krummholz"), F.lit(False)).otherwise(F.col("dy") < h)
    leaves = plane.where(fits & ~trunk_here).drop("r").withColumn("kind", F.lit("leaf"))
    return trunk.unionByName(leaves)


def decor_blocks(points: DataFrame) -> DataFrame:
    """points(x, z, kind, ...) of logs, stumps and bushes with dx, dy, dz, block and axis; draws are hashes of the place.

    A fallen log is three to six long, a stump one or two high; a bush is a square of leaves that lacks about half of its
    corners, with one more on top and, in two of five, a trunk inside.
    """
    draw = lambda salt, x="x", z="z": column(bhash(x, z, salt))
    span = lambda low, high: F.explode(F.sequence(F.lit(low), high))
    none = F.lit(0)
    logs = points.where("kind = 'log'").withColumns({"_k": span(0, F.least(F.lit(5), F.lit(2) + F.floor(draw(71) * 4).cast("int"))), "axis": F.when(draw(72) < 0.5, "x").otherwise("z")})
    logs = logs.withColumns({"dx": F.when(F.col("axis") == "x", F.col("_k")).otherwise(none), "dy": none, "dz": F.when(F.col("axis") == "z", F.col("_k")).otherwise(none), "block": F.lit("log")})
    stumps = points.where("kind = 'stump'").withColumns({"dy": span(0, F.least(F.lit(1), F.floor(draw(73) * 2).cast("int"))), "axis": F.lit("y")})
    stumps = stumps.withColumns({"dx": none, "dz": none, "block": F.lit("log")})
    bush = points.where("kind = 'bush'")
    leaves = bush.withColumn("dx", span(-1, F.lit(1))).withColumn("dz", span(-1, F.lit(1)))
    leaves = leaves.where((F.abs("dx") + F.abs("dz") < 2) | (column(bhash("x * 4 + dx", "z * 4 + dz", 74)) >= 0.5)).withColumn("dy", none)
    top = bush.withColumns({"dx": none, "dz": none, "dy": F.lit(1)})
    leafy = leaves.unionByName(top).withColumns({"axis": F.lit(None).cast("string"), "block": F.lit("leaves")})
    trunk = bush.where(draw(75) < 0.4).withColumns({"dx": none, "dy": none, "dz": none, "axis": F.lit("y"), "block": F.lit("log")})
    keep = [*points.columns, "dx", "dy", "dz", "block", "axis"]
    out = logs.select(keep)
    for part in (stumps, leafy, trunk):
        out = out.unionByName(part.select(keep))
    return out


def boulder(spark: SparkSession, radius: int) -> DataFrame:
    """A half ball: (dx, dy, dz)."""
    span = lambda low: F.explode(F.sequence(F.lit(low), F.lit(radius)))
    cube = spark.range(1).select(span(-radius).alias("dx")).withColumn("dy", span(0)).withColumn("dz", span(-radius))
    return cube.where(F.expr(f"dx * dx + dy * dy + dz * dz <= {radius * radius + radius}"))


def best_variants(wanted: DataFrame, variants: DataFrame) -> DataFrame:
    """wanted(kind, size, snowy, roll, ...) with the variant of the closest match, one of equals by roll.

    Closest is size and snow, then snow, then size, then any of the kind. Variants are a catalogue; grouping it by kind
    makes one small row a kind, which is joined and searched in place.
    """
    pools = variants.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("variant", F.col("size").alias("s"), F.col("snowy").alias("w")))).alias("pool"))
    level = lambda v: F.when((v["s"] == F.col("size")) & (v["w"] == F.col("snowy")), 0).when(v["w"] == F.col("snowy"), 1).when(v["s"] == F.col("size"), 2).otherwise(3)
    met = wanted.join(pools, "kind").withColumn("best", F.array_min(F.transform("pool", level)))
    fits = met.withColumn("fits", F.filter("pool", lambda v: level(v) == F.col("best")))
    at = F.least(F.floor(F.col("roll") * F.size("fits")).cast("int"), F.size("fits") - 1) + 1
    return fits.withColumn("variant", F.element_at("fits", at)["variant"]).drop("pool", "best", "fits")
