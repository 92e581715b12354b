"""Polygons and lines on grids: kinds, buffers, and which cells a shape touches.

A feature is (id, geom_type, parts, ...): parts are arrays of points (struct of x and z), the rings of polygons or the lines
of line strings. Rings may or may not repeat their first point; rings inside others are holes, as a point is inside where it
crosses an odd number of edges. Cell (i, k) is the square from (i, k) to (i + 1, k + 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLYGONS, LINES = ("Polygon", "MultiPolygon"), ("LineString", "MultiLineString")
#: Corners of the round joints of buffered lines.
ROUND = 32


def of_kind(features: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return features.where(F.col("geom_type").isin(*kinds))


def _segments(part: Column, closed: bool) -> Column:
    """The steps from point to point; of a ring the last one leads back to the first."""
    points = F.concat(part, F.slice(part, 1, 1)) if closed else part
    steps = F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(points)))
    made = F.transform(steps, lambda k: F.struct(F.get(points, k - 2).alias("a"), F.get(points, k - 1).alias("b")))
    return F.filter(made, lambda s: s["a"].isNotNull() & s["b"].isNotNull() & (s["a"] != s["b"]))


def edges(features: DataFrame, closed: bool) -> DataFrame:
    """features without parts, a row for each step of each part: x0, z0, x1, z1."""
    parts = features.withColumn("_part", F.explode("parts")).drop("parts")
    found = parts.withColumn("_s", F.explode(_segments(F.col("_part"), closed))).drop("_part")
    return found.withColumns({f"{c}{k}": F.col(f"_s.{end}.{c}") for k, end in enumerate("ab") for c in "xz"}).drop("_s")


def buffered(lines: DataFrame, width: Column) -> DataFrame:
    """Lines as polygons of a width: a rectangle for each step, its ends cut flat, and a round joint at each inner point.

    The polygons of a line overlap; burning them is burning their union.
    """
    half = width / 2
    point = lambda x, z: F.struct(x.cast("double").alias("x"), z.cast("double").alias("z"))
    steps = edges(lines.withColumn("_half", half), closed=False)
    dx, dz = F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0")
    length = F.sqrt(dx * dx + dz * dz)
    nx, nz = -dz / length * F.col("_half"), dx / length * F.col("_half")
    corners = [("x0", "z0", 1), ("x1", "z1", 1), ("x1", "z1", -1), ("x0", "z0", -1)]
    boxes = steps.withColumn("parts", F.array(F.array(*[point(F.col(x) + s * nx, F.col(z) + s * nz) for x, z, s in corners])))
    inner = lines.withColumn("_half", half).withColumn("_line", F.explode("parts")).withColumn("_p", F.explode(F.expr("slice(_line, 2, greatest(size(_line) - 2, 0))")))
    turn = lambda k: F.lit(2.0) * F.pi() * k / ROUND
    ring = F.transform(F.sequence(F.lit(0), F.lit(ROUND - 1)), lambda k: point(F.col("_p.x") + F.col("_half") * F.cos(turn(k)), F.col("_p.z") + F.col("_half") * F.sin(turn(k))))
    joints = inner.withColumn("parts", F.array(ring))
    keep = [c for c in lines.columns if c not in ("parts", "geom_type")]
    made = [d.select(*keep, F.lit("Polygon").alias("geom_type"), "parts") for d in (boxes, joints)]
    return made[0].unionByName(made[1])


def touched(polygons: DataFrame, width: int, depth: int, id_: str = "id") -> DataFrame:
    """polygons without parts, a row for each cell of the grid that a polygon touches: x, z.

    A cell is touched where an edge crosses it or its middle is inside. Edges give their cells line by line, and between the
    crossings of a line's middle lie the cells inside; the work grows with a polygon's outline and its cells, not with its
    box or the grid. A polygon's crossings of one line meet in one row. `id_` tells polygons apart; a polygon of no part, or
    one beside the grid, touches nothing.
    """
    rest = [c for c in polygons.columns if c not in ("parts", id_)]
    key = F.struct(F.col(id_), *rest)
    own = polygons.select(F.monotonically_increasing_id().alias("_n"), key.alias("_f"), "parts")
    steps = edges(own, closed=True)
    low_z, high_z = F.least("z0", "z1"), F.greatest("z0", "z1")
    line = lambda low, high: F.explode(F.filter(F.sequence(F.greatest(low, F.lit(0)), F.greatest(F.least(high, F.lit(depth - 1)), F.greatest(low, F.lit(0)))), lambda k: (k >= low) & (k <= high) & (k < depth)))
    at = lambda z: F.when(F.col("z1") == F.col("z0"), F.col("x0")).otherwise(F.col("x0") + (z - F.col("z0")) * (F.col("x1") - F.col("x0")) / (F.col("z1") - F.col("z0")))
    cells = lambda low, high: F.explode(F.filter(F.sequence(F.greatest(low, F.lit(0)), F.greatest(F.least(high, F.lit(width - 1)), F.greatest(low, F.lit(0)))), lambda k: (k >= low) & (k <= high) & (k < width)))
    floor = lambda c: F.floor(c).cast("int")
    on_line = steps.withColumn("z", line(floor(low_z), floor(high_z)))
    enters, leaves = at(F.greatest(low_z, F.col("z").cast("double"))), at(F.least(high_z, F.col("z") + F.lit(1.0)))
    flat = F.col("z0") == F.col("z1")
    first = F.when(flat, F.least("x0", "x1")).otherwise(F.least(enters, leaves))
    last = F.when(flat, F.greatest("x0", "x1")).otherwise(F.greatest(enters, leaves))
    crossed = on_line.withColumns({"_a": floor(first), "_b": floor(last)}).withColumn("x", cells(F.col("_a"), F.col("_b"))).select("_n", "_f", "x", "z")
    middles = steps.where(~flat).withColumn("z", line(F.ceil(low_z - 0.5).cast("int"), (F.ceil(high_z - 0.5) - 1).cast("int")))
    cuts = middles.select("_n", "_f", "z", at(F.col("z") + F.lit(0.5)).alias("_x")).groupBy("_n", "_f", "z").agg(F.array_sort(F.collect_list("_x")).alias("_xs"))
    pairs = F.transform(F.sequence(F.lit(1), F.expr("size(_xs) div 2")), lambda k: F.struct(F.get("_xs", 2 * k - 2).alias("a"), F.get("_xs", 2 * k - 1).alias("b")))
    spans = cuts.where("size(_xs) > 1").withColumn("_p", F.explode(pairs))
    inside = spans.withColumns({"_a": F.ceil(F.col("_p.a") - 0.5).cast("int"), "_b": (F.ceil(F.col("_p.b") - 0.5) - 1).cast("int")})
    inside = inside.withColumn("x", cells(F.col("_a"), F.col("_b"))).select("_n", "_f", "x", "z")
    return crossed.unionByName(inside).distinct().select(F.col(f"_f.{id_}").alias(id_), *[F.col(f"_f.{c}").alias(c) for c in rest], "x", "z")
