"""Grids of cells (x, z, layers...): generation, neighbours, distances and halo tiles.

Windows always have a partition: a stencil along x works on each z alone and the other way round. They want dense grids,
as a neighbour is the row before or after; complete() makes one.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, width: int, depth: int) -> DataFrame:
    """All cells of a width x depth grid, made in parallel."""
    return spark.range(width * depth).select((F.col("id") % width).cast("int").alias("x"), F.expr(f"cast(id div {width} as int)").alias("z"))


def complete(cells: DataFrame, sparse: DataFrame, fill: dict[str, object]) -> DataFrame:
    """cells with the layers of sparse, and fill's values where sparse has no such cell."""
    return cells.join(sparse, ["x", "z"], "left").fillna(fill)


def along(axis: str):
    """The window that steps along an axis."""
    return Window.partitionBy("z" if axis == "x" else "x").orderBy(axis)


def before(value: str | Column, axis: str) -> Column:
    return F.lag(value).over(along(axis))


def after(value: str | Column, axis: str) -> Column:
    return F.lead(value).over(along(axis))


def gradient(value: str, axis: str, spacing: float) -> Column:
    """Central difference inside, one-sided at the edges; null on a grid one cell wide."""
    low, high = before(value, axis), after(value, axis)
    steps = F.when(low.isNull() | high.isNull(), 1).otherwise(2)
    return (F.coalesce(high, F.col(value)) - F.coalesce(low, F.col(value))) / (steps * F.lit(float(spacing)))


def laplacian(value: str, spacing: float) -> Column:
    """Sum of the four neighbours less four times the cell; neighbours wrap around the edges."""
    total = -4 * F.col(value)
    for axis in ("x", "z"):
        whole = along(axis).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        total = total + F.coalesce(before(value, axis), F.last(value).over(whole)) + F.coalesce(after(value, axis), F.first(value).over(whole))
    return total / F.lit(float(spacing) ** 2)


def relief4(value: str) -> Column:
    """The largest step to one of the four neighbours."""
    steps = [F.abs(F.col(value) - near(value, axis)) for axis in ("x", "z") for near in (before, after)]
    return F.coalesce(F.greatest(*steps), F.lit(0))


def count8(cells: DataFrame, flag: str, into: str) -> DataFrame:
    """How many of the eight neighbours hold the flag: two sums of three, less the cell itself."""
    rows = along("z").rowsBetween(-1, 1)
    columns = along("x").rowsBetween(-1, 1)
    three = cells.withColumn("_three", F.sum(F.col(flag).cast("int")).over(rows))
    return three.withColumn(into, (F.sum("_three").over(columns) - F.col(flag).cast("int")).cast("int")).drop("_three")


def l1_min(cells: DataFrame, value: Column, into: str) -> DataFrame:
    """min over all cells q of value(q) + |x - xq| + |z - zq|; cells whose value is null are no source.

    The distance is separable: running minima of value - x and value + x along x, then the same along z. It replaces any
    number of relaxation or dilation steps by four windows over two sorts.
    """
    out = cells.withColumn("_v", value.cast("long"))
    for axis in ("x", "z"):
        to_here = along(axis).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        from_here = along(axis).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        at = F.col(axis).cast("long")
        out = out.withColumn("_v", F.least(F.min(F.col("_v") - at).over(to_here) + at, F.min(F.col("_v") + at).over(from_here) - at))
    return out.withColumnRenamed("_v", into)


def l1_distance(cells: DataFrame, source: Column, into: str) -> DataFrame:
    """Steps to the nearest cell where source holds; null if there is none."""
    return l1_min(cells, F.when(source, 0), into)


def dilate(cells: DataFrame, flag: Column, steps: int, into: str) -> DataFrame:
    """Cells within so many cardinal steps of a flagged one."""
    out = l1_distance(cells, flag, "_d")
    return out.withColumn(into, F.coalesce(F.col("_d") <= steps, F.lit(False))).drop("_d")


def l1_ball_max(cells: DataFrame, value: str, radius: int, into: str) -> DataFrame:
    """The largest value within radius steps, 0 at least.

    Each positive cell is sent to the cells around it; what arrives is a maximum, so that map-side combining holds the
    exchange to one row a cell and task.
    """
    span = lambda r: F.explode(F.sequence(-r, r))
    sent = cells.where(F.col(value) > 0).select("x", "z", value).withColumn("_dx", span(F.lit(radius)))
    sent = sent.withColumn("_dz", span(F.lit(radius) - F.abs("_dx")))
    reached = sent.groupBy((F.col("x") + F.col("_dx")).alias("x"), (F.col("z") + F.col("_dz")).alias("z")).agg(F.max(value).alias(into))
    return cells.join(reached, ["x", "z"], "left").fillna({into: 0})


def kept(cells: DataFrame, condition: Column) -> DataFrame:
    """cells where the condition holds, tested on the layers as they are.

    A plain filter would be pushed below the ladders that make the layers, and hold a copy of a ladder for each mention of
    its layer; a column that depends on the row's place, not on its values, keeps the filter above them.
    """
    place = "_place"
    while place in cells.columns:
        place += "_"
    return cells.withColumn(place, F.monotonically_increasing_id()).where((F.col(place) >= 0) & condition).drop(place)


def halo_tiles(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """Every cell once for each tile that it lies in or within halo of: columns tx, tz are added."""
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / F.lit(tile)), F.floor((F.col(c) + halo) / F.lit(tile))))
    return cells.withColumn("tx", reach("x")).withColumn("tz", reach("z"))


def over_tiles(cells: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, tile: int = 256, halo: int = 16) -> DataFrame:
    """kernel on each halo-padded tile, cropped to the tile's own cells.

    For operators of several dependent steps; a tile's memory is (tile + 2 halo)^2 cells whatever the grid's size.
    """

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        out = kernel(part)
        tx, tz = key
        own = (out["x"] // tile == tx) & (out["z"] // tile == tz)
        return out[own].drop(columns=["tx", "tz"], errors="ignore")

    return halo_tiles(cells, tile, halo).groupBy("tx", "tz").applyInPandas(run, schema)
