"""Water: distance to the shore, depth, lake edges and lake levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dialect import column
from gridloom.operators import rules as R
from gridloom.operators.grid import count8, l1_distance, over_tiles
from gridloom.operators.noise_layers import with_noise

#: Depth saturates before a chamfer distance of 107 cells, so a halo of as many gives exact depths.
HALO = 107


def _dense(part: pd.DataFrame, *names: str) -> tuple[np.ndarray, ...]:
    """A mask of the cells that exist and the layers as arrays, with a border of one absent cell."""
    i, k = (part[c].to_numpy() - part[c].min() + 1 for c in ("x", "z"))
    shape = (i.max() + 2, k.max() + 2)
    there = np.zeros(shape, dtype=bool)
    there[i, k] = True
    out = []
    for name in names:
        layer = np.zeros(shape, dtype=part[name].to_numpy().dtype)
        layer[i, k] = part[name].to_numpy()
        out.append(layer)
    return (i, k, there, *out)


def _around(a: np.ndarray, diagonal: bool = False):
    """The neighbours' values, as shifted copies."""
    for dx, dz in ((1, 0), (-1, 0), (0, 1), (0, -1)) + (((1, 1), (1, -1), (-1, 1), (-1, -1)) if diagonal else ()):
        yield (4 if dx and dz else 3), np.roll(a, (dx, dz), (0, 1))


def chamfer(cells: DataFrame, *, tile: int = 1024, halo: int = HALO) -> DataFrame:
    """cells(x, z, water) with `distance` to the nearest land: 1 a cardinal step, 4/3 a diagonal one; 0 on land.

    Distances above the halo are not exact, and infinite where no land is within it. Tiles are large beside the halo, as
    every cell moves once for each tile whose halo it lies in.
    """

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        i, k, there, water = _dense(part, "water")
        far = np.where(there & ~water, 0.0, np.inf)
        while True:
            new = far
            for cost, near in _around(far, diagonal=True):
                new = np.minimum(new, near + cost)
            # absent cells pass nothing on
            new[~there] = np.inf
            if np.array_equal(new, far):
                break
            far = new
        return part.assign(distance=far[i, k] / 3.0)

    return over_tiles(cells.select("x", "z", "water"), kernel, "x int, z int, water boolean, distance double", tile=tile, halo=halo)


def base_depth(cells: DataFrame, **tiles: int) -> DataFrame:
    return chamfer(cells, **tiles).withColumn("depth", column(R.depth_curve("distance", "water")))


def water_depth(cells: DataFrame, **tiles: int) -> DataFrame:
    """Depth by the distance to the shore, with basins, ridges and cliffs."""
    noise = R.relief_noise()
    rows = with_noise(base_depth(cells, **tiles), noise)
    return rows.withColumn("depth", column(R.underwater_relief("depth", "water", {k: k for k in noise}))).drop(*noise)


#: How far around a lake's core its edges are shaped, and from which depth a cell is core.
SEARCH, CORE = 12, 3


def naturalise(cells: DataFrame, **tiles: int) -> DataFrame:
    """cells with `natural`: the water mask with broad lakes' edges moved by one cell at most; streams stay."""
    rows = base_depth(cells, **tiles).withColumn("core", F.col("water") & (F.col("depth") >= CORE))
    rows = l1_distance(count8(rows, "water", "neighbours"), F.col("core"), "steps")
    noise = R.edge_noise()
    rows = with_noise(rows, noise).withColumn("score", column(R.naturalise_score({k: k for k in noise}))).drop(*noise)
    erodes = F.col("water") & (F.col("steps") <= SEARCH) & (F.col("neighbours") >= 5) & (F.col("score") < -0.26)
    floods = ~F.col("water") & (F.col("steps") <= SEARCH + 1) & (F.col("neighbours") >= 3) & (F.col("score") > 0.34)
    return rows.withColumn("natural", F.when(F.col("core"), True).when(erodes, False).when(floods, True).otherwise(F.col("water")))


def lake_levels(cells: DataFrame, *, offset: int = 1, core_depth: int = CORE, search: int = SEARCH, flat: int = 4, relax: int = 4, tile: int = 256) -> DataFrame:
    """cells(x, z, base_y, water, depth) with y and lake: one coherent level from a lake's core across its shelf.

    Core cells set the level. It spreads through water step by step, at first flat where the terrain is within a block,
    then by ramps of one block a cell; shelves where two fronts meet are then moved within one block of their neighbours.
    Cells that nothing reaches keep their own height. The halo is as wide as all steps together.
    """

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        i, k, there, base, water, depth = _dense(part, "base_y", "water", "depth")
        base = base.astype(np.float64)
        wet, core = there & water, there & water & (depth >= core_depth)
        level = np.where(core, base + offset, np.nan)
        with np.errstate(invalid="ignore"):
            for step in range(search):
                near = np.fmax.reduce([a for _, a in _around(level)])
                reach = wet & np.isnan(level) & ~np.isnan(near)
                if not reach.any():
                    break
                ramp = np.clip(base, near - 1, near + 1)
                ramp = np.where(np.abs(base - near) <= 1, near, ramp) if step < flat else ramp
                level = np.where(reach, ramp, level)
            for _ in range(relax):
                around = [a for _, a in _around(level)]
                low, high = np.fmax.reduce(around) - 1, np.fmin.reduce(around) + 1
                moves = ~np.isnan(level) & ~core & (low <= high) & ((level < low) | (level > high))
                if not moves.any():
                    break
                level = np.where(moves, np.clip(level, low, high), level)
        lake = ~np.isnan(level)
        return part.assign(y=np.where(lake, level, base)[i, k].astype(np.int32), lake=lake[i, k])

    rows = cells.select("x", "z", F.col("base_y").cast("int").alias("base_y"), "water", F.col("depth").cast("int").alias("depth"))
    return over_tiles(rows, kernel, "x int, z int, base_y int, water boolean, depth int, y int, lake boolean", tile=tile, halo=search + relax)
