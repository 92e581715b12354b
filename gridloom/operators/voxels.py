"""Volumes as runs and voxels, and how overlapping writes resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_runs(cells: DataFrame, y: str, depth: str, bottom: int) -> DataFrame:
    """(x, z, low, high, block): stone up to the bed, water above it; runs, not voxels, so a column is two rows at most."""
    bed = F.col(y) - F.col(depth)
    runs = F.array(
        F.struct(F.lit(bottom).alias("low"), bed.cast("int").alias("high"), F.lit("stone").alias("block")),
        F.struct((bed + 1).cast("int").alias("low"), F.col(y).cast("int").alias("high"), F.lit("water").alias("block")),
    )
    out = cells.select("x", "z", F.explode(runs).alias("r")).select("x", "z", "r.low", "r.high", "r.block")
    return out.where("low <= high")


def voxels(runs: DataFrame) -> DataFrame:
    return runs.select("x", F.explode(F.sequence("low", "high")).alias("y"), "z", "block")


def resolved(writes: DataFrame, priority: str | Column, keep: str = "last") -> DataFrame:
    """(x, y, z, block): of all writes to a voxel the one of the greatest (or smallest) priority; aggregates before it moves."""
    choose = F.max_by if keep == "last" else F.min_by
    return writes.groupBy("x", "y", "z").agg(choose("block", priority).alias("block"))


# fixed values: blocks that count as nothing, and the plants that trees may grow through besides
AIR = ["air", "cave_air", "void_air"]
SOFT = [
    *AIR, "snow", "short_grass", "fern", "large_fern", "tall_grass", "dead_bush", "brown_mushroom", "red_mushroom", "dandelion", "poppy", "oxeye_daisy",
    "cornflower", "azure_bluet", "moss_carpet", "sweet_berry_bush", "allium", "white_tulip", "orange_tulip",
]
#: The volume's lowest and highest blocks (fixed values).
BOTTOM, TOP = -64, 318


def guarded(writes: DataFrame, volume: DataFrame, box: tuple[int, int, int, int], bottom: int = BOTTOM, top: int = TOP) -> DataFrame:
    """The writes(x, y, z, block, guard, ...) that may happen: inside the box (x0, x1, z0, z1; x1 and z1 outside) and the
    heights, and where guard asks for it on a voxel of volume(x, y, z, block) that is air ('air') or soft ('soft').

    Voxels that the volume lacks are air. Writes without guard replace anything.
    """
    x0, x1, z0, z1 = box
    inside = writes.where(F.col("x").between(x0, x1 - 1) & F.col("z").between(z0, z1 - 1) & F.col("y").between(bottom, top))
    met = inside.join(volume.select("x", "y", "z", F.col("block").alias("_held")), ["x", "y", "z"], "left")
    held = F.coalesce("_held", F.lit("air"))
    allowed = F.when(F.col("guard") == "air", held.isin(AIR)).when(F.col("guard") == "soft", held.isin(SOFT)).otherwise(True)
    return met.where(allowed).drop("_held")


def used_tiles(cells: DataFrame, value: str, tile: int) -> DataFrame:
    """cells of those tiles that hold anything: a value that is neither null nor 0 in one cell at least."""
    at = {f"_t{c}": F.floor(F.col(c) / tile).cast("int") for c in ("x", "z")}
    placed = cells.withColumns(at)
    some = placed.where(F.coalesce(F.col(value) != 0, F.lit(False))).select("_tx", "_tz").distinct()
    return placed.join(some, ["_tx", "_tz"], "left_semi").drop("_tx", "_tz")


def chunk_mode(cells: DataFrame, value: str, bits: int = 4) -> DataFrame:
    """(cx, cz, value): each chunk's commonest value, the smallest of equals."""
    return cells.groupBy(F.shiftright("x", bits).alias("cx"), F.shiftright("z", bits).alias("cz")).agg(F.mode(F.col(value), True).alias(value))


def tile_manifest(cells: DataFrame, value: str, tile: int) -> DataFrame:
    """(name, x0, z0, x1, z1, width, height, low, high) of each tile."""
    at = [(F.floor(F.col(c) / tile) * tile).cast("int").alias(f"{c}0") for c in ("x", "z")]
    out = cells.groupBy(*at).agg(F.max("x").alias("x1"), F.max("z").alias("z1"), F.min(value).alias("low"), F.max(value).alias("high"))
    name = F.concat(F.lit("hm_x"), F.col("x0"), F.lit("_z"), F.col("z0"), F.lit(".png"))
    return out.select(name.alias("name"), "x0", "z0", "x1", "z1", (F.col("x1") - F.col("x0") + 1).alias("width"), (F.col("z1") - F.col("z0") + 1).alias("height"), "low", "high")


def write_tiles(cells: DataFrame, path: str, tile: int) -> None:
    """Parquet by tile; writing a tile again replaces it and no other."""
    placed = cells.withColumns({f"t{c}": F.floor(F.col(c) / tile).cast("int") for c in ("x", "z")})
    placed.repartition("tx", "tz").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tx", "tz").parquet(path)


def verify_written(expected: DataFrame, path: str) -> None:
    """Reads a written volume again and raises if voxels of expected(x, y, z, block) are missing or hold another block."""
    written = expected.sparkSession.read.parquet(path)
    wrong = expected.join(written, ["x", "y", "z", "block"], "left_anti").orderBy("x", "y", "z").limit(5).collect()
    if wrong:
        raise ValueError(f"not written as expected: {[tuple(r) for r in wrong]}")
