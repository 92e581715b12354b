"""Resumable work: ledgers of done tiles, pending tiles, and batches that run once per new tile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(tiles: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """tiles(x0, z0, ...) which the ledger done(tile_key) does not name, in order of x0 and z0."""
    keyed = tiles.withColumn("tile_key", F.concat_ws(",", "x0", "z0"))
    left = keyed.join(done.select("tile_key").distinct(), "tile_key", "left_anti").orderBy("x0", "z0")
    return left.limit(most) if most else left


def record(tiles: DataFrame, path: str) -> None:
    """Appends tiles' keys to the ledger; Spark's commit makes it whole or not at all."""
    tiles.select("tile_key").distinct().write.mode("append").parquet(path)


def persist_sorted(done: DataFrame, path: str) -> None:
    """Writes the ledger's keys as text, each once and in order; the files' order is the keys'."""
    done.select("tile_key").distinct().orderBy("tile_key").write.mode("overwrite").text(path)


def check_signature(spark: SparkSession, path: str, signature: str) -> None:
    """Refuses a ledger that was begun with another signature; begins one that isn't there."""
    from pyspark.errors import AnalysisException

    try:
        found = {r.signature for r in spark.read.schema("signature string").json(f"{path}/_meta_json").collect()}
    except AnalysisException:
        found = set()
    if found and found != {signature}:
        raise ValueError(f"the ledger belongs to {sorted(found)}, not to {signature}")
    if not found:
        spark.createDataFrame([(signature,)], "signature string").coalesce(1).write.json(f"{path}/_meta_json")


def run_pending(tiles: DataFrame, ledger: str, work: Callable[[DataFrame], None], *, batch: int = 64) -> int:
    """Works on pending tiles, batch by batch, and records each batch after its work; the number of batches.

    Work that is interrupted before it is recorded is done again, so it must be repeatable.
    """
    spark, n = tiles.sparkSession, 0
    while True:
        try:
            done = spark.read.schema("tile_key string").parquet(ledger)
            done.limit(1).count()
        except Exception as e:  # a ledger that isn't there yet names no tile
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = spark.createDataFrame([], "tile_key string")
        part = pending(tiles, done, batch)
        if part.isEmpty():
            return n
        work(part)
        record(part, ledger)
        n += 1
