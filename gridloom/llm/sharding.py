"""Shards by a hierarchical weighted hash tree: region, rack, shard.

Every row draws, per region, arrivals of a Poisson process whose rate is the region's capacity. An arrival descends by
weighted hash draws, rack by the racks' capacities and shard by the shards' capacities, to a place in the region; it
counts if that place is filled, that is if the place inside the shard lies below the shard's weight. The region whose
first counting arrival comes first takes the row. Changing one shard's weight only adds or removes arrivals in that
shard, so rows move only into or out of it and no other subtree is disturbed; shares are in proportion to weights.

Law `key`: the row's id and the topology decide. Null ids share one key. Repeated rows go to the same shard, each with
a slot of its own. Empty and null texts have no bytes, and texts of any length are only measured. Extra columns stay, and
an input column named like an output column is replaced. An empty table gives an empty result. A tree whose weights are
all 0, or lie outside 0 to their capacity, is refused. A row takes as many draws as capacity is larger than weight, so a
capacity should not exceed its weight by orders of magnitude.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import stored, unused

RACKS, PLACES = 2, 4


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree. Its weight may lie between 0 and its capacity."""

    number: int
    region: int
    rack: int
    weight: float = 1.0
    capacity: float = 1.0


def topology(shards: int) -> tuple[Shard, ...]:
    """Regions of two racks of four places, filled one after another; places that are not yet filled weigh nothing."""
    full = -(-shards // (RACKS * PLACES)) * RACKS * PLACES
    return tuple(Shard(k, k // (RACKS * PLACES), k // PLACES % RACKS, 1.0 if k < shards else 0.0) for k in range(full))


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _draw(key: np.ndarray, *salts: int) -> np.ndarray:
    """Uniform in (0, 1) for each key, independent for each list of salts."""
    h = key
    for s in salts:
        with np.errstate(over="ignore"):
            h = _mix(h + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return ((h >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def assign(keys: np.ndarray, tree: tuple[Shard, ...]) -> np.ndarray:
    """The shard of each 64-bit key."""
    if not any(s.weight > 0 for s in tree) or not all(0 <= s.weight <= s.capacity < float("inf") for s in tree):
        raise ValueError("weights lie between 0 and their capacity, and one at least above 0")
    keys = _mix(np.asarray(keys, dtype=np.int64).view(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    best, out = np.full(len(keys), np.inf), np.full(len(keys), -1, dtype=np.int32)
    # regions that are full settle on their first arrival; those with free places go last, so most rows stop early
    order = sorted({s.region for s in tree}, key=lambda r: (sum(s.capacity - s.weight for s in tree if s.region == r), r))
    for region in order:
        leaves = [s for s in tree if s.region == region]
        if not any(s.weight > 0 for s in leaves):
            continue
        racks = sorted({s.rack for s in leaves})
        rack_caps = np.array([sum(s.capacity for s in leaves if s.rack == r) for r in racks])
        rate = rack_caps.sum()
        live, time, attempt = np.arange(len(keys)), np.zeros(len(keys)), 0
        while len(live):
            key = keys[live]
            time = time - np.log(_draw(key, region, attempt, 0)) / rate
            alive = time < best[live]
            live, time, key = live[alive], time[alive], key[alive]
            if not len(live):
                break
            rack = np.searchsorted(np.cumsum(rack_caps) / rate, _draw(key, region, attempt, 1), side="right").clip(0, len(racks) - 1)
            took = np.zeros(len(live), dtype=bool)
            for k, r in enumerate(racks):
                inside = np.flatnonzero(rack == k)
                own = sorted((s for s in leaves if s.rack == r), key=lambda s: s.number)
                caps = np.array([s.capacity for s in own])
                place = _draw(key[inside], region, attempt, 2, r) * caps.sum()
                leaf = np.searchsorted(np.cumsum(caps), place, side="right").clip(0, len(own) - 1)
                filled = place - (np.cumsum(caps) - caps)[leaf] < np.array([s.weight for s in own])[leaf]
                hit = inside[filled]
                best[live[hit]], out[live[hit]] = time[hit], np.array([s.number for s in own])[leaf[filled]]
                took[hit] = True
            live, time, attempt = live[~took], time[~took], attempt + 1
    return out


def shard_of(tree: tuple[Shard, ...]):
    """A column function: the shard of a long key; null counts as one key, -2^62.

    Nulls are replaced before the batch is made: pandas would turn a batch with a null into doubles, which have no room for
    all of a long's digits.
    """

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(assign(keys.to_numpy(dtype=np.int64), tree))

    return lambda key: of(F.coalesce(key.cast("long"), F.lit(-(2**62))))


def shard(rows: DataFrame, tree: tuple[Shard, ...], grown: tuple[Shard, ...] | None = None, *, key: str = "doc_id") -> DataFrame:
    """rows with shard, slot (gapless from 0 in each shard) and, if a grown tree is given, grown_shard.

    Slots are numbered without gathering a shard anywhere: rows are stored once with the block that wrote them, blocks
    count their rows per shard, and the running sums of these counts place each block. A block's rows of one shard meet
    in one task, a block being what one task wrote.
    """
    t = unused([*rows.columns, key])
    at, block, place, start = (f"{t}{n}" for n in ("at", "block", "place", "start"))
    made = {"shard": shard_of(tree)(F.col(key)), "grown_shard": shard_of(grown)(F.col(key)) if grown else F.lit(None).cast("int"), at: F.monotonically_increasing_id()}
    placed = stored(rows.withColumns(made)).withColumn(block, F.shiftright(at, 33))
    counts = placed.groupBy(block, "shard").agg(F.count("*").alias(place))
    before = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(block, "shard", F.coalesce(F.sum(place).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(block, "shard").orderBy(at)
    numbered = placed.withColumn(place, F.row_number().over(inside) - 1).join(starts, [block, "shard"])
    return numbered.withColumn("slot", (F.col(start) + F.col(place)).cast("long")).drop(block, at, place, start)
