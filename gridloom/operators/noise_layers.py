"""Smooth noise as layers of cells, in one Arrow pass over whole columns.

A rule ladder reads a dozen noises, of three octaves and four lattice corners each. As expressions they outgrow a generated
method; here a batch hashes each lattice node that it touches once, and its cells blend those. Values depend on coordinates
alone, so batches and partitions do not show.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dialect import Dialect
from gridloom.functions.hashing import FACTOR_FOLD, FACTOR_SEED, FACTOR_X, FACTOR_Z, MASK_24
from gridloom.functions.noise import OCTAVE_SEED, smooth_noise


@dataclass(frozen=True)
class Smooth:
    """Smooth noise of a scale in cells; about -1 to 1."""

    scale: float
    seed: int
    octaves: int

    def text(self, x: str, z: str, d: Dialect) -> str:
        """The same noise as an expression."""
        return smooth_noise(x, z, self.scale, self.seed, self.octaves, d)


def texts(layers: dict[str, Smooth], x: str, z: str, d: Dialect) -> dict[str, str]:
    return {name: own.text(x, z, d) for name, own in layers.items()}


def hashed(i: np.ndarray, j: np.ndarray, seed: int) -> np.ndarray:
    """0 to 1 for integer coordinates, with 64-bit wraparound."""
    with np.errstate(over="ignore"):
        h = i.astype(np.int64) * FACTOR_X + j.astype(np.int64) * FACTOR_Z + np.uint64(seed * FACTOR_SEED % 2**64).astype(np.int64)
        h = (h ^ (h >> 13)) * FACTOR_FOLD
    return ((h ^ (h >> 16)) & MASK_24) / float(MASK_24)


def _corners(i: np.ndarray, j: np.ndarray, seed: int) -> list[np.ndarray]:
    """The hashes of (i, j), (i + 1, j), (i, j + 1) and (i + 1, j + 1)."""
    if not len(i):
        return [np.zeros(0)] * 4
    low_i, low_j = i.min(), j.min()
    wide, high = int(i.max() - low_i) + 2, int(j.max() - low_j) + 2
    if wide * high <= 4 * len(i):
        a, b = np.meshgrid(np.arange(wide) + low_i, np.arange(high) + low_j, indexing="ij")
        nodes, u, v = hashed(a, b, seed), i - low_i, j - low_j
        return [nodes[u, v], nodes[u + 1, v], nodes[u, v + 1], nodes[u + 1, v + 1]]
    return [hashed(i + di, j + dj, seed) for dj in (0, 1) for di in (0, 1)]


def valued(x: np.ndarray, z: np.ndarray, scale: float, seed: int) -> np.ndarray:
    """Lattice noise, 0 to 1."""
    i, j = np.floor(x / scale), np.floor(z / scale)
    fx, fz = x / scale - i, z / scale - j
    u, v = fx * fx * (3.0 - 2.0 * fx), fz * fz * (3.0 - 2.0 * fz)
    a, b, c, e = _corners(i.astype(np.int64), j.astype(np.int64), seed)
    return a * (1 - u) * (1 - v) + b * u * (1 - v) + c * (1 - u) * v + e * u * v


def smoothed(x: np.ndarray, z: np.ndarray, own: Smooth) -> np.ndarray:
    total = np.zeros(len(x))
    for o in range(own.octaves):
        total = total + (valued(x, z, max(2.0, own.scale / 2**o), own.seed + OCTAVE_SEED * o) * 2 - 1) * 0.5**o
    return total / sum(0.5**o for o in range(own.octaves))


def with_noise(cells: DataFrame, layers: dict[str, Smooth], x: str = "x", z: str = "z") -> DataFrame:
    """cells with the layers, which replace columns of their names; null where a coordinate is null."""

    @F.pandas_udf(", ".join(f"{name} double" for name in layers))
    def made(xs: pd.Series, zs: pd.Series) -> pd.DataFrame:
        known = (xs.notna() & zs.notna()).to_numpy()
        a, b = (c.to_numpy(dtype=np.float64, na_value=0.0) for c in (xs, zs))
        return pd.DataFrame({name: np.where(known, smoothed(a, b, own), np.nan) for name, own in layers.items()})

    held = "_noise"
    while held in cells.columns:
        held += "_"
    return cells.withColumn(held, made(F.col(x), F.col(z))).withColumns({name: F.col(f"{held}.{name}") for name in layers}).drop(held)
