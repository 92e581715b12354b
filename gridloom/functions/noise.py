"""Lattice noise anchored to world coordinates: any partition of the cells gives the same values."""

from __future__ import annotations

from gridloom.functions.dialect import SPARK, Dialect
from gridloom.functions.hashing import hash01

#: How far apart the seeds of two octaves are (fixed value).
OCTAVE_SEED = 7919


def white_noise(x: str, z: str, seed: int, d: Dialect = SPARK) -> str:
    return hash01(x, z, seed, d)


def value_noise(x: str, z: str, scale: float, seed: int, d: Dialect = SPARK) -> str:
    """Hashes of the four lattice corners, blended by smoothstep; 0 to 1."""
    s = d.num(float(scale))
    i, j = (f"cast(floor({c} / {s}) as bigint)" for c in (x, z))
    fx, fz = f"({x} / {s} - floor({x} / {s}))", f"({z} / {s} - floor({z} / {s}))"
    u, v = (f"({f} * {f} * ({d.num(3.0)} - {d.num(2.0)} * {f}))" for f in (fx, fz))
    a, b = hash01(i, j, seed, d), hash01(f"({i} + 1)", j, seed, d)
    c, e = hash01(i, f"({j} + 1)", seed, d), hash01(f"({i} + 1)", f"({j} + 1)", seed, d)
    return f"({a} * (1 - {u}) * (1 - {v}) + {b} * {u} * (1 - {v}) + {c} * (1 - {u}) * {v} + {e} * {u} * {v})"


def smooth_noise(x: str, z: str, scale: float, seed: int, octaves: int = 3, d: Dialect = SPARK) -> str:
    """Octaves of value noise, each of half the scale (2 at least) and half the weight; about -1 to 1."""
    parts = [f"({value_noise(x, z, max(2.0, scale / 2**o), seed + OCTAVE_SEED * o, d)} * 2 - 1) * {d.num(0.5**o)}" for o in range(octaves)]
    return f"(({' + '.join(parts)}) / {d.num(sum(0.5**o for o in range(octaves)))})"
