"""Deterministic hashes of integer coordinates.

Both hashes mix the coordinates linearly, fold, multiply and fold, and keep 24 bits. hash24 multiplies with 64-bit
wraparound, bhash24 within 32 bits. Spark's ANSI arithmetic raises on overflow; only the low 40 bits of the product reach
the result, so it is put together from two 20-bit halves that cannot overflow.
"""

from __future__ import annotations

from gridloom.functions.dialect import SPARK, Dialect

# fixed values: the factors of x, z and seed, and that of the fold
FACTOR_X, FACTOR_Z, FACTOR_SEED, FACTOR_FOLD = 374761393, 668265263, 1442695041, 1274126177
MASK_20, MASK_24, MASK_32, MASK_40 = 0xFFFFF, 0xFFFFFF, 0xFFFFFFFF, 0xFFFFFFFFFF


def _linear(x: str, z: str, seed: int) -> str:
    return f"(cast({x} as bigint) * {FACTOR_X} + cast({z} as bigint) * {FACTOR_Z} + cast({seed * FACTOR_SEED} as bigint))"


def hash24(x: str, z: str, seed: int, d: Dialect = SPARK) -> str:
    """0 .. 2^24 - 1, as 64-bit integers wrap."""
    h = _linear(x, z, seed)
    g = d.xor(h, d.shr(h, 13))
    low, high = f"({g} & {MASK_20})", f"({d.shr(g, 20)} & {MASK_20})"
    p = f"(({low} * {FACTOR_FOLD} + (({high} * {FACTOR_FOLD}) & {MASK_20}) * 1048576) & {MASK_40})"
    return f"({d.xor(p, d.shr(p, 16))} & {MASK_24})"


def hash01(x: str, z: str, seed: int, d: Dialect = SPARK) -> str:
    """0 to 1, both reached."""
    return f"({hash24(x, z, seed, d)} / {d.num(float(MASK_24))})"


def bhash24(x: str, z: str, salt: int, d: Dialect = SPARK) -> str:
    """0 .. 2^24 - 1, masked to 32 bits before and after the product."""
    h = f"({_linear(x, z, salt)} & {MASK_32})"
    p = f"(({d.xor(h, d.shr(h, 13))} * {FACTOR_FOLD}) & {MASK_32})"
    return f"({d.xor(p, d.shr(p, 16))} & {MASK_24})"


def bhash(x: str, z: str, salt: int, d: Dialect = SPARK) -> str:
    return f"({bhash24(x, z, salt, d)} / {d.num(float(MASK_24))})"
