"""Scalar expressions as SQL text, for Spark and for the SQL engine that checks its results.

Builders in this package return text; `column` makes a Spark column of it. The two dialects differ in few operators only:
bitwise exclusive or, shifts, and rounding half to even.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dialect:
    name: str

    def xor(self, a: str, b: str) -> str:
        return f"({a} ^ {b})" if self.name == "spark" else f"xor({a}, {b})"

    def shr(self, a: str, n: int) -> str:
        """Arithmetic shift: rounds down, also for negative numbers."""
        return f"shiftright({a}, {n})" if self.name == "spark" else f"({a} >> {n})"

    def rint(self, a: str) -> str:
        return f"rint({a})" if self.name == "spark" else f"round_even({a}, 0)"

    def div_floor(self, a: str, n: int) -> str:
        return f"cast(floor(({a}) / {n}.0D) as int)" if self.name == "spark" else f"cast(floor(({a}) / {n}.0) as int)"

    def truncate(self, a: str) -> str:
        """Towards zero."""
        return f"cast({a} as int)" if self.name == "spark" else f"cast(trunc({a}) as int)"

    def num(self, v: float) -> str:
        """A double literal."""
        return f"{v!r}D" if self.name == "spark" else f"cast({v!r} as double)"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def column(text: str) -> Column:
    return F.expr(text)


def clip(text: str, low: str | float, high: str | float) -> str:
    return f"least(greatest({text}, {low}), {high})"


def case(branches: list[tuple[str, str]], otherwise: str | None = None) -> str:
    """First branch that holds wins. Overwriting assignments become a case by listing the last one first."""
    tail = "" if otherwise is None else f" else {otherwise}"
    return "case " + " ".join(f"when {c} then {v}" for c, v in branches) + f"{tail} end"
