"""Three-component vectors as triples of DOUBLE columns; everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str, names=("z", "y", "x")) -> Vec:
    return tuple(F.col(f"{prefix}{n}").cast("double") for n in names)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def lerp(a: Vec, b: Vec, t: Column) -> Vec:
    return tuple(p + (q - p) * t for p, q in zip(a, b))


def cross(a: Vec, b: Vec) -> Vec:
    """Cross product in the same component order as the inputs."""
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def safe(n: Column, eps: float = 1e-8) -> Column:
    """A norm that can be divided by: 1 where it vanishes (ANSI division raises on zero)."""
    return F.when(n < eps, F.lit(1.0)).otherwise(n)


def unit(a: Vec, eps: float = 1e-8) -> Vec:
    n = safe(norm(a), eps)
    return tuple(p / n for p in a)


def flip_if(cond: Column, a: Vec) -> Vec:
    return tuple(F.when(cond, -p).otherwise(p) for p in a)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


FIXED = 1_000_000_000


def fixed(c: Column) -> Column:
    """Nine-decimal fixed point, so that sums do not depend on the order of rows."""
    return F.bround(c * F.lit(float(FIXED))).cast("long")


def unfixed(c: Column) -> Column:
    return c.cast("double") / F.lit(float(FIXED))
