"""Costs as column expressions. Angles come from clipped cosines; vectors are triples of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.vec3 import clip, dot, norm, safe, vec
from strandlake.params import (CURVATURE_WEIGHT, GAP_WEIGHT, LENGTH_BONUS, SHARP_ANGLE_DEG, SHARP_PENALTY, STUB_LENGTH,
                               STUB_PENALTY, TURN_WEIGHT)

# An angle exceeds the sharp limit exactly when its cosine is below this.
SHARP_COS = math.cos(math.radians(SHARP_ANGLE_DEG))


def length_bonus(n: Column) -> Column:
    return F.lit(-LENGTH_BONUS) * n


def stub_cost(n: Column) -> Column:
    return F.when(n >= STUB_LENGTH, 0.0).otherwise(F.lit(STUB_PENALTY) / F.greatest(n, F.lit(1)))


def gap_cost(gap: Column) -> Column:
    return F.lit(GAP_WEIGHT) * gap


def turn_cost(a, b) -> Column:
    """Change of direction at a joint, ignoring the sign of either vector."""
    return F.lit(TURN_WEIGHT) * F.acos(clip(F.abs(dot(a, b)), 0.0, 1.0))


def bridge_cost(a, b, gap: Column, mean_samples=None, cos_a: Column | None = None, cos_b: Column | None = None) -> Column:
    total = gap_cost(gap) + turn_cost(a, b)
    if cos_a is not None and cos_b is not None:
        ta, tb = F.acos(clip(cos_a, -1.0, 1.0)), F.acos(clip(cos_b, -1.0, 1.0))
        sharp = (cos_a < SHARP_COS) | (cos_b < SHARP_COS)
        total = total + F.lit(CURVATURE_WEIGHT) * (ta + tb) + F.when(sharp, SHARP_PENALTY).otherwise(0.0)
    if mean_samples is not None:
        n = norm(mean_samples)
        m = [v / safe(n) for v in mean_samples]
        lack = lambda v: F.greatest(F.lit(0.0), F.lit(0.70) - F.abs(dot(v, m)))
        total = total + F.when(n > 1e-8, F.lit(TURN_WEIGHT) * (lack(a) + lack(b)) * 10.0).otherwise(0.0)
    return total


def self_costs(turns: DataFrame, sizes: DataFrame, curve: str = "curve") -> DataFrame:
    """Per curve: mean-turn cost, sharp-bend cost and the total of a segment on its own.

    ``turns`` has (curve, cos_turn), ``sizes`` has (curve, n).
    """
    t = turns.groupBy(curve).agg(
        F.sum(F.bround(F.acos("cos_turn") * 1e9).cast("long")).alias("_a"),
        F.count(F.lit(1)).alias("_k"),
        F.sum(F.when(F.col("cos_turn") < SHARP_COS, 1).otherwise(0)).alias("_s"))
    j = sizes.join(t, curve, "left")
    curv = F.coalesce(F.col("_a") / F.lit(1e9) / F.col("_k") * CURVATURE_WEIGHT, F.lit(0.0))
    sharp = F.coalesce(F.col("_s"), F.lit(0)) * SHARP_PENALTY
    n = F.col("n")
    return j.select(curve, "n", curv.alias("curvature_cost"), sharp.alias("sharp_cost"),
                    (length_bonus(n) + curv + sharp + stub_cost(n)).alias("self_cost"))


def merged_cost(n_a: Column, n_b: Column, shape_cost_a: Column, shape_cost_b: Column, bridge: Column) -> Column:
    """Cost of two segments joined into one; shape costs are curvature plus sharp bends."""
    n = n_a + n_b
    return length_bonus(n) + shape_cost_a + shape_cost_b + bridge + stub_cost(n)
