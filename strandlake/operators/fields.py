"""Analytic fields from curve geometry, and volumes rasterised from curves."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.vec3 import dot, safe, vec
from strandlake.grid import BITS, DY, DZ, MASK, ball_offsets, pack, zyx
from strandlake.operators.curves import AX, densify, tangents
from strandlake.operators.ranges import nearest
from strandlake.operators.stencil import TILE, median3
from strandlake.session import materialize


def spine_points(curves: DataFrame, factor: int = 12, domain: tuple[float, float, float] | None = None) -> DataFrame:
    """Dense points with unit tangents: (sid, curve, seq, z, y, x, tz, ty, tx), wrapped into the domain."""
    t = tangents(curves)
    d = densify(t, factor, cols=("z", "y", "x", "tz", "ty", "tx"))
    nn = F.sqrt(dot(vec("t"), vec("t")))
    d = d.withColumn("_n", F.when(nn == 0, 1.0).otherwise(nn))
    pos = [F.col(c) for c in AX] if domain is None else [F.pmod(F.col(c), F.lit(float(n))) for c, n in zip(AX, domain)]
    return d.select("curve", "seq", *[p.alias(c) for p, c in zip(pos, AX)], *[(F.col(f"t{c}") / F.col("_n")).alias(f"t{c}") for c in AX])


def analytic_field(fg: DataFrame, spine: DataFrame, domain=None, sigma: float = 1.0, k: int = 8, cell: float = 4.0) -> DataFrame:
    """Signed potential and tangent of every foreground voxel.

    d1: nearest spine point and its curve; d2: nearest of the k neighbours that lies on another curve
    (999 if none). I = clip(g1 - 1.5 gx, -1, 1), g1 a Gaussian of d1 (0 below 1e-4), gx a valley where
    both are within 3.
    """
    s = spine.withColumn("sk", F.struct("curve", "seq"))
    own = F.col("_first.curve")
    # one row a voxel leaves the search, not k
    f = nearest(fg, s, "vid", "sk", k=k, period=domain, cell=cell, carry=["tz", "ty", "tx"], fold=[
        F.min(F.struct("d2", "_sk", *[F.col(f"_v_t{c}").alias(f"o{c}") for c in AX])).alias("b"), F.min(F.when(F.col("_sk.curve") != own, F.col("d2"))).alias("q")])
    f = f.select("vid", F.sqrt("b.d2").alias("d1"), F.coalesce(F.sqrt("q"), F.lit(999.0)).alias("d2"), F.col("b._sk.curve").alias("curve"), "b.oz", "b.oy", "b.ox")
    return f.select("vid", "curve", "d1", "d2", potential(F.col("d1"), F.col("d2"), sigma).alias("intensity"), "oz", "oy", "ox")


def potential(d1, d2, sigma: float = 1.0):
    g = F.exp(-(d1 * d1) / (2.0 * sigma * sigma))
    g = F.when(g < 1e-4, 0.0).otherwise(g)
    x = F.when((d1 <= 3.0) & (d2 <= 3.0), F.exp(-(d1 * d1 + d2 * d2) / (2.0 * 1.5 * 1.5))).otherwise(0.0)
    return F.least(F.greatest(g - 1.5 * x, F.lit(-1.0)), F.lit(1.0))


def rasterise(spine: DataFrame, shape) -> DataFrame:
    """Curve number per voxel: points rounded half to even, wrapped; the later curve wins."""
    pos = [F.pmod(F.bround(F.col(c)).cast("int"), F.lit(n)).alias(c) for c, n in zip(AX, shape)]
    p = spine.select("curve", *pos).withColumn("vid", pack("z", "y", "x"))
    return p.groupBy("vid", "z", "y", "x").agg(F.max("curve").alias("label"))


def _extent(left):
    return F.floor(F.sqrt(F.greatest(left, F.lit(0.0))) + 1e-9).cast("int")


def _balls(shape):
    """Voxels of one tile that balls around points (z, y, x) cover; each ball is walked axis by axis, its range along x is one run."""
    def run(group: pa.Table) -> pa.Table:
        t = group.column("tile")[0].as_py()
        low = [(t >> s & MASK) * TILE for s in (2 * BITS, BITS, 0)]
        end = [min(o + TILE, n) - o for o, n in zip(low, shape)]
        at = [group.column(c).to_numpy().astype(np.int64) - o for c, o in zip(AX, low)]
        r = group.column("_r").to_numpy()
        ext = lambda left: np.floor(np.sqrt(np.maximum(left, 0.0)) + 1e-9).astype(np.int64)
        reach = int(ext(r * r).max())
        o = np.arange(-reach, reach + 1)
        marks = np.zeros(TILE * TILE * (TILE + 1), np.int64)
        each = max(1, (1 << 18) // len(o) ** 2)
        for i in range(0, len(r), each):
            z, y, x = (a[i:i + each] for a in at)
            left = (r[i:i + each] * r[i:i + each])[:, None]
            zz, rest = z[:, None] + o, left - o * o
            p, q = np.nonzero((np.abs(o) <= ext(left)) & (zz >= 0) & (zz < end[0]))
            left, zz = rest[p, q][:, None], zz[p, q]
            yy, rest = y[p][:, None] + o, left - o * o
            k, q = np.nonzero((np.abs(o) <= ext(left)) & (yy >= 0) & (yy < end[1]))
            half, row, mid = ext(rest[k, q]), (zz[k] * TILE + yy[k, q]) * (TILE + 1), x[p][k]
            a, b = np.clip(mid - half, 0, end[2]), np.clip(mid + half + 1, 0, end[2])
            marks += np.bincount(row + a, minlength=len(marks)) - np.bincount(row + b, minlength=len(marks))
        held = np.cumsum(marks.reshape(TILE, TILE, TILE + 1), axis=2)[:, :, :TILE] > 0
        z, y, x = (a.astype(np.int64) + o for a, o in zip(np.nonzero(held), low))
        return pa.table({"vid": z * DZ + y * DY + x})
    return run


def dilate_by_radius(points: DataFrame, shape, radius: str = "r", fixed: float | None = None) -> DataFrame:
    """Periodic union of balls around (rounded) points; each point has its own radius.

    A point is copied, as it lies across the borders, to the tiles its ball may meet; a task fills one tile after the other.
    """
    r = F.lit(float(fixed)) if fixed is not None else F.col(radius).cast("double")
    base = points.select(*[F.bround(F.col(c)).cast("int").alias(c) for c in AX], r.alias("_r"))
    # one voxel keeps its largest ball only
    base = base.groupBy(*AX).agg(F.max("_r").alias("_r")).withColumn("_k", _extent(F.col("_r") * F.col("_r")))
    for c, n in zip(AX, shape):
        shift = F.sequence(-F.floor((F.col(c) + F.col("_k")) / F.lit(n)), F.floor((n - 1 + F.col("_k") - F.col(c)) / F.lit(n)))
        base = base.withColumn("_s", F.explode(shift)).withColumn(c, (F.col(c) + F.col("_s") * n).cast("int"))
        base = base.withColumn(f"_t{c}", F.explode(F.sequence(F.floor(F.greatest(F.col(c) - F.col("_k"), F.lit(0)) / TILE),
                                                              F.floor(F.least(F.col(c) + F.col("_k"), F.lit(n - 1)) / TILE))))
    near = base.select(pack(*[f"_t{c}" for c in AX]).alias("tile"), *AX, "_r").repartition("tile")
    out = near.groupBy("tile").applyInArrow(_balls(tuple(shape)), "vid long")
    return out.select(*zyx("vid"), "vid")


def unit_hash(seed: int, *cols):
    """Uniform number in [0, 1) from a row's own integer keys: the same under any partitioning and in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("double") / float(1 << 28)


def normal_hash(seed: int, *cols):
    u, v = unit_hash(seed, *cols), unit_hash(seed + 7919, *cols)
    return F.sqrt(-2.0 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2.0 * math.pi * v)


def augmented_tubes(curves: DataFrame, shape, max_shift: float = 2.0, seed: int = 42, factor: int = 8) -> tuple[DataFrame, DataFrame]:
    """(spine, volume) of jittered, beaded tubes.

    ``curves`` carries a radius ``r`` per point. Every curve is shifted by a random vector of bounded
    length; its radius gets a slow wave and one to three beads and is clipped to 1.5..5.5. The volume
    passes a 3x3x3 median.
    """
    g = [normal_hash(seed + i, F.col("curve")) for i in range(3)]
    nn = F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2]) + 1e-8
    mag = unit_hash(seed + 3, F.col("curve")) * max_shift
    moved = curves.select("curve", "seq", "r", *[(F.col(c) + v / nn * mag).alias(c) for c, v in zip(AX, g)])
    moved = moved.withColumns({c: F.pmod(F.col(c), F.lit(float(n))) for c, n in zip(AX, shape)})
    t = tangents(moved)
    d = densify(t, factor, cols=("z", "y", "x", "tz", "ty", "tx", "r"))
    m = d.groupBy("curve").agg(F.count(F.lit(1)).alias("m"))
    from strandlake.operators.lookup import salted_lookup

    # a curve's numbers are drawn once, not for each of its points
    draws = [0, 1, 2, *[k + b for k in (10, 20, 30) for b in range(3)]]
    m = m.select("curve", "m", *[unit_hash(seed + 100 + k, F.col("curve")).alias(f"_u{k}") for k in draws])
    d = salted_lookup(d, m, ["curve"], ["seq"], "inner")
    u = lambda k: F.col(f"_u{k}")
    s = F.col("seq") / F.greatest(F.col("m") - 1, F.lit(1))
    wave = F.sin(2 * math.pi * (1.0 + 2.5 * u(0)) * s) * (0.2 + 0.4 * u(1))
    beads = F.lit(0.0)
    n_beads = 1 + F.floor(3 * u(2))
    for b in range(3):
        c, w, a = 0.1 + 0.8 * u(10 + b), 0.02 + 0.05 * u(20 + b), 0.8 + 0.8 * u(30 + b)
        beads = beads + F.when(F.lit(b) < n_beads, a * F.exp(-((s - c) * (s - c)) / (2.0 * w * w))).otherwise(0.0)
    tn = safe(F.sqrt(dot(vec("t"), vec("t"))), 1e-300)
    d = d.withColumn("r", F.least(F.greatest(F.col("r") + wave + beads, F.lit(1.5)), F.lit(5.5))).withColumn("_n", tn)
    spine = d.select("curve", "seq", "r", *AX, *[(F.col(f"t{c}") / F.col("_n")).alias(f"t{c}") for c in AX])
    spine = materialize(spine)   # read by all outputs
    return spine, materialize(median3(dilate_by_radius(spine, shape), shape))


def augmented_volume(curves: DataFrame, shape, max_shift: float = 2.0, seed: int = 42, factor: int = 8) -> dict[str, DataFrame]:
    """Augmented tubes with their fields: {'volume', 'centerline', 'orientation', 'spine'}; orientation is the tangent of the nearest
    spine point, across the border."""
    spine, vol = augmented_tubes(curves, shape, max_shift, seed, factor)
    near = nearest(vol, spine.withColumn("sk", F.struct("curve", "seq")), "vid", "sk", period=tuple(map(float, shape)), carry=["tz", "ty", "tx"])
    return {"volume": vol, "centerline": dilate_by_radius(spine, shape, fixed=2.0), "spine": spine,
            "orientation": near.select("vid", F.col("tz").alias("oz"), F.col("ty").alias("oy"), F.col("tx").alias("ox"))}
