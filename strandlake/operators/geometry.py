"""Rigid moves of voxel fields and curves, as coordinate arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.vec3 import dot
from strandlake.grid import pack
from strandlake.operators.curves import AX, curve_lengths, neighbours_on_curve
from strandlake.operators.fields import normal_hash, unit_hash
from strandlake.operators.lookup import salted_lookup
from strandlake.session import materialize


def flip(df: DataFrame, axis: str, n: int) -> DataFrame:
    """Mirror along one axis; the matching vector component changes sign."""
    cols = {axis: (F.lit(n - 1) - F.col(axis)).cast("int")}
    if f"o{axis}" in df.columns:
        cols[f"o{axis}"] = -F.col(f"o{axis}")
    out = df.withColumns(cols)
    return out.withColumn("vid", pack("z", "y", "x")) if "vid" in df.columns else out


def rotate90(df: DataFrame, a: str, b: str, k: int, n: int) -> DataFrame:
    """k quarter turns in the plane (a, b) of a cube of side n: (a, b) -> (n-1-b, a), (va, vb) -> (-vb, va)."""
    out = df
    has = f"o{a}" in df.columns
    for _ in range(k % 4):
        cols = {a: (F.lit(n - 1) - F.col(b)).cast("int"), b: F.col(a)}
        if has:
            cols |= {f"o{a}": -F.col(f"o{b}"), f"o{b}": F.col(f"o{a}")}
        out = out.withColumns(cols)
    return out.withColumn("vid", pack("z", "y", "x")) if "vid" in df.columns else out


def augment_field(df: DataFrame, n: int, seed: int, key: str = "sample") -> DataFrame:
    """Random flips and quarter turns (planes yx, zx, zy in this order), drawn per sample key."""
    out = df
    for i, c in enumerate("zyx"):
        hit = unit_hash(seed + i, F.col(key)) > 0.5
        out = out.withColumns({c: F.when(hit, F.lit(n - 1) - F.col(c)).otherwise(F.col(c)).cast("int"),
                               f"o{c}": F.when(hit, -F.col(f"o{c}")).otherwise(F.col(f"o{c}"))})
    for i, (a, b) in enumerate((("y", "x"), ("z", "x"), ("z", "y"))):
        k = F.floor(4 * unit_hash(seed + 10 + i, F.col(key)))
        turn = lambda p, q, m: F.when(k == 0, p).when(k == 1, m(q)).when(k == 2, m(p)).otherwise(q)
        back = lambda p, q, m: F.when(k == 0, q).when(k == 1, p).when(k == 2, m(q)).otherwise(m(p))
        mi = lambda c: F.lit(n - 1) - c
        ng = lambda c: -c
        pa, pb, va, vb = F.col(a), F.col(b), F.col(f"o{a}"), F.col(f"o{b}")
        out = out.withColumns({a: turn(pa, pb, mi).cast("int"), b: back(pa, pb, mi).cast("int"),
                               f"o{a}": turn(va, vb, ng), f"o{b}": back(va, vb, ng)})
    return out.withColumn("vid", pack("z", "y", "x"))


def augment_curves(curves: DataFrame, size: int = 96, jitter: float = 2.5, wobble: float = 1.2, seed: int = 0,
                   block: str = "block") -> DataFrame:
    """Shift, flips and yaw turns shared by a block of curves; a sine wobble of its own per curve."""
    out = curves
    b = F.col(block)
    mi = lambda c: F.lit(float(size - 1)) - c
    out = out.withColumns({c: F.col(c) + normal_hash(seed + i, b) * jitter for i, c in enumerate(AX)})
    out = out.withColumns({c: F.when(unit_hash(seed + 20 + i, b) > 0.5, mi(F.col(c))).otherwise(F.col(c)) for i, c in enumerate(AX)})
    k = F.floor(4 * unit_hash(seed + 30, b))
    y, x = F.col("y"), F.col("x")
    # one turn: (y, x) -> (x, size-1-y)
    out = out.withColumns({"y": F.when(k == 0, y).when(k == 1, x).when(k == 2, mi(y)).otherwise(mi(x)),
                           "x": F.when(k == 0, x).when(k == 1, mi(y)).when(k == 2, mi(x)).otherwise(y)})
    out = salted_lookup(out, curve_lengths(out), ["curve"], ["seq"], "inner")
    c = F.col("curve")
    d = [normal_hash(seed + 40 + i, c) for i in range(3)]
    nn = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) + 1e-8
    amp = 0.5 + (wobble - 0.5) * unit_hash(seed + 50, c)
    s = F.sin(2 * math.pi * F.col("seq") / F.greatest(F.col("n") - 1, F.lit(1)))
    go = (F.col("n") > 4) & F.lit(wobble > 0)
    return out.withColumns({a: F.col(a) + F.when(go, s * v / nn * amp).otherwise(0.0) for a, v in zip(AX, d)}).drop("n")


def project_to_curve(points: DataFrame, curves: DataFrame, key: str = "vid", cell: float = 4.0,
                     carry: list[str] | None = None, max_radius: float | None = None, on: list[str] | None = None) -> DataFrame:
    """Foot point of every point on the nearest curve: (key, curve, pz, py, px, arc, d2[, carried]).

    The nearest curve point is found first; then the segments before and after it compete (the later
    one wins only if strictly closer). ``curves``: curve, seq, z, y, x, arc; ``carry`` columns are
    interpolated. With ``on=["curve"]``, each point is projected onto its own curve.
    """
    from strandlake.operators.ranges import nearest

    carry = carry or []
    cols = [*AX, "arc", *carry]
    # both are read twice: by the search, and for the segments
    curves = materialize(curves.select("curve", "seq", *cols))
    points = materialize(points.select(*dict.fromkeys([key, *(on or []), *AX])))
    nb = neighbours_on_curve(curves, "curve", "seq", cols, 2)
    near = nearest(points, curves.withColumn("sk", F.struct("curve", "seq")), key, "sk", cell=cell, max_radius=max_radius, on=on)
    j = near.select(key, F.col("sk.curve").alias("curve"), F.col("sk.seq").alias("seq")).join(nb, ["curve", "seq"])
    j = j.join(points.select(key, *[F.col(c).cast("double").alias(f"q{c}") for c in AX]), key)
    first, last = F.col("z_m1").isNull(), F.col("z_p1").isNull()
    j = j.filter(~(first & last))
    # ends of both segments as plain columns, one step after the other: a nested expression would be evaluated anew for each of its uses
    at = lambda c, o: F.col(c) if o == 0 else F.col(f"{c}_{'m' if o < 0 else 'p'}{abs(o)}")
    j = j.select(key, "curve", *[f"q{c}" for c in AX],
                 *[F.when(first, at(c, 0)).otherwise(at(c, -1)).alias(f"a0{c}") for c in cols], *[F.when(first, at(c, 1)).otherwise(at(c, 0)).alias(f"a1{c}") for c in cols],
                 *[F.when(last, at(c, -1)).otherwise(at(c, 0)).alias(f"b0{c}") for c in cols], *[F.when(last, at(c, 0)).otherwise(at(c, 1)).alias(f"b1{c}") for c in cols])
    foot = {}
    for s in "ab":
        v = [F.col(f"{s}1{c}").cast("double") - F.col(f"{s}0{c}") for c in AX]
        w = [F.col(f"q{c}") - F.col(f"{s}0{c}") for c in AX]
        foot[f"{s}t"] = F.least(F.greatest(dot(w, v) / (dot(v, v) + 1e-8), F.lit(0.0)), F.lit(1.0))
    j = j.withColumns(foot)
    lerp = lambda s, c: F.col(f"{s}0{c}") + F.col(f"{s}t") * (F.col(f"{s}1{c}") - F.col(f"{s}0{c}"))
    j = j.withColumns({f"{s}p{c}": lerp(s, c) for s in "ab" for c in AX})
    d2 = {s: [F.col(f"q{c}") - F.col(f"{s}p{c}") for c in AX] for s in "ab"}
    j = j.withColumns({f"{s}d2": dot(v, v) for s, v in d2.items()}).withColumn("late", F.col("bd2") < F.col("ad2"))
    pick = lambda f: F.when(F.col("late"), f("b")).otherwise(f("a"))
    return j.select(key, "curve", *[pick(lambda s: F.col(f"{s}p{c}")).alias(f"p{c}") for c in AX], pick(lambda s: lerp(s, "arc")).alias("arc"),
                    pick(lambda s: F.col(f"{s}d2")).alias("d2"), *[pick(lambda s: lerp(s, c)).alias(c) for c in carry])


def crop_curves(curves: DataFrame, boxes: DataFrame, size: int, min_points: int = 6, min_curves: int = 2) -> DataFrame:
    """Curves inside each candidate box (block, try, z0, y0, x0), from the first try with enough of them.

    A curve counts with ``min_points`` points inside. Coordinates come out relative to the box.
    """
    from strandlake.operators.ranges import near_join

    half = size / 2.0
    b = boxes.select("block", "try", *[F.col(f"{c}0") for c in AX], *[(F.col(f"{c}0") + half).alias(f"b{c}") for c in AX])
    j = near_join(b, curves.select("curve", "seq", *AX), half, [f"b{c}" for c in AX], list(AX))
    for c in AX:
        j = j.filter((F.col(c) >= F.col(f"{c}0")) & (F.col(c) < F.col(f"{c}0") + size))
    per = j.groupBy("block", "try", "curve").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_points)
    ok = per.groupBy("block", "try").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= min_curves)
    pick = ok.groupBy("block").agg(F.min("try").alias("try"))
    keep = per.join(pick, ["block", "try"]).select("block", "try", "curve")
    out = j.join(keep, ["block", "try", "curve"])
    return out.select("block", "curve", "seq", *[(F.col(c) - F.col(f"{c}0")).alias(c) for c in AX])
