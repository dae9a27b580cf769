"""Bending donor curves onto target curves, and stamping them where they stay separable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.vec3 import dot, safe
from strandlake.grid import ball_offsets, pack
from strandlake.operators.curves import AX, arc_length, frames, neighbours_on_curve, tangents
from strandlake.operators.fields import unit_hash
from strandlake.operators.geometry import project_to_curve
from strandlake.operators.ranges import distance2, near_join, nearest, within_distance_anti
from strandlake.session import materialize, release

BODY_LEVEL = 0.40     # interpolated mask value above which a voxel belongs to the curve's body
END_SLACK = 0.5       # voxels past an end plane by more than this are cut


def tube_voxels(curves: DataFrame, shape, margin: float = 6.0) -> DataFrame:
    """(curve, vid, z, y, x): voxels within ``margin`` of every int(margin/2)-th curve point, clipped."""
    step = max(1, int(margin / 2))
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("z"), F.lit(b).alias("y"), F.lit(c).alias("x")) for a, b, c in ball_offsets(margin)]))
    p = curves.filter(F.col("seq") % step == 0).select("curve", *[F.bround(F.col(c)).cast("int").alias(c) for c in AX]).distinct()
    p = p.withColumn("_o", o).select("curve", *[(F.col(c) + F.col(f"_o.{c}")).alias(c) for c in AX])
    for c, n in zip(AX, shape):
        p = p.filter((F.col(c) >= 0) & (F.col(c) < n))
    return p.distinct().withColumn("vid", pack(*AX))


def _framed(curves: DataFrame) -> DataFrame:
    c = curves.select("curve", "seq", *[F.col(a).cast("double").alias(a) for a in AX])
    return arc_length(c).join(frames(c), ["curve", "seq"])


def deform(targets: DataFrame, donors: dict[str, DataFrame], picks: DataFrame, shape, margin: float = 6.0, seed: int = 0) -> DataFrame:
    """(curve, vid, z, y, x): the body of each target curve, sampled backwards from its donor.

    ``picks``: (curve, donor). Position along the target maps to the donor's arc one to one from a
    random offset (or stretched if the donor is shorter), position across it through both frames; the
    donor mask is read by trilinear interpolation, as a join on its eight corner voxels.
    """
    t = materialize(_framed(targets))
    t_len = t.groupBy("curve").agg(F.max("arc").alias("t_len")).filter("t_len >= 1e-4")
    d = materialize(_framed(donors["curves"]))
    d_len = d.groupBy("curve").agg(F.max("arc").alias("d_len"), F.max("seq").alias("last")).withColumnRenamed("curve", "donor")
    vox = tube_voxels(targets, shape, margin).withColumn("k", F.struct("curve", "vid"))
    fr = ["nz", "ny", "nx", "bz", "by", "bx"]
    p = project_to_curve(vox, t, "k", carry=fr, on=["curve"]).drop("curve")
    p = p.select(F.col("k.curve").alias("curve"), F.col("k.vid").alias("vid"), "pz", "py", "px", "arc", *fr).join(vox.drop("k"), ["curve", "vid"])
    diff = [F.col(c) - F.col(f"p{c}") for c in AX]
    n, b = [F.col(c) for c in fr[:3]], [F.col(c) for c in fr[3:]]
    p = p.withColumns({"u": dot(diff, n) / (F.sqrt(dot(n, n)) + 1e-8), "v": dot(diff, b) / (F.sqrt(dot(b, b)) + 1e-8)})
    # nothing sticks out past the end planes
    tg = tangents(targets.select("curve", "seq", *[F.col(a).cast("double").alias(a) for a in AX]))
    ends = tg.groupBy("curve").agg(F.min_by(F.struct(*AX, "tz", "ty", "tx"), "seq").alias("s"), F.max_by(F.struct(*AX, "tz", "ty", "tx"), "seq").alias("e"))
    p = p.join(ends, "curve")
    past = lambda e, sign: dot([F.col(c) - F.col(f"{e}.{c}") for c in AX], [F.col(f"{e}.t{c}") * sign for c in AX])
    p = p.filter((past("s", -1.0) <= END_SLACK) & (past("e", 1.0) <= END_SLACK))
    p = p.join(t_len, "curve").join(picks, "curve").join(d_len, "donor")
    off = unit_hash(seed, F.col("curve"), F.col("donor")) * (F.col("d_len") - F.col("t_len"))
    a = F.when(F.col("t_len") <= F.col("d_len"), off + F.col("arc")).otherwise(F.col("arc") / F.col("t_len") * F.col("d_len"))
    p = p.select("curve", "vid", *AX, "u", "v", "donor", "last", a.alias("da")).withColumn("slot", F.floor("da"))
    # donor segments, listed under every whole number of arc they meet: an as-of join on equality
    seg = neighbours_on_curve(d, "curve", "seq", [*AX, "arc", *fr], 1).filter("z_p1 is not null").withColumnRenamed("curve", "donor")
    seg = seg.withColumnRenamed("seq", "dseq").withColumn("slot", F.explode(F.sequence(F.floor("arc"), F.floor("arc_p1"))))
    seg = seg.select("donor", "slot", "dseq", "arc", "arc_p1", *[F.col(c).alias(f"d{c}") for c in [*AX, *fr]], *[F.col(f"{c}_p1").alias(f"e{c}") for c in [*AX, *fr]])
    j = p.join(seg, ["donor", "slot"])
    hit = ((F.col("da") > F.col("arc")) | (F.col("dseq") == 0)) & ((F.col("da") <= F.col("arc_p1")) | (F.col("dseq") == F.col("last") - 1))
    j = j.filter(hit)
    al = F.least(F.greatest((F.col("da") - F.col("arc")) / (F.col("arc_p1") - F.col("arc") + 1e-8), F.lit(0.0)), F.lit(1.0))
    mix = lambda c: F.col(f"d{c}") + al * (F.col(f"e{c}") - F.col(f"d{c}"))
    j = j.select("curve", "vid", *AX, "donor", *[(mix(c) + F.col("u") * mix(f"n{c}") + F.col("v") * mix(f"b{c}")).alias(f"s{c}") for c in AX])
    j = j.dropDuplicates(["curve", "vid"])
    w = trilinear(j, donors["mask"].withColumnRenamed("curve", "donor"), ["curve", "vid", *AX], ["donor"])
    return w.filter(F.col("value") > BODY_LEVEL).select("curve", "vid", *AX)


def trilinear(points: DataFrame, mask: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Interpolated mask value at (sz, sy, sx): each point joins the eight voxels around it."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("z"), F.lit(b).alias("y"), F.lit(c).alias("x")) for a in (0, 1) for b in (0, 1) for c in (0, 1)]))
    p = points.withColumn("_c", corner)
    w = F.lit(1.0)
    pos = []
    for c in AX:
        f = F.floor(F.col(f"s{c}"))
        t = F.col(f"s{c}") - f
        w = w * F.when(F.col(f"_c.{c}") == 1, t).otherwise(1.0 - t)
        pos.append(f + F.col(f"_c.{c}"))
    inside = (pos[0] >= 0) & (pos[1] >= 0) & (pos[2] >= 0)
    p = p.filter(inside).select(*keys, *on, w.alias("_w"), pack(*pos).alias("_m"))
    j = p.join(mask.select(*on, F.col("vid").alias("_m")), [*on, "_m"])
    return j.groupBy(*keys).agg((F.sum(F.bround(F.col("_w") * 1e9).cast("long")) / F.lit(1e9)).alias("value"))


def two_nearest_curves(points: DataFrame, curves: DataFrame, radius: float) -> DataFrame:
    """(vid, d1, d2) where two different curves pass within ``radius``."""
    c = curves.select("curve", *[F.col(a).alias(f"c{a}") for a in AX])
    j = near_join(points.select("vid", *AX), c, radius, AX, ("cz", "cy", "cx"))
    j = j.withColumn("d", distance2(AX, ("cz", "cy", "cx"))).filter(F.col("d") <= radius * radius)
    g = j.groupBy("vid", "curve").agg(F.min("d").alias("d"))
    g = g.groupBy("vid").agg(F.sort_array(F.collect_list("d")).alias("l")).filter(F.size("l") > 1)
    return g.select("vid", F.sqrt(F.col("l")[0]).alias("d1"), F.sqrt(F.col("l")[1]).alias("d2"))


def render(bodies: DataFrame, curves: DataFrame) -> DataFrame:
    """Fields of a rendered patch: vid, z, y, x, intensity, oz, oy, ox.

    Intensity falls off with the distance to the nearest curve (within 6.5) and dips where two curves
    are within 3; the direction is that of the last curve within 5.
    """
    fg = materialize(bodies.select("vid", *AX).distinct())
    cs = curves.select("curve", "seq", *[F.col(a).cast("double").alias(a) for a in AX])
    n = nearest(fg, cs.withColumn("sk", F.struct("curve", "seq")), "vid", "sk", max_radius=6.5).select("vid", F.col("d2").alias("q"))
    two = two_nearest_curves(fg, cs, 3.0)
    gx = F.exp(-(F.col("d1") * F.col("d1") + F.col("d2") * F.col("d2")) / (2.0 * 1.5 * 1.5))
    i = F.exp(-F.col("q") / 2.0) - F.coalesce(1.5 * gx, F.lit(0.0))
    out = fg.join(n.join(two, "vid", "left").select("vid", F.least(F.greatest(i, F.lit(-1.0)), F.lit(1.0)).alias("intensity")), "vid", "left")
    t = tangents(cs).select("curve", *[F.col(a).alias(f"c{a}") for a in AX], "seq", "tz", "ty", "tx")
    j = near_join(fg, t, 5.0, AX, ("cz", "cy", "cx")).withColumn("d", distance2(AX, ("cz", "cy", "cx"))).filter("d <= 25")
    # the last curve, and its nearest point
    j = j.groupBy("vid").agg(F.min(F.struct((-F.col("curve")).alias("k"), "d", "seq", "tz", "ty", "tx")).alias("b"))
    out = out.join(j.join(n.select("vid"), "vid", "left_semi").select("vid", F.col("b.tz").alias("oz"), F.col("b.ty").alias("oy"), F.col("b.tx").alias("ox")), "vid", "left")
    return out.fillna(0.0, ["intensity", "oz", "oy", "ox"])


def separable_offsets(stamps: DataFrame, existing: DataFrame, tries: DataFrame, min_distance: float = 6.0, max_rounds: int = 1_000) -> DataFrame:
    """(stamp, patch, try, z0, y0, x0): where stamps are placed, patch by patch in the order of their numbers.

    A stamp takes its first try whose centre line keeps clear of the patch's centre lines and of the stamps placed before it; one
    without such a try is left out. All tries of all stamps are tested in two joins: with the existing lines, and among
    themselves. Then rounds decide every stamp that no undecided earlier one can still get in the way of, in all patches at once; in each
    patch the first undecided stamp is one of them. Stamps far apart do not wait for each other.

    ``stamps``: stamp, z, y, x, intensity; ``existing``: patch, z, y, x, intensity; ``tries``: stamp, patch, try, z0, y0, x0.
    """
    t = tries.join(stamps.filter("intensity > 0.5").select("stamp", *AX).hint("merge"), "stamp")   # no table of stamps passes through the driver
    t = materialize(t.select("stamp", "try", "patch", *[(F.col(c) + F.col(f"{c}0")).alias(c) for c in AX]))
    e = existing.filter("intensity > 0.5").select("patch", *[F.col(c).alias(f"e{c}") for c in AX])
    close = lambda df: df.filter(distance2(AX, ("ez", "ey", "ex")) < min_distance ** 2)
    bad = close(near_join(t, e, min_distance, AX, ("ez", "ey", "ex"), ["patch"])).select("stamp", "try").distinct()
    named = tries.select("stamp", "patch", "try").distinct()
    open_ = materialize(named.join(bad.hint("merge"), ["stamp", "try"], "left_anti"))
    o = t.select("patch", F.col("stamp").alias("before"), F.col("try").alias("its"), *[F.col(c).alias(f"e{c}") for c in AX])
    meet = close(near_join(t, o, min_distance, AX, ("ez", "ey", "ex"), ["patch"]).filter("before < stamp"))
    meet = materialize(meet.select("stamp", "try", "before", "its").distinct())
    placed = []
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        first = open_.groupBy("stamp", "patch").agg(F.min("try").alias("try"))
        rivals = meet.join(open_.select(F.col("stamp").alias("before"), F.col("try").alias("its")).hint("merge"), ["before", "its"], "left_semi")
        won = materialize(first.join(rivals.select("stamp", "try").distinct().hint("merge"), ["stamp", "try"], "left_anti"))
        placed.append(won)
        spoilt = meet.join(won.select(F.col("stamp").alias("before"), F.col("try").alias("its")).hint("merge"), ["before", "its"], "left_semi").select("stamp", "try").distinct()
        rest = open_.join(won.select("stamp").hint("merge"), "stamp", "left_anti").join(spoilt.hint("merge"), ["stamp", "try"], "left_anti")
        past, open_ = open_, materialize(rest)
        release(past)
    else:
        raise RuntimeError("stamps were not placed within the rounds")
    out = named.limit(0)
    for won in placed:
        out = out.union(won.select(*named.columns))
    return out.join(tries.select("stamp", "try", "z0", "y0", "x0").hint("merge"), ["stamp", "try"]).select("stamp", "patch", "try", "z0", "y0", "x0")


def place_stamps(patches: DataFrame, stamps: DataFrame, tries: DataFrame, min_distance: float = 6.0) -> DataFrame:
    """Patches with all stamps merged in that find a place, as if one after the other: the k-th stamps of all patches at once."""
    where = separable_offsets(stamps, patches, tries, min_distance)
    where = materialize(where.withColumn("k", F.row_number().over(Window.partitionBy("patch").orderBy("stamp"))))   # a patch holds few stamps
    now = patches.select("patch", *AX, "intensity", "oz", "oy", "ox")
    for k in range(1, (where.agg(F.max("k")).first()[0] or 0) + 1):
        at = where.filter(F.col("k") == k)
        new = merge_stamps(now.join(at.select("patch"), "patch", "left_semi"), stamps, at.drop("patch", "k").join(at.select("stamp", "patch"), "stamp"))
        now = materialize(now.join(at.select("patch"), "patch", "left_anti").union(new.select(*now.columns)))
    return now


def merge_stamps(patches: DataFrame, stamps: DataFrame, offsets: DataFrame) -> DataFrame:
    """Patches (patch, z, y, x, intensity, o*) with the accepted stamps merged in.

    Intensity: maximum, minus the crossing valley where bodies overlap and both centre lines are within
    3.5; direction: the stamp's inside its body.
    """
    s = stamps.join(offsets, "stamp").select("patch", *[(F.col(c) + F.col(f"{c}0")).cast("int").alias(c) for c in AX],
                                            F.col("intensity").alias("si"), *[F.col(f"o{c}").alias(f"s{c}") for c in AX])
    j = patches.join(s, ["patch", *AX], "full")
    both = j.filter("intensity is not null and si is not null").select("patch", F.struct("patch", pack(*AX).alias("vid")).alias("k"), *AX)
    near = lambda df, i: nearest(both, df.filter(F.col(i) > 0.5).select("patch", *AX, pack(*AX).alias("sk")), "k", "sk", on=["patch"], max_radius=3.5)
    d1, d2 = near(patches, "intensity").select("k", F.col("d2").alias("q1")), near(s, "si").select("k", F.col("d2").alias("q2"))
    dip = d1.join(d2, "k").select("k.patch", F.col("k.vid").alias("vid"), (1.5 * F.exp(-(F.col("q1") + F.col("q2")) / 4.5)).alias("dip"))
    j = j.withColumn("vid", pack(*AX)).join(dip, ["patch", "vid"], "left")
    i = F.greatest(F.coalesce("intensity", F.lit(0.0)), F.coalesce("si", F.lit(0.0))) - F.coalesce("dip", F.lit(0.0))
    i = F.when(F.col("intensity").isNull(), F.greatest(F.col("si"), F.lit(0.0))).otherwise(i)
    return j.select("patch", *AX, F.least(F.greatest(i, F.lit(-1.0)), F.lit(1.0)).alias("intensity"),
                    *[F.coalesce(f"s{c}", f"o{c}").alias(f"o{c}") for c in AX])
