"""Fragments: the curve pieces left when junctions are removed, with ends, order and directions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.vec3 import cross, dot, fixed, flip_if, norm, safe, unit, vec
from strandlake.grid import halo, tile_of, zyx
from strandlake.operators.components import HALF, TILE, connected_components
from strandlake.operators.ranges import near_join
from strandlake.operators.stencil import split_junctions
from strandlake.params import Params
from strandlake.session import materialize, release

WHOLE = 1 << 18          # voxels of a piece that one task ranks
ANCHOR_RANK = 6          # the sixth voxel nearest to an end, the end itself included
ANCHOR_REACH2 = 75       # five steps of a 26-path stay within 5*sqrt(3)
NEAR = 64                # side of the cells in which an end meets its own fragment: few ends lie near a face and are copied
WINDOW = 2               # half width of the direction window around the anchor


def fragment_voxels(skel: DataFrame, min_length: int = 1) -> DataFrame:
    """vid, z, y, x, frag; frag is the smallest voxel id of the piece."""
    _, rest = split_junctions(skel)
    f = connected_components(rest).withColumnRenamed("comp", "frag")
    if min_length > 1:
        keep = f.groupBy("frag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_length)
        f = f.join(keep.select("frag"), "frag", "left_semi").select("vid", "z", "y", "x", "frag")
    return f


def _tile_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest and largest neighbour of the voxels that this tile owns; -1 where there is none."""
    pdf = pdf.sort_values("vid")
    v, own = pdf["vid"].to_numpy(), pdf["own"].to_numpy()
    lo, hi = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), -1)
    for d in HALF:
        j = np.searchsorted(v, v + d)
        i = np.flatnonzero(j < len(v))
        i = i[v[j[i]] == v[i] + d]
        j = j[i]   # of one distance, a voxel has one neighbour on either side
        lo[i], hi[i] = np.minimum(lo[i], v[j]), np.maximum(hi[i], v[j])
        lo[j], hi[j] = np.minimum(lo[j], v[i]), np.maximum(hi[j], v[i])
    return pd.DataFrame({"vid": v, "frag": pdf["frag"].to_numpy(), "lo": np.where(hi < 0, -1, lo), "hi": hi})[own]


def links(fv: DataFrame) -> DataFrame:
    """vid, frag, sorted neighbour ids (at most two of them, as pieces hold no junctions).

    A task looks the neighbours up in its tile: sent to their 27 places, the voxels would be sorted and spilled for every place,
    voxel or not.
    """
    src = halo(fv.withColumn("home", tile_of(TILE)), TILE, 1).select("tile", "vid", "frag", (F.col("home") == F.col("tile")).alias("own"))
    s = src.groupBy("tile").applyInPandas(_tile_links, "vid long, frag long, lo long, hi long")
    nb = F.when(F.col("hi") < 0, F.array().cast("array<bigint>")).when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))
    return s.select("vid", "frag", nb.alias("nb"))


def _ranked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Lists that are whole in this task: pointer doubling on arrays."""
    a, b, c = (pdf[k].to_numpy() for k in "abc")
    goes = c >= 0
    vids = np.unique(np.concatenate([a, b]))
    n = len(vids)
    at = lambda v: np.searchsorted(vids, v)
    key = at(a) * n + at(b)
    order = np.argsort(key)
    last = np.arange(len(key))
    last[goes] = order[np.searchsorted(key[order], at(b[goes]) * n + at(c[goes]))]
    rank = goes.astype(np.int64)
    while True:
        ahead = last[last]
        if (ahead == last).all():
            return pd.DataFrame({"a": a, "b": b, "rank": rank, "la": a[last], "lb": b[last]})
        rank, last = rank + rank[last], ahead


def list_rank(darts: DataFrame, sizes: DataFrame, bound: int = WHOLE) -> DataFrame:
    """Distance of every dart to the end of its list: (frag, a, b, c) -> (a, b, rank, la, lb).

    A dart goes from voxel a to voxel b; the next one is (b, c), none where c is null. ``sizes`` (frag, length) tells which
    pieces fit a task: those are ranked whole, many in a task. Longer ones take rounds of pointer doubling, so the number of
    rounds is the logarithm of the longest list; every key occurs once, and nothing is skewed.
    """
    parts = max(int(darts.sparkSession.conf.get("spark.sql.shuffle.partitions")), sizes.agg(F.sum("length")).first()[0] // max(bound, 1))
    large = sizes.filter(F.col("length") > bound).select("frag")
    whole = darts.select("frag", "a", "b", F.coalesce("c", F.lit(-1)).alias("c")).join(large, "frag", "left_anti").withColumn("part", F.pmod(F.xxhash64("frag"), F.lit(parts)))
    out = whole.groupBy("part").applyInPandas(_ranked, "a long, b long, rank long, la long, lb long")
    if large.isEmpty():
        return out
    cur = materialize(darts.join(large, "frag", "left_semi").select(
        "a", "b", F.when(F.col("c").isNull(), 0).otherwise(1).cast("long").alias("rank"), F.when(F.col("c").isNotNull(), F.col("b")).alias("na"), F.col("c").alias("nb"),
        F.when(F.col("c").isNull(), F.col("a")).otherwise(F.col("b")).alias("la"), F.coalesce("c", "b").alias("lb")))
    while not cur.filter("na is not null").isEmpty():
        t = cur.select(F.col("a").alias("na"), F.col("b").alias("nb"), F.col("na").alias("na2"), F.col("nb").alias("nb2"), F.col("rank").alias("r2"),
                       F.col("la").alias("la2"), F.col("lb").alias("lb2"))
        nxt = cur.join(t, ["na", "nb"], "left").select(
            "a", "b", (F.col("rank") + F.coalesce("r2", F.lit(0))).alias("rank"), F.col("na2").alias("na"), F.col("nb2").alias("nb"),
            F.coalesce("la2", "la").alias("la"), F.coalesce("lb2", "lb").alias("lb"))
        past, cur = cur, materialize(nxt)
        release(past)
    return out.union(cur.select("a", "b", "rank", "la", "lb"))


def _loop_ends(loops: DataFrame, sizes: DataFrame, bound: int = WHOLE) -> DataFrame:
    """Ends of closed loops by a double sweep: farthest from the first voxel, then farthest from that.

    Every link is taken in both directions as a dart; a dart's successor is the dart that goes on. Cut
    at the first voxel, ranks are the two ways round. Ties go to the smaller voxel id.
    """
    d = loops.select("frag", F.col("vid").alias("a"), F.explode("nb").alias("b"))
    nbs = loops.select(F.col("vid").alias("b"), F.col("nb").alias("tnb"))
    d = d.join(nbs, "b")
    onward = F.when(F.col("b") == F.col("frag"), F.lit(None)).otherwise(
        F.when(F.element_at("tnb", 1) == F.col("a"), F.element_at("tnb", 2)).otherwise(F.element_at("tnb", 1)))
    darts = materialize(d.select("frag", "a", "b", onward.alias("c")))
    last = F.struct("la", "lb").alias("last")
    ranked = darts.join(list_rank(darts, sizes, bound), ["a", "b"]).select("frag", F.col("a").alias("vid"), (F.col("rank") + 1).alias("k"), last)
    ranked = materialize(ranked)
    # one direction per loop: the one that comes home over the smaller last dart
    way = ranked.groupBy("frag").agg(F.min("last").alias("last"))
    pos = ranked.join(way, ["frag", "last"]).join(sizes.withColumnRenamed("length", "n"), "frag").select(
        "frag", "vid", "n", F.when(F.col("vid") == F.col("frag"), F.lit(0)).otherwise(F.col("k")).alias("k"))
    ring = lambda a: F.least(a, F.col("n") - a)
    p1 = pos.groupBy("frag").agg(F.max(F.struct(ring(F.col("k")), -F.col("vid"), F.col("k").alias("k"))).alias("s")).select(
        "frag", (-F.col("s.col2")).alias("head"), F.col("s.k").alias("k1"))
    pos = pos.join(p1, "frag")
    p2 = pos.groupBy("frag", "head").agg(F.max(F.struct(ring(F.abs(F.col("k") - F.col("k1"))), -F.col("vid"))).alias("s"))
    return p2.select("frag", "head", (-F.col("s.col2")).alias("tail"))


def fragment_ends(fv: DataFrame, bound: int = WHOLE) -> DataFrame:
    """frag, length, head, tail (voxel ids).

    A piece is a path (its two ends), a single voxel (both ends the same) or a closed loop.
    """
    li = materialize(links(fv))
    ends = li.groupBy("frag").agg(
        F.count(F.lit(1)).cast("int").alias("length"),
        F.min(F.when(F.size("nb") <= 1, F.col("vid"))).alias("head"),
        F.max(F.when(F.size("nb") <= 1, F.col("vid"))).alias("tail"))
    ends = materialize(ends)
    closed = ends.filter("head is null").select("frag", "length")
    if closed.isEmpty():
        return ends
    loop = _loop_ends(li.join(closed.select("frag"), "frag", "left_semi"), closed, bound)
    return ends.filter("head is not null").union(closed.join(loop, "frag").select("frag", "length", "head", "tail"))


def path_positions(fv: DataFrame, ends: DataFrame, bound: int = WHOLE) -> DataFrame:
    """frag, vid, seq: position of every voxel along its piece, counted from the head (loops: one way round)."""
    li = materialize(links(fv).join(ends.select("frag", "head"), "frag"))
    # walk towards the tail: a dart leaves each voxel by the neighbour that is not the one it came from
    d = li.select("frag", "head", F.col("vid").alias("a"), F.explode("nb").alias("b"))
    t = li.select(F.col("vid").alias("b"), F.col("nb").alias("tnb"))
    onward = F.when(
        F.size("tnb") < 2, F.lit(None)).when(F.element_at("tnb", 1) == F.col("a"), F.get("tnb", F.lit(1))).otherwise(F.element_at("tnb", 1))
    onward = F.when(F.col("b") == F.col("head"), F.lit(None)).otherwise(onward)
    darts = materialize(d.join(t, "b").select("frag", "a", "b", "head", onward.alias("c")))
    r = darts.join(list_rank(darts, ends.select("frag", "length"), bound), ["a", "b"]).filter((F.col("lb") == F.col("head")) & (F.col("a") != F.col("head")))
    last = F.struct("la", "lb")
    way = r.groupBy("frag", F.col("a").alias("vid")).agg(F.min_by(F.col("rank") + 1, last).alias("seq"))
    heads = ends.select("frag", F.col("head").alias("vid"), F.lit(0).cast("long").alias("seq"))
    return way.union(heads)


def end_table(ends: DataFrame) -> DataFrame:
    """One row per fragment end: frag, end (0 head, 1 tail), n, vid, z, y, x."""
    e = ends.select("frag", F.col("length").alias("n"), F.posexplode(F.array("head", "tail")).alias("end", "vid"))
    return e.select("frag", "end", "n", "vid", *zyx("vid"))


def anchors(fv: DataFrame, ends: DataFrame) -> DataFrame:
    """Per fragment end, the sixth nearest voxel of its own fragment (the last one if shorter).

    Only voxels within five path steps can be among the six, so the search is a box join and never
    ranks a whole fragment.
    """
    e = end_table(ends).select(F.col("frag").alias("frag"), "end", "n", *[F.col(c).alias(f"e{c}") for c in ("vid", "z", "y", "x")])
    pairs = near_join(e, fv.select("frag", "vid", "z", "y", "x"), 8, ("ez", "ey", "ex"), ("z", "y", "x"), ["frag"], size=NEAR)
    d2 = sum(((F.col(c) - F.col(f"e{c}")) * (F.col(c) - F.col(f"e{c}")) for c in ("z", "y", "x")), F.lit(0))
    w = Window.partitionBy("frag", "end").orderBy("d2", "vid")
    r = pairs.withColumn("d2", d2).filter(F.col("d2") <= ANCHOR_REACH2).withColumn("r", F.row_number().over(w))
    r = r.filter(F.col("r") == F.least(F.lit(ANCHOR_RANK), F.col("n")))
    return r.select("frag", "end", "n", "evid", "ez", "ey", "ex", F.col("vid").alias("avid"),
                    F.col("z").alias("az"), F.col("y").alias("ay"), F.col("x").alias("ax"))


TENSOR = [("zz", "z", "z"), ("zy", "z", "y"), ("zx", "z", "x"), ("yy", "y", "y"), ("yx", "y", "x"), ("xx", "x", "x")]


def nematic_tensor(anch: DataFrame, field: DataFrame, window: int = WINDOW) -> DataFrame:
    """Second-moment sums of unit directions in a cube around each anchor, in fixed point."""
    f = field.select("z", "y", "x", "oz", "oy", "ox")
    pairs = near_join(anch, f, window, ("az", "ay", "ax"), ("z", "y", "x"), size=4 * window + 2)   # half the copies that the smallest cells take
    u = unit(vec("o"))
    pairs = pairs.withColumns({"uz": u[0], "uy": u[1], "ux": u[2]})
    keys = anch.columns
    t = pairs.groupBy("frag", "end").agg(*[F.sum(fixed(F.col(f"u{a}") * F.col(f"u{b}"))).alias(f"t{n}") for n, a, b in TENSOR])
    return anch.join(t, ["frag", "end"], "left").fillna(0, [f"t{n}" for n, _, _ in TENSOR]).select(*keys, *[f"t{n}" for n, _, _ in TENSOR])


def _across(m: list[list[Column]]) -> tuple[list[Column], Column]:
    """The longest cross product of two rows of a 3x3 matrix (ties: earlier rows), and its squared length."""
    crosses = [cross(m[i], m[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    sizes = [dot(c, c) for c in crosses]
    first = (sizes[0] >= sizes[1]) & (sizes[0] >= sizes[2])
    second = sizes[1] >= sizes[2]
    return [F.when(first, x).when(second, y).otherwise(z) for x, y, z in zip(*crosses)], F.greatest(*sizes)


def principal_direction(df: DataFrame, out: str = "e") -> DataFrame:
    """Adds the unit eigenvector ez, ey, ex of the largest eigenvalue of the tensor columns, in closed form.

    The eigenvalue comes from the trigonometric solution and is refined once by its Rayleigh quotient; the
    vector is at right angles to the rows of the shifted matrix. Where the largest eigenvalue is double the
    vector is taken from its plane; an isotropic tensor gives the first axis. The first component that is
    not zero is positive.
    """
    keep = df.columns
    k = [[f"t{''.join(sorted(i + j, key='zyx'.index))}" for j in "zyx"] for i in "zyx"]
    t = df.withColumns({f"_{n}": F.col(f"t{n}") / F.lit(1e9) for n, _, _ in TENSOR})
    m = [[F.col("_" + n[1:]) for n in row] for row in k]
    t = t.withColumn("_q", (m[0][0] + m[1][1] + m[2][2]) / 3.0)
    d = [m[i][i] - F.col("_q") for i in range(3)]
    t = t.withColumn("_p2", d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2.0 * (m[0][1] * m[0][1] + m[0][2] * m[0][2] + m[1][2] * m[1][2]))
    t = t.withColumn("_p", F.sqrt(F.col("_p2") / 6.0))
    det = (d[0] * (d[1] * d[2] - m[1][2] * m[1][2]) - m[0][1] * (m[0][1] * d[2] - m[1][2] * m[0][2]) + m[0][2] * (m[0][1] * m[1][2] - d[1] * m[0][2]))
    r = F.least(F.greatest(det / (2.0 * F.col("_p") * F.col("_p") * F.col("_p")), F.lit(-1.0)), F.lit(1.0))
    t = t.withColumn("_l", F.when(F.col("_p") > 1e-9, F.col("_q") + 2.0 * F.col("_p") * F.cos(F.acos(F.when(F.col("_p") > 1e-9, r).otherwise(0.0)) / 3.0)).otherwise(F.col("_q")))
    for last in (False, True):
        shifted = [[m[i][j] - F.col("_l") if i == j else m[i][j] for j in range(3)] for i in range(3)]
        v, size = _across(shifted)
        t = t.withColumns({"_v0": v[0], "_v1": v[1], "_v2": v[2], "_s": size})
        good = F.col("_s") > 1e-12 * F.col("_p2") * F.col("_p2")
        n = F.sqrt(F.when(good, F.col("_s")).otherwise(1.0))
        w = [F.col(f"_v{i}") / n for i in range(3)]
        if not last:
            t = t.withColumn("_l", F.when(good, dot(w, [dot(row, w) for row in m])).otherwise(F.col("_l")))
    rows = [dot(row, row) for row in shifted]
    big = lambda c: F.when((rows[0] >= rows[1]) & (rows[0] >= rows[2]), shifted[0][c]).when(rows[1] >= rows[2], shifted[1][c]).otherwise(shifted[2][c])
    pn = F.sqrt(big(0) * big(0) + big(1) * big(1))
    flat = pn <= 1e-6 * F.col("_p")
    plane = [F.when(flat, 1.0).otherwise(big(1) / safe(pn, 1e-300)), F.when(flat, 0.0).otherwise(-big(0) / safe(pn, 1e-300)), F.lit(0.0)]
    e = [F.when(good, x).otherwise(y) for x, y in zip(w, plane)]
    t = t.withColumns({"_e0": e[0], "_e1": e[1], "_e2": e[2]})
    e = [F.col(f"_e{i}") for i in range(3)]
    lead = F.when(F.abs(e[0]) > 1e-7, e[0]).when(F.abs(e[1]) > 1e-7, e[1]).otherwise(e[2])
    return t.select(*keep, *[(x * F.when(lead < 0, -1.0).otherwise(1.0)).alias(f"{out}{c}u") for x, c in zip(e, "zyx")])


def end_directions(fv: DataFrame, ends: DataFrame, field: DataFrame) -> DataFrame:
    """frag, end, vid, z, y, x, outward direction o*, tangent t* of every fragment end."""
    t = nematic_tensor(anchors(fv, ends), field)
    t = principal_direction(t)
    vout = [(F.col(f"e{c}") - F.col(f"a{c}")).cast("double") for c in "zyx"]
    e = [F.col("ezu"), F.col("eyu"), F.col("exu")]
    nn = norm(vout)
    o = flip_if((nn > 1e-4) & (dot(e, vout) < 0), e)
    t = t.select("frag", "end", F.col("evid").alias("vid"), F.col("ez").alias("z"), F.col("ey").alias("y"), F.col("ex").alias("x"),
                 *[a.alias(f"o{c}") for a, c in zip(o, "zyx")],
                 *[F.when(nn > 1e-4, a / safe(nn)).otherwise(b).alias(f"t{c}") for a, b, c in zip(vout, o, "zyx")])
    return t
