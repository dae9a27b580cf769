"""Annotation patches: distance transform, routing between seeds, curve refinement, targets.

A patch is a cube of fixed side (96 by default), so a patch is a bounded group: about 0.9 million voxels.
Only routing is sequential and runs per patch; diffusion, centring, splines and the
target fields are the joins used everywhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.vec3 import dot
from strandlake.grid import pack
from strandlake.operators.curves import AX, smooth, tangents
from strandlake.operators.chunks import classify_face
from strandlake.operators.donors import order_points
from strandlake.operators.fields import unit_hash
from strandlake.operators.morph import two_nearest_curves
from strandlake.operators.ranges import nearest
from strandlake.operators.routing import UNIT, cheapest_way, lane
from strandlake.operators.splines import spline_curves
from strandlake.session import materialize

EMPTY_COST = 8.0        # cost of a background voxel
OCCUPIED_COST = 2.0     # added where an earlier curve already runs
LANE_WEIGHT = 0.20      # cost per voxel of distance from the straight line
BOX_PAD = 16
MAX_SHIFT = 1.5


def whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[dict[str, np.ndarray]]:
    """The groups of a stream sorted by ``key``, each whole, as arrays. One group and one batch are held."""
    rest: list[dict[str, np.ndarray]] = []
    for pdf in frames:
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        ids = cols[key]
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
        for i, j in zip(cuts, cuts[1:]):
            if rest and rest[0][key][0] != ids[i]:
                yield {c: np.concatenate([r[c] for r in rest]) for c in cols}
                rest = []
            rest.append({c: v[i:j] for c, v in cols.items()})
    if rest:
        yield {c: np.concatenate([r[c] for r in rest]) for c in rest[0]}


def batched(parts: Iterator[dict[str, np.ndarray]], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """Small tables as frames of about so many rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(next(iter(part.values())))
        if n >= rows:
            yield pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in part})
            held, n = [], 0
    if held:
        yield pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in held[0]})


def per_patch(df: DataFrame) -> DataFrame:
    """Rows dealt and sorted by patch: a task streams its patches, many small ones cost no group call each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "patch").sortWithinPartitions("patch")


def edt(patches: DataFrame, size: int) -> DataFrame:
    """Exact Euclidean distance of every patch voxel to the nearest empty voxel of its patch."""

    def distances(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        f = np.zeros((size,) * 3)
        f[g["z"], g["y"], g["x"]] = np.inf
        for ax in range(3):
            f = np.moveaxis(f, ax, 0)
            out = f.copy()
            for k in range(1, size):
                np.minimum(out[k:], f[:-k] + k * k, out=out[k:])
                np.minimum(out[:-k], f[k:] + k * k, out=out[:-k])
            f = np.moveaxis(out, 0, ax)
        return {**g, "dt": np.sqrt(f[g["z"], g["y"], g["x"]])}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from batched(distances(g) for g in whole_groups(frames, "patch"))

    return per_patch(patches.select("patch", *[F.col(c).cast("int").alias(c) for c in AX])).mapInPandas(run, "patch long, z int, y int, x int, dt double")


def least_cost_path(cost: np.ndarray, a, b, first: np.ndarray | None = None) -> np.ndarray | None:
    """Voxels of the cheapest way over 26 neighbours (whole costs, negative ones are barriers); ties by the smaller previous voxel."""
    return cheapest_way(cost, tuple(a), tuple(b), first)


def route(cost: np.ndarray, a, b, first: np.ndarray | None = None) -> np.ndarray:
    """Least-cost path with a lane penalty, in a padded box around both points (else the whole patch).

    A way through the voxels ``first`` (where given) bounds the search, it does not change the path.
    """
    if tuple(a) == tuple(b):
        return np.array([a])
    for pad in (BOX_PAD, max(cost.shape)):
        lo = np.maximum(np.minimum(a, b) - pad, 0)
        hi = np.minimum(np.maximum(a, b) + pad + 1, cost.shape)
        inside = tuple(slice(p, q) for p, q in zip(lo, hi))
        box = cost[inside]
        dear = np.where(box >= 0, box + lane(lo, hi, a, b, LANE_WEIGHT), -1)
        p = least_cost_path(dear, tuple(int(v) for v in np.array(a) - lo), tuple(int(v) for v in np.array(b) - lo), None if first is None else first[inside])
        if p is not None:
            return p + lo
    return np.array([a, b])


def visiting_order(start, stops: list, end) -> list[int]:
    """Shortest order of the stops between two fixed ends (dynamic programme over subsets)."""
    d = lambda p, q: float(np.linalg.norm(np.subtract(p, q, dtype=float)))
    n = len(stops)
    state = {(1 << i, i): (d(start, stops[i]), [i]) for i in range(n)}
    for _ in range(n - 1):
        nxt = {}
        for (mask, i), (c, o) in state.items():
            for j in range(n):
                if not mask >> j & 1:
                    k, cand = (mask | 1 << j, j), (c + d(stops[i], stops[j]), o + [j])
                    if k not in nxt or cand < nxt[k]:
                        nxt[k] = cand
        state = nxt
    return min((c + d(stops[i], end), o) for (_, i), (c, o) in state.items())[1] if n else []


def _seed_sequence(pts: np.ndarray, way: np.ndarray, size: int) -> list[int]:
    """Indexes of a curve's seeds from end to end."""
    def farthest(idx):
        return max(((float(((pts[i] - pts[j]) ** 2).sum()), -i, -j) for a, i in enumerate(idx) for j in idx[a + 1:]))
    free = [i for i in range(len(pts)) if not way[i]]
    if len(free) != 2:
        edge = [i for i in free if ((pts[i] == 0) | (pts[i] == size - 1)).any()] if len(free) > 2 else []
        pool = edge if len(edge) >= 2 else list(range(len(pts)))
        _, i, j = farthest(pool)
        free = [-i, -j]
    mid = [i for i in range(len(pts)) if i not in free]
    return [free[0], *[mid[k] for k in visiting_order(pts[free[0]], [pts[m] for m in mid], pts[free[1]])], free[1]]


def route_seeds(dt: DataFrame, seeds: DataFrame, size: int) -> DataFrame:
    """(patch, fiber, seq, z, y, x, pin): coarse curve of every seeded fibre.

    ``dt``: patch, z, y, x, dt; ``seeds``: patch, fiber, ord, z, y, x, way. Fibres of one patch are routed
    in order, as each makes its voxels dearer for the next; patches are independent.
    """

    def routed(g: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        f = np.zeros((size,) * 3)
        body, seed = g["fiber"] < 0, np.flatnonzero(g["fiber"] >= 0)
        f[tuple(g[c][body] for c in AX)] = g["dt"][body]
        base = np.floor(np.where(f > 0, 1.0 / (f * f + 0.1), EMPTY_COST) * UNIT + 0.5).astype(np.int64)
        cost = base.copy()
        seed = seed[np.lexsort((g["ord"][seed], g["fiber"][seed]))]
        fibers = g["fiber"][seed]
        for own in np.split(seed, np.flatnonzero(fibers[1:] != fibers[:-1]) + 1) if len(seed) else []:
            pts = np.stack([g[c][own] for c in AX], 1).astype(int)
            if len(pts) == 1:
                path, pins = _trace(f, base, tuple(pts[0]), size), set()
            else:
                order = _seed_sequence(pts, g["way"][own].astype(bool), size)
                legs = [route(cost, tuple(pts[i]), tuple(pts[j]), f > 0) for i, j in zip(order, order[1:])]
                path = np.concatenate([legs[0], *[leg[1:] for leg in legs[1:]]])
                pins = {tuple(pts[i]) for i in order[1:-1]}
            cost[path[:, 0], path[:, 1], path[:, 2]] += int(OCCUPIED_COST * UNIT)
            n = len(path)
            yield {"patch": np.full(n, g["patch"][0]), "fiber": np.full(n, g["fiber"][own[0]]), "seq": np.arange(n), "z": path[:, 0], "y": path[:, 1], "x": path[:, 2],
                   "pin": np.array([tuple(p) in pins for p in path.tolist()], dtype=bool)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from batched(part for g in whole_groups(frames, "patch") for part in routed(g))

    at = [F.col(c).cast("int").alias(c) for c in AX]
    body = dt.select("patch", *at, F.col("dt").cast("double").alias("dt"), F.lit(-1).cast("long").alias("fiber"), F.lit(0).cast("long").alias("ord"), F.lit(False).alias("way"))
    seeds = seeds.select("patch", *at, F.lit(0.0), F.col("fiber").cast("long"), F.col("ord").cast("long"), "way")
    return per_patch(body.union(seeds)).mapInPandas(run, "patch long, fiber int, seq long, z int, y int, x int, pin boolean")


def _trace(dt: np.ndarray, cost: np.ndarray, start, size: int) -> np.ndarray:
    """From one seed to the farthest inner voxel of its component, along the distance ridge."""
    if dt[start] <= 0:
        return np.array([start])
    comp = np.zeros(dt.shape, bool)
    comp[start] = True
    front = [start]
    while front:
        nxt = []
        for p in front:
            box = tuple(slice(max(c - 1, 0), c + 2) for c in p)
            new = (dt[box] > 0) & ~comp[box]
            comp[box] |= new
            nxt += [tuple(int(v) + max(c - 1, 0) for v, c in zip(q, p)) for q in np.argwhere(new)]
        front = nxt
    c = np.argwhere(comp)
    inner = ((c > 1) & (c < size - 2)).all(1)
    c = c[inner] if inner.any() else c
    end = tuple(int(v) for v in c[((c - np.array(start)) ** 2).sum(1).argmax()])
    p = least_cost_path(np.where(comp, cost, -1), start, end)
    return p if p is not None else np.array([start])


def refine_curves(paths: DataFrame, mask: DataFrame, sigma: float = 1.2, max_radius: float = 3.5) -> DataFrame:
    """Centre coarse curves in their mask (shift of at most 1.5), smooth, fit a spline.

    ``paths``: curve, seq, z, y, x, pin; ``mask``: curve, vid, z, y, x. Ends and pinned points do not move.
    """
    c = materialize(paths.select("curve", "seq", "pin", *[F.col(a).cast("double").alias(a) for a in AX]))
    m = mask.select("curve", F.struct("curve", "vid").alias("k"), "vid", *AX)
    n = nearest(m, c.withColumn("sk", F.col("seq")), "k", "sk", on=["curve"], max_radius=max_radius)
    g = n.select(F.col("k.curve").alias("curve"), F.col("k.vid").alias("vid"), F.col("sk").alias("seq")).join(
        mask.select("curve", "vid", *AX), ["curve", "vid"]).groupBy("curve", "seq").agg(F.count(F.lit(1)).alias("k"), *[F.avg(a).alias(f"m{a}") for a in AX])
    ends = c.groupBy("curve").agg(F.max("seq").alias("last"))
    j = c.join(g, ["curve", "seq"], "left").join(ends, "curve")
    d = [F.col(f"m{a}") - F.col(a) for a in AX]
    ln = F.sqrt(dot(d, d))
    fac = F.when(ln > MAX_SHIFT, F.lit(MAX_SHIFT) / F.greatest(ln, F.lit(1e-9))).otherwise(1.0)
    free = (F.coalesce("k", F.lit(0)) >= 3) & ~F.col("pin") & (F.col("seq") > 0) & (F.col("seq") < F.col("last"))
    moved = materialize(j.select("curve", "seq", "pin", "last", *[F.when(free, F.col(a) + v * fac).otherwise(F.col(a)).alias(a) for a, v in zip(AX, d)]))
    s = smooth(moved, sigma, "nearest").select("curve", "seq", *[F.col(a).alias(f"s{a}") for a in AX])
    held = F.col("pin") | (F.col("seq") == 0) | (F.col("seq") == F.col("last"))
    s = moved.join(s, ["curve", "seq"]).select("curve", "seq", "pin", *[F.when(held, F.col(a)).otherwise(F.col(f"s{a}")).alias(a) for a in AX])
    return spline_curves(s)


def target_fields(body: DataFrame, curves: DataFrame) -> DataFrame:
    """(vid, intensity, o*): fall-off from the nearest curve, crossing valleys, own curve's tangent.

    ``body``: vid, z, y, x, label; ``curves``: curve (= label), seq, z, y, x.
    """
    n = nearest(body, curves.withColumn("sk", F.struct("curve", "seq")), "vid", "sk").select("vid", F.col("d2").alias("q"))
    two = two_nearest_curves(body, curves, 3.0)
    gx = F.exp(-(F.col("d1") * F.col("d1") + F.col("d2") * F.col("d2")) / 4.5)
    i = F.least(F.greatest(F.exp(-F.col("q") / 2.0) - F.coalesce(1.5 * gx, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    t = tangents(curves).withColumn("label", F.col("curve"))
    o = nearest(body, t.withColumn("sk", F.col("seq")), "vid", "sk", on=["label"], carry=["tz", "ty", "tx"])
    return n.join(two, "vid", "left").select("vid", i.alias("intensity")).join(
        o.select("vid", F.col("tz").alias("oz"), F.col("ty").alias("oy"), F.col("tx").alias("ox")), "vid", "left").fillna(0.0)


def seeds_from_labels(skel: DataFrame, size: int, min_voxels: int = 8) -> DataFrame:
    """Seeds of every labelled curve: both ends and one or two waypoints (patch, label, ord, z, y, x, way, face).

    ``skel``: label, z, y, x of the thinned label volume, label unique per patch.
    """
    o = order_points(skel, "seed")
    n = o.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_voxels)
    j = o.join(n, "label")
    third, half = F.floor(F.col("n") / 3), F.floor(F.col("n") / 2)
    way = F.when(F.col("n") >= 12, (F.col("seq") == third) | (F.col("seq") == 2 * third)).otherwise((F.col("n") > 2) & (F.col("seq") == half))
    end = (F.col("seq") == 0) | (F.col("seq") == F.col("n") - 1)
    return j.filter(end | way).select("label", F.col("seq").alias("ord"), *AX, (~end).alias("way"),
                                      classify_face(F.col("z"), F.col("y"), F.col("x"), size).alias("face"))


def sample_rows(shell: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """About that fraction of the voxels, chosen by a hash of their ids: no sort, the same voxels in every run."""
    return shell.filter(unit_hash(seed, F.col("vid")) < fraction)


def sample_windows(spark, n: int, shape, size: int, fg: DataFrame, seed: int, fg_prob: float = 0.85, jitter: int = 2) -> DataFrame:
    """Origins of n training windows: around a random foreground voxel with ``fg_prob``, else anywhere."""
    d = spark.range(n).withColumnRenamed("id", "sample")
    total = fg.count()
    u = lambda k: unit_hash(seed + k, F.col("sample"))
    from strandlake.operators.ranks import global_rank

    r = global_rank(fg.select("vid", *AX), [F.col("vid")], "rank")
    d = d.withColumn("rank", F.when((u(0) < fg_prob) & F.lit(total > 0), F.floor(u(1) * total) + 1))
    d = d.join(r, "rank", "left")
    cols = []
    for i, (c, m) in enumerate(zip(AX, shape)):
        hi = max(m - size, 0)
        near = F.col(c) - size // 2 + F.floor(u(10 + i) * (2 * jitter + 1)) - jitter
        o = F.when(F.col(c).isNotNull(), near).otherwise(F.floor(u(20 + i) * (hi + 1)))
        cols.append(F.least(F.greatest(o, F.lit(0)), F.lit(hi)).cast("int").alias(f"{c}0"))
    return d.select("sample", *cols)
