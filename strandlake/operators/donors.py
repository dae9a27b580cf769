"""Donor curves: extraction of single labels, validity of through curves, point ordering, library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.grid import pack
from strandlake.operators.chunks import FACES
from strandlake.operators.curves import AX, arc_length, curve_lengths, smooth, tangents
from strandlake.operators.lookup import salted_lookup
from strandlake.operators.ranges import nearest



def masked_crops(labels: DataFrame, padding: int = 2) -> DataFrame:
    """Each label's voxels in the coordinates of its own padded box (clamped at the volume's origin)."""
    box = labels.groupBy("label").agg(*[F.greatest(F.min(c) - padding, F.lit(0)).alias(f"{c}0") for c in AX])
    j = salted_lookup(labels, box, ["label"], ["vid"], "inner")
    rest = [c for c in labels.columns if c not in ("vid", "label", *AX)]
    return j.select("label", *[(F.col(c) - F.col(f"{c}0")).cast("int").alias(c) for c in AX], *rest)


def through_curves(curves: DataFrame, size: int, min_length: float = 75.0, margin: float = 3.5) -> DataFrame:
    """Per curve: n, length, entry and exit face, and whether it is an intact through curve.

    Intact: at least 15 points and ``min_length``; no face that three interior points run along
    (within ``margin``, |t| < 0.35); both ends within 2.5 of different faces and crossing them (|t| >= 0.20).
    """
    t = arc_length(tangents(curves))
    t = salted_lookup(t, curve_lengths(curves), ["curve"], ["seq"], "inner")
    far = lambda c, hi: F.abs(F.col(c) - F.lit(float(size - 1 if hi else 0)))
    k = F.greatest(F.lit(3), F.floor(F.col("n") * 0.06))
    inner = (F.col("seq") >= k) & (F.col("seq") < F.col("n") - k)
    face = F.least(*[F.struct(far(c, hi).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("f"), F.abs(F.col(f"t{c}")).alias("t"))
                     for i, (name, c, hi) in enumerate(FACES)])
    t = t.withColumn("face", face)
    ok = F.when((F.col("face.d") <= 2.5) & (F.col("face.t") >= 0.20), F.col("face.f"))
    g = t.groupBy("curve").agg(
        F.max("n").alias("n"), F.max("arc").alias("length"),
        F.max(F.when(F.col("seq") == 0, ok)).alias("entry_face"), F.max(F.when(F.col("seq") == F.col("n") - 1, ok)).alias("exit_face"),
        F.greatest(*[F.count_if(inner & (far(c, hi) <= margin) & (F.abs(F.col(f"t{c}")) < 0.35)) for _, c, hi in FACES]).alias("along"))
    valid = ((F.col("n") >= 15) & (F.col("length") >= min_length) & (F.col("along") < 3) & F.col("entry_face").isNotNull()
             & F.col("exit_face").isNotNull() & (F.col("entry_face") != F.col("exit_face")))
    return g.select("curve", "n", F.round("length", 5).alias("length"), "entry_face", "exit_face", F.coalesce(valid, F.lit(False)).alias("valid"))


class _Grid:
    """Points in cells, for the nearest one that is left. Points are taken out as they are visited."""

    def __init__(self, p: np.ndarray, side: int):
        self.p, self.side = p, side
        self.left = np.ones(len(p), bool)
        self.cells: dict[tuple, list[int]] = {}
        for i, c in enumerate(map(tuple, (p // side).tolist())):
            self.cells.setdefault(c, []).append(i)
        self.rest, self.gone = np.arange(len(p)), 0

    def take(self, i: int) -> None:
        self.left[i] = False
        self.cells[tuple((self.p[i] // self.side).tolist())].remove(i)
        self.gone += 1
        if 2 * self.gone > len(self.rest):   # what a wide search looks through shrinks with what is left
            self.rest, self.gone = self.rest[self.left[self.rest]], 0

    def nearest(self, i: int) -> tuple[int, int] | None:
        """(square distance, point) of the nearest point left, ties to the lower one: around it first, all others only if nothing is near."""
        z, y, x = (self.p[i] // self.side).tolist()
        near = [j for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) for j in self.cells.get((z + a, y + b, x + c), ())]
        if near:
            d = ((self.p[near] - self.p[i]) ** 2).sum(1)
            best = min(zip(d.tolist(), near, strict=True))
            if best[0] <= self.side * self.side:   # nothing outside these cells is closer
                return best
        rest = self.rest[self.left[self.rest]]
        if not len(rest):
            return None
        d = ((self.p[rest] - self.p[i]) ** 2).sum(1)
        return int(d.min()), int(rest[d.argmin()])


def _greedy_order(p: np.ndarray, start: int, jump: float | None) -> tuple[list[int], int]:
    """Nearest unvisited point next (ties: lower index), and how many points come before the first jump that is too long."""
    grid = _Grid(p, int(np.ceil(jump)) if jump else 4)
    order, whole, cur = [], None, start
    while True:
        order.append(cur)
        grid.take(cur)
        step = grid.nearest(cur)
        if step is None:
            return order, whole or len(order)
        if whole is None and jump is not None and step[0] > jump * jump:
            whole = len(order)
        cur = step[1]


# start point and longest admissible jump of the three ordering rules
ORDER_RULES = {"export": ("far", 8.0), "donor": ("axis", None), "seed": ("far", 4.5)}


def order_points(points: DataFrame, rule: str = "export", beyond: bool = False) -> DataFrame:
    """(label, seq, z, y, x): points of every label ordered along its curve, by one of three rules.

    The rule is greedy and sequential within a label; a cell grid makes a step cost what lies near it, not the whole label. Points
    past the first jump that is too long are no part of the curve: they are left out, or, with ``beyond``, go on in order with that column true.
    """
    how, jump = ORDER_RULES[rule]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "y", "x"])
        p = pdf[["z", "y", "x"]].to_numpy(np.int64)
        if len(p) < 3:
            order, whole = list(range(len(p))), len(p)
        else:
            if how == "far":
                c = p - p.min(0)
                c = c * len(p) - c.sum(0)
                c = c if np.abs(c).max() < 1 << 30 else c.astype(float)   # whole numbers while they fit: ties are ties
                start = int((c ** 2).sum(1).argmax())
            else:
                c = p - p.mean(0)
                axis = np.linalg.svd(c, full_matrices=False)[2][0]
                axis = axis if axis[np.abs(axis).argmax()] > 0 else -axis
                start = int((c @ axis).argmin())
            order, whole = _greedy_order(p, start, jump)
        out = pdf.iloc[order][["label", "z", "y", "x"]].copy()
        out.insert(1, "seq", np.arange(len(out)))
        out["beyond"] = np.arange(len(out)) >= whole
        return out if beyond else out[~out["beyond"]].drop(columns="beyond")

    ty = points.schema["label"].dataType.simpleString()
    shape = f"label {ty}, seq long, z int, y int, x int" + (", beyond boolean" if beyond else "")
    return points.select("label", *AX).groupBy("label").applyInPandas(run, shape)


def centre_curves(curves: DataFrame, mask: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Move curve points to the centroid of the mask voxels nearest to them (three or more), then smooth.

    ``curves``: curve, seq, z, y, x; ``mask``: curve, vid, z, y, x (each curve has its own mask).
    """
    c = curves.select("curve", "seq", *[F.col(a).cast("double").alias(a) for a in AX])
    m = mask.select("curve", F.struct("curve", "vid").alias("k"), *AX)
    near = nearest(m, c.withColumn("sk", F.col("seq")), "k", "sk", on=["curve"])
    n = near.select(F.col("k.curve").alias("curve"), F.col("k.vid").alias("vid"), F.col("sk").alias("seq"))
    g = n.join(mask.select("curve", "vid", *AX), ["curve", "vid"]).groupBy("curve", "seq").agg(
        F.count(F.lit(1)).alias("k"), *[F.avg(a).alias(f"m{a}") for a in AX])
    j = c.join(g, ["curve", "seq"], "left")
    moved = j.select("curve", "seq", *[F.when(F.coalesce("k", F.lit(0)) >= 3, F.col(f"m{a}")).otherwise(F.col(a)).alias(a) for a in AX])
    return smooth(moved, sigma, "reflect")


def build_library(labels: DataFrame, skel: DataFrame, size: int = 96, min_length: float = 75.0, padding: int = 4) -> dict[str, DataFrame]:
    """Donor library from labelled patches: {'curves', 'mask', 'donors'}.

    ``labels`` and ``skel``: label (unique per patch and curve), vid, z, y, x. Curves are ordered,
    validated, centred in their mask and kept in the coordinates of their own padded box.
    """
    ordered = order_points(skel, "donor").withColumnRenamed("label", "curve")
    donors = through_curves(ordered, size, min_length)
    box = labels.groupBy("label").agg(*[F.greatest(F.min(c) - padding, F.lit(0)).alias(f"{c}0") for c in AX]).withColumnRenamed("label", "curve")
    m = salted_lookup(labels.withColumnRenamed("label", "curve"), box, ["curve"], ["vid"], "inner")
    m = m.select("curve", *[(F.col(c) - F.col(f"{c}0")).cast("int").alias(c) for c in AX])
    m = m.withColumn("vid", pack(*AX))
    o = ordered.join(box, "curve").select("curve", "seq", *[(F.col(c) - F.col(f"{c}0")).alias(c) for c in AX])
    return {"donors": donors, "mask": m, "curves": centre_curves(o, m)}
