"""Smoothing splines along curves of any length.

A curve is fitted in windows of its arc length with a halo on either side, so a task holds a window, never a curve, and
memory is linear in the points. The fit is a penalised cubic B-spline: normal equations and penalty have four diagonals, solved by
a banded Cholesky factorisation; the penalty is as strong as the allowed residual permits. A change far away decays along a spline
within a few knots, so windows with a halo agree where they meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.curves import AX, arc_length, in_runs
from strandlake.operators.lookup import salted_lookup
from strandlake.session import materialize

SPAN = 1024.0         # arc length of a window
HALO = 64.0
KNOT = 4.0            # distance of knots; halved where the residual asks for it
PIN_WEIGHT = 500.0    # of ends and pinned points
RESIDUAL = 0.25       # allowed weighted square distance, per point


def basis(u: np.ndarray, low: float, step: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First of four coefficients that each place takes part in, and their weights (uniform cubic B-spline)."""
    at = (u - low) / step
    k = np.clip(np.floor(at).astype(np.int64), 0, n - 4)
    t = at - k
    s = 1 - t
    return k, np.stack([s ** 3, 3 * t ** 3 - 6 * t ** 2 + 4, 3 * s ** 3 - 6 * s ** 2 + 4, t ** 3], 1) / 6


def banded_solve(bands: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solve A x = rhs, A symmetric and positive; bands[d][i] = A[i, i + d]. Cholesky within the band: linear in the size."""
    width, n = bands.shape
    low = bands.copy()   # low[d][i] = L[i + d, i]
    for i in range(n):
        low[0, i] = np.sqrt(low[0, i])
        reach = min(width - 1, n - 1 - i)
        col = low[1:reach + 1, i] / low[0, i]
        low[1:reach + 1, i] = col
        for d in range(1, reach + 1):
            low[0:reach + 1 - d, i + d] -= col[d - 1] * col[d - 1:]
    x = rhs.copy()
    for i in range(n):
        reach = min(width - 1, n - 1 - i)
        x[i] /= low[0, i]
        x[i + 1:i + 1 + reach] -= low[1:reach + 1, i, None] * x[i]
    for i in range(n - 1, -1, -1):
        reach = min(width - 1, n - 1 - i)
        x[i] = (x[i] - low[1:reach + 1, i] @ x[i + 1:i + 1 + reach]) / low[0, i]
    return x


def fitted(u: np.ndarray, p: np.ndarray, w: np.ndarray, target: float, knot: float = KNOT):
    """A function of the arc: the smoothest spline whose weighted square residual is at most ``target``."""
    low, high = float(u[0]), float(u[-1])
    finest = max((high - low) / max(len(u), 1) / 2, 1e-9)
    while True:
        n = max(1, int(np.ceil((high - low) / knot))) + 3
        step = (high - low) / (n - 3)
        k, b = basis(u, low, step, n)
        normal, rhs = np.zeros((4, n)), np.zeros((n, p.shape[1]))
        for i in range(4):
            np.add.at(rhs, k + i, (w * w * b[:, i])[:, None] * p)
            for j in range(i, 4):
                np.add.at(normal[j - i], k + i, w * w * b[:, i] * b[:, j])
        penalty = np.zeros((4, n))   # squared second differences
        for i, a in enumerate((1.0, -2.0, 1.0)):
            for j, c in enumerate((1.0, -2.0, 1.0)):
                if j >= i:
                    penalty[j - i, i:n - 2 + i] += a * c
        # what no point touches keeps the smallest penalty, so the system stays positive
        solve = lambda power: banded_solve(normal + 10.0 ** power * penalty + np.array([[1e-12], [0], [0], [0]]), rhs)
        residual = lambda c: float((((b[:, :, None] * c[k[:, None] + np.arange(4)]).sum(1) - p) ** 2 * (w * w)[:, None]).sum())
        weak, strong = -6.0, 9.0
        coef = solve(weak)
        if residual(coef) <= target or knot <= finest:
            break
        knot /= 2
    if residual(coef) <= target:
        best = solve(strong)
        if residual(best) <= target:
            coef = best
        else:
            for _ in range(30):
                mid = (weak + strong) / 2
                best = solve(mid)
                if residual(best) <= target:
                    weak, coef = mid, best
                else:
                    strong = mid

    def at(v: np.ndarray) -> np.ndarray:
        kk, bb = basis(v, low, step, n)
        return (bb[:, :, None] * coef[kk[:, None] + np.arange(4)]).sum(1)
    return at


def _window(seq: np.ndarray, p: np.ndarray, u: np.ndarray, pin: np.ndarray, total: float, size: int, w0: int) -> tuple[np.ndarray, np.ndarray]:
    """(seq, place) of the outputs that one window owns."""
    if size < 4 or total <= 0:   # too short for a spline: as it is
        out = p
    else:
        m = max(3, int(np.floor(total + 0.5)))
        first = max(0, int(np.floor((w0 * SPAN - HALO) / total * (m - 1))))
        last = min(m - 1, int(np.ceil(((w0 + 1) * SPAN + HALO) / total * (m - 1))))
        seq = np.arange(first, last + 1)
        v = seq * (total / (m - 1))
        inside = (v >= u[0] - 1e-9) & (v <= u[-1] + 1e-9)
        seq, v = seq[inside], v[inside]
        once = np.append(True, np.diff(u) > 1e-4)
        keep = once | pin
        keep[np.flatnonzero(pin)] = True
        out = fitted(u[keep], p[keep], np.where(pin[keep], PIN_WEIGHT, 1.0), RESIDUAL * keep.sum())(v)
        for q, a in zip(p[pin], u[pin]):
            near = np.flatnonzero(np.abs(v - a) <= 4)
            if len(near):
                out[near[((out[near] - q) ** 2).sum(1).argmin()]] = q
        for s, at in ((0, 0), (m - 1, -1)):
            if pin[at] and len(seq) and seq[at] == s:
                out[at] = p[at]
        own = np.minimum(v, total * (1 - 1e-12)) // SPAN == w0
        seq, out = seq[own], out[own]
    return seq, out


def _windows(frame: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
    seq, p, u, pin = frame["seq"].to_numpy(), frame[list(AX)].to_numpy(float), frame["arc"].to_numpy(float), frame["held"].to_numpy(bool)
    total, size, w0 = (frame[c].to_numpy()[at] for c in ("total", "n", "_w"))
    cuts = [slice(a, b) for a, b in zip(at, np.append(at[1:], len(frame)))]
    done = [_window(seq[k], p[k], u[k], pin[k], float(total[i]), int(size[i]), int(w0[i])) for i, k in enumerate(cuts)]
    out = np.concatenate([o for _, o in done])
    return pd.DataFrame({"curve": np.repeat(frame["curve"].to_numpy()[at], [len(s) for s, _ in done]),
                         "seq": np.concatenate([s for s, _ in done]).astype(np.int64), "z": out[:, 0], "y": out[:, 1], "x": out[:, 2]})


def spline_curves(points: DataFrame) -> DataFrame:
    """(curve, seq, z, y, x): a smoothing spline through each curve, about one point per unit of arc length.

    ``points``: curve, seq, z, y, x, pin. Ends and pinned points are kept exactly. Curves of fewer than four points, or of no
    length, stay as they are.
    """
    a = materialize(arc_length(points.select("curve", "seq", "pin", *[F.col(c).cast("double").alias(c) for c in AX])))
    size = a.groupBy("curve").agg(F.max("arc").alias("total"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("s0"), F.max("seq").alias("s1"))
    a = salted_lookup(a, size, ["curve"], ["seq"], "inner")
    whole = (F.col("n") < 4) | (F.col("total") <= 0)
    top = F.floor(F.col("total") * (1 - 1e-12) / SPAN)
    low = F.greatest(F.lit(0), F.floor((F.col("arc") - HALO) / SPAN))
    high = F.least(top, F.floor((F.col("arc") + HALO) / SPAN))
    a = a.withColumn("held", F.col("pin") | (F.col("seq") == F.col("s0")) | (F.col("seq") == F.col("s1")))
    a = a.withColumn("_w", F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(low, F.greatest(low, high)))))
    ty = points.schema["curve"].dataType.simpleString()
    a = a.filter("curve is not null").select("curve", "_w", F.col("seq").cast("long").alias("seq"), *AX, "arc", "held", "total", "n")
    return in_runs(a, _windows, f"curve {ty}, seq long, z double, y double, x double", ["curve", "_w"])
