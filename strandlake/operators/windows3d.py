"""Sliding spatial windows with weighted overlap-add, for any predictor of dense cubes."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.grid import pack


def padded(n: int, size: int, stride: int) -> int:
    pad = (stride - (n - size) % stride) % stride if n >= size else size - n
    return n + pad


def reflect_pad(vox: DataFrame, shape, size: int, stride: int) -> DataFrame:
    """Adds mirrored rows (edge not repeated) beyond the upper faces, up to whole strides."""
    out = vox
    for c, n in zip("zyx", shape):
        extra = padded(n, size, stride) - n
        if extra == 0:
            continue
        period = max(2 * (n - 1), 1)
        # every stored coordinate may have several images when the pad exceeds the volume
        imgs = [F.col(c)]
        for k in range(0, extra // period + 2):
            imgs += [F.col(c) + (k + 1) * period, F.lit((k + 1) * period) - F.col(c)]
        arr = F.array_distinct(F.array(*imgs))
        arr = F.filter(arr, lambda v: (v >= n) & (v < n + extra))
        out = out.withColumn(c, F.explode(F.concat(F.array(F.col(c)), arr)))
    return out


def window_index(c: Column, n_windows: int, size: int, stride: int) -> Column:
    """Indexes of the windows along one axis that hold a coordinate."""
    lo = F.greatest(F.floor((c - size) / F.lit(stride)) + 1, F.lit(0))
    hi = F.least(F.floor(c / F.lit(stride)), F.lit(n_windows - 1))
    return F.sequence(lo, hi)


def to_windows(vox: DataFrame, shape, size: int, stride: int) -> DataFrame:
    """One row per (voxel, covering window): wz, wy, wx are window indexes. Input must be padded."""
    out = vox
    for c, n in zip("zyx", shape):
        k = (padded(n, size, stride) - size) // stride + 1
        out = out.withColumn(f"w{c}", F.explode(window_index(F.col(c), k, size, stride)))
    return out


def window_weight(size: int, stride: int) -> Column:
    """Gaussian of width size/4 around the window centre, 1 at its maximum."""
    sigma = size / 4.0
    r2 = F.lit(0.0)
    for c in "zyx":
        d = F.col(c) - F.col(f"w{c}") * stride - (size / 2.0 - 0.5)
        r2 = r2 + d * d
    top = 3 * (0.5 if size % 2 == 0 else 0.0) ** 2
    return F.exp((F.lit(top) - r2) / F.lit(2.0 * sigma * sigma))


def blend(preds: DataFrame, shape, size: int, stride: int, values: list[str]) -> DataFrame:
    """Sum of weight * prediction over sum of weights per voxel; the padding is cut off."""
    w = preds.filter((F.col("z") < shape[0]) & (F.col("y") < shape[1]) & (F.col("x") < shape[2]))
    w = w.withColumn("_w", window_weight(size, stride))
    fx = lambda c: F.sum(F.bround(c * 1e12).cast("long")) / F.lit(1e12)
    g = w.groupBy("z", "y", "x").agg(fx(F.col("_w")).alias("_sw"), *[fx(F.col("_w") * F.col(v)).alias(v) for v in values])
    return g.select(pack("z", "y", "x").alias("vid"), "z", "y", "x",
                    *[(F.col(v) / F.greatest(F.col("_sw"), F.lit(1e-6))).alias(v) for v in values])


def sliding_predict(vox: DataFrame, shape, predict: Callable[[np.ndarray], np.ndarray], value: str = "vol", size: int = 64,
                    stride: int = 32, channels: int = 1, empty: bool = True) -> DataFrame:
    """Run ``predict`` on every window of a sparse volume and blend the results.

    ``predict`` maps a (size, size, size) float array to (channels, size, size, size). A window is one
    group of at most size^3 voxels. ``empty`` also runs windows without any voxel.
    Output: vid, z, y, x, c0.. of every stored voxel, and of others where a prediction is not zero.
    """
    nw = [(padded(n, size, stride) - size) // stride + 1 for n in shape]
    p = reflect_pad(vox.select("z", "y", "x", F.col(value).cast("double").alias("v")), shape, size, stride)
    w = to_windows(p, shape, size, stride).select("wz", "wy", "wx", "z", "y", "x", "v")
    if empty:
        # by arithmetic on one id range, so that it needs no product of tables
        g = vox.sparkSession.range(nw[0] * nw[1] * nw[2])
        none = F.lit(None)
        w = w.union(g.select(F.floor(F.col("id") / (nw[1] * nw[2])), F.floor(F.col("id") / nw[2]) % nw[1], F.col("id") % nw[2],
                             none.cast("int"), none.cast("int"), none.cast("int"), none.cast("double")))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        oz, oy, ox = (int(k) * stride for k in key)
        pdf = pdf.dropna()
        a = np.zeros((size,) * 3)
        stored = pdf["z"].to_numpy(int) - oz, pdf["y"].to_numpy(int) - oy, pdf["x"].to_numpy(int) - ox
        a[stored] = pdf["v"].to_numpy()
        out = np.asarray(predict(a)).reshape(channels, size, size, size)
        keep = (out != 0).any(axis=0)
        keep[stored] = True
        z, y, x = np.nonzero(keep)
        res = {"wz": np.full(len(z), key[0]), "wy": np.full(len(z), key[1]), "wx": np.full(len(z), key[2]),
               "z": z + oz, "y": y + oy, "x": x + ox}
        res |= {f"c{c}": out[c, z, y, x] for c in range(channels)}
        return pd.DataFrame(res)

    vals = [f"c{c}" for c in range(channels)]
    schema = "wz long, wy long, wx long, z int, y int, x int, " + ", ".join(f"{v} double" for v in vals)
    preds = w.groupBy("wz", "wy", "wx").applyInPandas(run, schema)
    return normalised_blend(preds, shape, size, stride, vals)


def axis_weight_sum(c: Column, n_windows: int, size: int, stride: int) -> Column:
    """Sum over the covering windows of the one-axis weight factor at a coordinate."""
    s2, top = 2.0 * (size / 4.0) ** 2, (0.5 if size % 2 == 0 else 0.0) ** 2
    d = lambda k: c - k * stride - (size / 2.0 - 0.5)
    return F.aggregate(window_index(c, n_windows, size, stride), F.lit(0.0),
                       lambda acc, k: acc + F.exp((F.lit(top) - d(k) * d(k)) / F.lit(s2)))


def normalised_blend(preds: DataFrame, shape, size: int, stride: int, values: list[str]) -> DataFrame:
    """Like ``blend``, for predictions whose zeros are not stored: the weight sum is a product of
    three one-axis sums, so it needs no rows."""
    w = preds.filter((F.col("z") < shape[0]) & (F.col("y") < shape[1]) & (F.col("x") < shape[2]))
    w = w.withColumn("_w", window_weight(size, stride))
    fx = lambda c: F.sum(F.bround(c * 1e12).cast("long")) / F.lit(1e12)
    g = w.groupBy("z", "y", "x").agg(*[fx(F.col("_w") * F.col(v)).alias(v) for v in values])
    den = F.lit(1.0)
    for c, n in zip("zyx", shape):
        den = den * axis_weight_sum(F.col(c), (padded(n, size, stride) - size) // stride + 1, size, stride)
    g = g.withColumn("_d", F.greatest(den, F.lit(1e-6)))
    return g.select(pack("z", "y", "x").alias("vid"), "z", "y", "x", *[(F.col(v) / F.col("_d")).alias(v) for v in values])


def to_uint16(c: Column) -> Column:
    """clip(0, 1) * 65535, truncated."""
    return (F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 65535.0).cast("int")


def to_rgb8(c: Column) -> Column:
    """abs * 255, truncated."""
    return (F.least(F.abs(c), F.lit(1.0)) * 255.0).cast("int")
