"""Neighbourhood operators on sparse voxels.

All of them share one plan: copy face voxels into the neighbouring tile (``grid.halo``), one hash
exchange on the tile, then a local expand and aggregate. The aggregate key (tile, target) is covered
by the partitioning on the tile, so Spark adds no second exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.grid import BITS, DX, DY, DZ, MASK, OFFSETS_26, OFFSETS_27, OFFSETS_6, halo, pack, tile_of, zyx

TILE = 32
TASKS = 8     # tasks of an expanding step for each shuffle partition


def _offset_array(offsets) -> Column:
    return F.array(*[
        F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx"),
                 F.lit(a * DZ + b * DY + c * DX).alias("d"))
        for a, b, c in offsets
    ])


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by the keys to an exact number of tasks, more than there are shuffle partitions.

    Voxel rows compress so well that adaptive execution would put too many of them into one task; and a task that expands them
    holds many times what it reads.
    """
    return df.repartition(TASKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scatter(vox: DataFrame, offsets, carry: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """Send each voxel's row to the targets at the given offsets, partitioned by the target's tile.

    Columns out: tile, target (voxel id), is_self, off (struct), and the carried columns.
    """
    carry = carry or []
    reach = max(max(abs(v) for v in o) for o in offsets)
    src = halo(vox.select("vid", "z", "y", "x", *carry), tile, reach)
    src = dealt(src, "tile")
    out = src.withColumn("off", F.explode(_offset_array(offsets)))
    tz, ty, tx = F.col("z") + F.col("off.dz"), F.col("y") + F.col("off.dy"), F.col("x") + F.col("off.dx")
    out = out.filter((tz >= 0) & (ty >= 0) & (tx >= 0) & (tile_of(tile, tz, ty, tx) == F.col("tile")))
    return out.select(
        "tile", (F.col("vid") + F.col("off.d")).alias("target"), (F.col("off.d") == 0).alias("is_self"), "off", *carry
    )


def stencil(vox: DataFrame, aggs: list[Column], carry: list[str] | None = None, offsets=OFFSETS_27,
            keep_empty: bool = False, tile: int = TILE) -> DataFrame:
    """Aggregate over each voxel's neighbourhood (itself included); one row per voxel.

    ``keep_empty`` keeps targets that are not voxels themselves (dilation-like operators).
    """
    g = scatter(vox, offsets, carry, tile).groupBy("tile", "target").agg(F.max("is_self").alias("_self"), *aggs)
    if not keep_empty:
        g = g.filter("_self")
    z, y, x = zyx("target")
    rest = [c for c in g.columns if c not in ("tile", "target", "_self")]
    return g.select(F.col("target").alias("vid"), z, y, x, *rest)


JUNCTION_DEGREE = 3


def degree(vox: DataFrame) -> DataFrame:
    """Number of 26-neighbours of every voxel, as column ``deg``."""
    return stencil(vox, [(F.count(F.lit(1)) - 1).cast("int").alias("deg")])


def classify(deg: DataFrame) -> DataFrame:
    """Adds ``cls``: isolated, end, path or junction."""
    d = F.col("deg")
    return deg.withColumn(
        "cls", F.when(d == 0, "isolated").when(d == 1, "end").when(d == 2, "path").otherwise("junction"))


def split_junctions(vox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(junction voxels, remaining voxels); a junction has three or more neighbours."""
    d = degree(vox)
    cols = ["vid", "z", "y", "x"]
    return d.filter(F.col("deg") >= JUNCTION_DEGREE).select(cols), d.filter(F.col("deg") < JUNCTION_DEGREE).select(cols)


def endpoints(vox: DataFrame) -> DataFrame:
    """Free ends: voxels with one neighbour once junction voxels are gone."""
    _, rest = split_junctions(vox)
    return degree(rest).filter("deg = 1").select("vid", "z", "y", "x")


def prune_spurs(vox: DataFrame, rounds: int) -> DataFrame:
    """Remove degree-1 voxels, ``rounds`` times (an isolated voxel stays)."""
    cur = vox.select("vid", "z", "y", "x")
    for _ in range(rounds):
        cur = degree(cur).filter("deg <> 1").select("vid", "z", "y", "x")
    return cur


def border_shell(fg: DataFrame, label: str | None = None, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Voxels of which one of the six face neighbours is missing, or carries another label.

    Outside the volume counts as missing.
    """
    same = [] if label is None else [F.collect_set(label).alias("_labels"), F.max(F.when(F.col("is_self"), F.col(label))).alias(label)]
    offs = [(0, 0, 0)] + OFFSETS_6
    s = stencil(fg, [F.count(F.lit(1)).alias("_n"), *same], [label] if label else [], offs)
    cond = F.col("_n") < 7
    if label is not None:
        cond = cond | (F.size("_labels") > 1)
    return s.filter(cond).drop("_n", "_labels")


def dilate(vox: DataFrame, offsets, shape: tuple[int, int, int] | None = None, carry_min: str | None = None) -> DataFrame:
    """Union of offset copies; with ``carry_min`` a target takes the smallest value that reaches it."""
    aggs = [F.min(carry_min).alias(carry_min)] if carry_min else [F.count(F.lit(1)).alias("_n")]
    offs = list(dict.fromkeys([(0, 0, 0), *offsets]))
    out = stencil(vox, aggs, [carry_min] if carry_min else [], offs, keep_empty=True).drop("_n")
    if shape:
        out = out.filter((F.col("z") < shape[0]) & (F.col("y") < shape[1]) & (F.col("x") < shape[2]))
    return out


def _reflect_copies(vox: DataFrame, shape: tuple[int, int, int], reach: int) -> DataFrame:
    """Adds the mirrored rows (edge voxel repeated) that a reflecting border of width ``reach`` reads.

    Coordinates are shifted by ``reach`` so that they stay non-negative.
    """
    out = vox
    for axis, n in zip("zyx", shape):
        c = F.col(axis)
        images = F.array(
            c,
            F.when(c < reach, -1 - c),
            F.when(c >= n - reach, F.lit(2 * n - 1) - c),
        )
        out = out.withColumn(axis, F.explode(F.array_compact(images)))
    return out.select((F.col("z") + reach).alias("z"), (F.col("y") + reach).alias("y"), (F.col("x") + reach).alias("x"),
                      *[k for k in vox.columns if k not in ("z", "y", "x", "vid")])


def _median_tile(group: pa.Table) -> pa.Table:
    """Voxels of a tile of which at least 14 of 27 cells are set, from the voxels of the tile and of one around it."""
    t, v = group.column("tile")[0].as_py(), group.column("vid").to_numpy()
    low = [(t >> s & MASK) * TILE - 1 for s in (2 * BITS, BITS, 0)]
    side = TILE + 2
    z, y, x = ((v >> s & MASK) - o for s, o in zip((2 * BITS, BITS, 0), low))
    n = np.bincount((z * side + y) * side + x, minlength=side ** 3).reshape((side,) * 3)
    n = n[:-2] + n[1:-1] + n[2:]
    n = n[:, :-2] + n[:, 1:-1] + n[:, 2:]
    n = n[:, :, :-2] + n[:, :, 1:-1] + n[:, :, 2:]
    z, y, x = (a.astype(np.int64) + o + 1 for a, o in zip(np.nonzero(n >= 14), low))
    return pa.table({"vid": z * DZ + y * DY + x})


def median3(mask: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """3x3x3 median of a binary mask: kept where at least 14 of 27 cells are set; borders reflect. Tiles are counted as arrays."""
    m = halo(_reflect_copies(mask.select("z", "y", "x"), shape, 1), TILE, 1)
    m = dealt(m.select("tile", pack("z", "y", "x").alias("vid")), "tile")
    s = m.groupBy("tile").applyInArrow(_median_tile, "vid long").select(*zyx("vid"))
    s = s.select((F.col("z") - 1).alias("z"), (F.col("y") - 1).alias("y"), (F.col("x") - 1).alias("x"))
    s = s.filter((F.col("z") >= 0) & (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("z") < shape[0])
                 & (F.col("y") < shape[1]) & (F.col("x") < shape[2]))
    return s.withColumn("vid", pack("z", "y", "x")).select("vid", "z", "y", "x")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    import math

    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    s = sum(w)
    return [v / s for v in w]


def gaussian3d(field: DataFrame, value: str, sigma: float, shape: tuple[int, int, int],
               cells: tuple[int, list[list[int]]] | None = None) -> DataFrame:
    """Separable 3-D Gaussian of a sparse field (absent = 0), reflecting borders.

    Three passes of one axis each: (2R+1) targets per row instead of (2R+1)^3. With ``cells`` =
    (pitch, sides per axis), the volume is a lattice of separate boxes: box i of an axis starts at
    i * pitch, is sides[axis][i] wide, and reflects at its own borders.
    """
    w = gaussian_weights(sigma)
    r = len(w) // 2
    out = field.select("z", "y", "x", F.col(value).cast("double").alias(value))
    for k, axis in enumerate("zyx"):
        c = F.col(axis)
        if cells is None:
            local, n = c, F.lit(shape[k])
        else:
            local = c % cells[0]
            n = F.element_at(F.array(*[F.lit(v) for v in cells[1][k]]), (F.floor(c / cells[0]) + 1).cast("int"))
        base = c - local
        images = F.array(c, F.when(local < r, base - 1 - local), F.when(local >= n - r, base + 2 * n - 1 - local))
        m = out.withColumn(axis, F.explode(F.array_compact(images))).withColumn(axis, (F.col(axis) + r).cast("int"))
        m = m.withColumn("vid", pack("z", "y", "x"))
        offs = [tuple((d if i == k else 0) for i in range(3)) for d in range(-r, r + 1)]
        d = F.coalesce(*[F.when(F.col("off.d" + axis) == dd, F.lit(w[dd + r])) for dd in range(-r, r + 1)])
        s = scatter(m, offs, [value]).groupBy("tile", "target").agg(F.sum(d * F.col(value)).alias(value))
        z, y, x = zyx("target")
        out = s.select(z, y, x, value).withColumn(axis, F.col(axis) - r).filter(F.col(axis) >= 0)
        if cells is None:
            out = out.filter(F.col(axis) < shape[k])
        else:
            out = out.filter((F.col(axis) % cells[0]) < F.element_at(
                F.array(*[F.lit(v) for v in cells[1][k]]), F.least(F.floor(F.col(axis) / cells[0]) + 1, F.lit(len(cells[1][k]))).cast("int")))
    return out.withColumn("vid", pack("z", "y", "x")).select("vid", "z", "y", "x", value)
