"""Connected components of voxels and of edge tables.

Voxels: each tile is resolved alone (a tile holds at most TILE^3 voxels, whatever the input), then
only the labels that meet in tile faces form a graph. That graph is smaller than the voxel table by
orders of magnitude; it is contracted inside partitions, then in rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.grid import DX, DY, DZ, OFFSETS_26, halo, tile_of
from strandlake.session import materialize, release

TILE = 64


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex index of each vertex's component (hooking and pointer jumping)."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        lo, hi = np.minimum(la, lb), np.maximum(la, lb)
        live = lo != hi
        if not live.any():
            break
        a, b = a[live], b[live]
        np.minimum.at(lab, hi[live], lo[live])
        while True:
            nxt = lab[lab]
            if (nxt == lab).all():
                break
            lab = nxt
    return lab


HALF = [dz * DZ + dy * DY + dx * DX for dz, dy, dx in OFFSETS_26 if dz * DZ + dy * DY + dx * DX > 0]


def _tile_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vid")
    v, g = pdf["vid"].to_numpy(), pdf["grp"].to_numpy()
    n = len(v)
    src, dst = [], []
    for d in HALF:
        j = np.searchsorted(v, v + d)
        ok = j < n
        i = np.nonzero(ok)[0]
        j = j[ok]
        hit = (v[j] == v[i] + d) & (g[j] == g[i])
        src.append(i[hit])
        dst.append(j[hit])
    lab = min_labels(n, np.concatenate(src), np.concatenate(dst))
    return pd.DataFrame({"vid": v, "own": pdf["own"].to_numpy(), "shared": pdf["shared"].to_numpy(), "grp": g, "lab": v[lab]})


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's edges as stars: every vertex with the smallest one it can reach inside the partition."""
    a = b = np.zeros(0, dtype=np.int64)
    for f in frames:
        a, b = np.concatenate([a, f["a"].to_numpy()]), np.concatenate([b, f["b"].to_numpy()])
        ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = ids[min_labels(len(ids), inv[:len(a)], inv[len(a):])]
        a, b = ids[root != ids], root[root != ids]
    yield pd.DataFrame({"a": a, "b": b})


def _hang(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one: all larger neighbours, or the smaller ones with the vertex itself."""
    near = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = near.join(least, "a")
    out = met.filter("b > a").select("b", "m") if large else met.filter("b <> m").select("b", "m").union(met.select("a", "m"))
    return out.toDF("a", "b").filter("a <> b").distinct()


def edge_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(v, root) for every vertex of an undirected edge table; root is the smallest vertex id.

    Edges are dealt by ranges of vertex ids (which are near in space) and contracted inside each partition;
    what adaptive execution leaves in one partition is then done. Rounds of large and small stars contract
    the rest, so the number of rounds grows with the logarithm of the longest path. Per vertex only a
    minimum is gathered, and the joins with it split where a vertex is hot.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    now = materialize(e.repartitionByRange("a").mapInPandas(_contract, "a long, b long"))
    seen = None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first())
        if mark == seen or mark[0] == 0 or mark[0] == mark[2] and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            # stars already: every vertex hangs on one root, and no root hangs on anything
            return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
        seen, past = mark, now
        now = materialize(_hang(_hang(past, True), False))
        release(past)
    raise RuntimeError("component rounds did not converge")


def connected_components(vox: DataFrame, same: str | None = None, tile: int = TILE) -> DataFrame:
    """26-connected components: (vid, z, y, x, comp), comp being the smallest voxel id inside.

    With ``same``, voxels are connected only where that column agrees, and it is kept in the output.
    """
    grp = F.lit(0).cast("long") if same is None else F.col(same).cast("long")
    crosses = None
    for c in ("z", "y", "x"):
        k = F.floor(F.greatest(F.col(c) - 1, F.lit(0)) / tile) != F.floor((F.col(c) + 1) / tile)
        crosses = k if crosses is None else crosses | k
    src = vox.select("vid", "z", "y", "x", grp.alias("grp"), crosses.alias("shared"), tile_of(tile).alias("home"))
    local = (
        halo(src, tile, 1).withColumn("own", F.col("home") == F.col("tile"))
        .select("tile", "vid", "grp", "own", "shared")
        .groupBy("tile").applyInPandas(_tile_labels, "vid long, own boolean, shared boolean, grp long, lab long")
    )
    local = materialize(local)
    # a voxel seen by several tiles ties their labels together (at most eight of them)
    ties = (
        local.filter("shared").groupBy("vid").agg(F.min("lab").alias("a"), F.collect_set("lab").alias("labs"))
        .filter(F.size("labs") > 1).select("a", F.explode("labs").alias("b")).filter("a <> b")
    )
    roots = edge_components(ties)
    own = local.filter("own").select("vid", "grp", "lab")
    # a tile-local label covers at most one tile, so this key cannot be hot
    out = own.join(roots.withColumnRenamed("v", "lab"), "lab", "left").select(
        "vid", "grp", F.coalesce("root", "lab").alias("comp"))
    z = F.shiftright("vid", 42).cast("int").alias("z")
    y = F.shiftright("vid", 21).bitwiseAND(F.lit((1 << 21) - 1)).cast("int").alias("y")
    x = F.col("vid").bitwiseAND(F.lit((1 << 21) - 1)).cast("int").alias("x")
    kept = [] if same is None else [F.col("grp").cast(vox.schema[same].dataType).alias(same)]
    return out.select("vid", z, y, x, "comp", *kept)


def component_boxes(cc: DataFrame) -> DataFrame:
    """Size and bounding box of every component (upper bounds inclusive)."""
    return cc.groupBy("comp").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{c}{s}") for c in ("z", "y", "x") for f, s in ((F.min, "0"), (F.max, "1"))])
