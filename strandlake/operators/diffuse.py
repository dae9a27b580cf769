"""Spreading skeleton labels over the foreground, never across components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.grid import DX, DY, DZ, OFFSETS_26, halo, tile_of, zyx
from strandlake.operators.components import component_boxes, connected_components
from strandlake.operators.lookup import salted_lookup
from strandlake.operators.ranges import nearest
from strandlake.params import Params
from strandlake.session import materialize, release


def foreground(field: DataFrame, skel: DataFrame | None = None, p: Params = Params(), vol: str | None = "vol",
               intensity: str | None = "intensity") -> DataFrame:
    """Voxels with volume above or intensity at its threshold, plus the skeleton; absent values are 0."""
    cond = F.lit(False)
    if vol:
        cond = cond | (F.coalesce(F.col(vol), F.lit(0.0)) > p.vol_threshold)
    if intensity:
        cond = cond | (F.coalesce(F.col(intensity), F.lit(0.0)) >= p.fg_threshold)
    out = field.filter(cond).select("vid", "z", "y", "x")
    if skel is not None:
        out = out.union(skel.select("vid", "z", "y", "x")).distinct()
    return out


def component_classes(cc: DataFrame, skel: DataFrame) -> DataFrame:
    """comp, n_labels, label (the only one), box volume, class: unseeded, single or multi."""
    seeds = cc.select("vid", "comp").join(skel.select("vid", "label"), "vid")
    s = seeds.groupBy("comp").agg(F.min("label").alias("label"), F.max("label").alias("label_hi"))
    b = component_boxes(cc)
    vol = F.lit(1).cast("long")
    for c in ("z", "y", "x"):
        vol = vol * (F.col(f"{c}1") - F.col(f"{c}0") + 1)
    j = b.withColumn("box", vol).join(s, "comp", "left")
    cls = F.when(F.col("label").isNull(), "unseeded").when(F.col("label") == F.col("label_hi"), "single").otherwise("multi")
    return j.select("comp", "n", "box", cls.alias("cls"), "label")


HOP = 1 << 32          # arrivals compare by (hops, label), packed into one number
UNREACHED = np.iinfo(np.int64).max
FLOOD_TILE = 48


def _flood(pdf: pd.DataFrame) -> pd.DataFrame:
    """Earliest arrivals inside one tile and its rim, from what its voxels know so far."""
    pdf = pdf.sort_values("vid")
    v, key = pdf["vid"].to_numpy(), pdf["key"].to_numpy().copy()
    nb = []
    for dz, dy, dx in OFFSETS_26:
        w = v + (dz * DZ + dy * DY + dx * DX)
        j = np.searchsorted(v, w)
        j[j == len(v)] = 0
        nb.append(np.where(v[j] == w, j, -1).astype(np.int32))
    nb = np.stack(nb, 1)
    front = np.flatnonzero(key < UNREACHED)
    while len(front):
        to = nb[front].ravel()
        val = np.repeat(key[front] + HOP, nb.shape[1])
        to, val = to[to >= 0], val[to >= 0]
        better = val < key[to]
        to, val = to[better], val[better]
        np.minimum.at(key, to, val)
        front = np.unique(to)
    own = pdf["own"].to_numpy()
    return pd.DataFrame({"vid": v[own], "key": key[own], "news": (key[own] < pdf["key"].to_numpy()[own])})


def flood(vox: DataFrame, tile: int = FLOOD_TILE, max_rounds: int = 100_000) -> DataFrame:
    """(vid, label): breadth-first spread of labels over voxels (vid, z, y, x, label or null); equal arrivals go to the smaller label.

    Each tile settles what it can from its own voxels and a rim of one, then passes on what changed; rounds
    end when no tile has news. A task holds one tile, whatever the size of a component.
    """
    state = vox.select("vid", "z", "y", "x", F.coalesce(F.col("label").cast("long"), F.lit(int(UNREACHED))).alias("key"))
    past = state = materialize(state)
    for _ in range(max_rounds):
        near = halo(state.withColumn("home", tile_of(tile)), tile, 1).withColumn("own", F.col("home") == F.col("tile"))
        new = materialize(near.select("tile", "vid", "key", "own").groupBy("tile").applyInPandas(_flood, "vid long, key long, news boolean"))
        release(past)
        past, state = new, new.select("vid", *zyx("vid"), "key")
        if new.filter("news").isEmpty():
            return state.filter(F.col("key") < int(UNREACHED)).select("vid", (F.col("key") % HOP).cast("int").alias("label"))
    raise RuntimeError("flood did not settle")


def diffuse(fg: DataFrame, skel: DataFrame, p: Params = Params()) -> DataFrame:
    """vid, z, y, x, label for every foreground voxel that a label reaches.

    One label in a component: the whole component takes it. Several: by ``p.diffuse_rule``, a flood from
    all seeds at once ("flood") or the nearest seed of the component ("nearest"), whatever the component's
    size. Skeleton voxels keep their label.
    """
    if p.diffuse_rule not in ("flood", "nearest"):
        raise ValueError("diffuse_rule is flood or nearest")
    allfg = fg.select("vid", "z", "y", "x").union(skel.select("vid", "z", "y", "x")).distinct()
    cc = materialize(connected_components(allfg))
    cls = materialize(component_classes(cc, skel))
    tagged = salted_lookup(cc, cls.filter("cls <> 'unseeded'").select("comp", "cls", F.col("label").alias("only")), ["comp"], ["vid"], "inner")
    tagged = tagged.join(skel.select("vid", "label"), "vid", "left")
    single = tagged.filter("cls = 'single'").select("vid", F.col("only").cast("int").alias("label"))
    multi = materialize(tagged.filter("cls = 'multi'").select("vid", "z", "y", "x", "comp", "label"))
    if p.diffuse_rule == "flood":
        parts = single.union(flood(multi))
    else:
        seeds = multi.filter("label is not null")
        near = nearest_label(multi.filter("label is null").select("vid", "z", "y", "x", "comp"), seeds, ["comp"])
        parts = single.union(near).union(seeds.select("vid", F.col("label").cast("int")))
    return parts.select("vid", *zyx("vid"), "label")


def nearest_label(points: DataFrame, seeds: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(vid, label) of the nearest seed; ties go to the smaller label."""
    s = seeds.withColumn("sk", F.struct("label", F.col("vid").alias("sv")))
    n = nearest(points, s, "vid", "sk", on=on)
    return n.select("vid", F.col("sk.label").cast("int").alias("label"))


def prune_and_repropagate(skel: DataFrame, vol: DataFrame, min_length: int = 5) -> tuple[DataFrame, DataFrame]:
    """Drop labels with short skeletons, renumber the rest 1..N by old id, give orphaned voxels to the
    nearest surviving skeleton voxel (anywhere) and lock the skeleton. Returns (skeleton, volume)."""
    from strandlake.operators.ranks import global_rank

    sizes = skel.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ids = global_rank(sizes.filter(F.col("n") >= min_length), [F.col("label")], "new").select("label", "new")
    sk = materialize(salted_lookup(skel.select("vid", "z", "y", "x", "label"), ids, ["label"], ["vid"], "inner").select(
        "vid", "z", "y", "x", F.col("new").cast("int").alias("label")))
    v = salted_lookup(vol.select("vid", "z", "y", "x", "label"), ids, ["label"], ["vid"])
    v = v.join(sk.select("vid", F.col("label").alias("lock")).hint("merge"), "vid", "left")
    v = v.select("vid", "z", "y", "x", F.coalesce("lock", F.col("new").cast("int")).alias("label"))
    v = materialize(v)
    near = nearest_label(v.filter("label is null"), sk)
    out = v.filter("label is not null").select("vid", "label").union(near)
    # skeleton voxels outside the old volume are labelled too
    out = out.union(sk.join(vol.select("vid").hint("merge"), "vid", "left_anti").select("vid", "label"))
    return sk, out.select("vid", *zyx("vid"), "label")
