"""The two ways from a field to labelled curves: over the whole volume, and per overlapping chunk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.bridges import bridge_candidates, with_cost
from strandlake.operators.costs import self_costs
from strandlake.operators.curves import turn_cosines
from strandlake.operators.diffuse import diffuse
from strandlake.operators.fragments import end_directions, fragment_ends, fragment_voxels, path_positions
from strandlake.operators.matching import chains, greedy_bridges, ranked_chains
from strandlake.operators.ranks import sequence_in_group
from strandlake.operators.sever import sever
from strandlake.operators.skeleton import labelled_skeleton
from strandlake.params import Params
from strandlake.session import materialize


@dataclass
class Resolved:
    """Tables of a resolved network; every one is a lazy DataFrame over checkpointed inputs."""

    skeleton: DataFrame
    fragments: DataFrame
    fragment_voxels: DataFrame
    ends: DataFrame
    candidates: DataFrame
    bridges: DataFrame
    chains: DataFrame
    members: DataFrame
    labels: DataFrame


def raster_turns(fv: DataFrame) -> DataFrame:
    """Turns between consecutive voxels of a fragment in raster order: (curve, cos_turn)."""
    s = sequence_in_group(fv.select(F.col("frag").alias("curve"), "vid", "z", "y", "x"), ["curve"], ["vid"],
                          bucket=F.shiftright("vid", 42 + 8))
    return turn_cosines(s)


def fragment_self_costs(fv: DataFrame, ends: DataFrame, path_order: bool = False) -> DataFrame:
    """Self cost per fragment. Raster order is the default; ``path_order`` follows the curve instead."""
    if path_order:
        pos = path_positions(fv, ends).join(fv.select("vid", "z", "y", "x"), "vid")
        turns = turn_cosines(pos.withColumnRenamed("frag", "curve"))
    else:
        turns = raster_turns(fv)
    sizes = ends.select(F.col("frag").alias("curve"), F.col("length").cast("long").alias("n"))
    return self_costs(turns, sizes).withColumnRenamed("curve", "frag")


def resolve_skeleton(skel: DataFrame, field: DataFrame, p: Params = Params(), shape=None, do_sever: bool = True,
                     path_order: bool = False) -> Resolved:
    """Skeleton voxels and direction field to chains and a labelled skeleton."""
    field = field.select("vid", "z", "y", "x", "oz", "oy", "ox")
    if do_sever:
        skel = materialize(sever(skel, field, p))
    fv = materialize(fragment_voxels(skel, p.min_fragment_length))
    frags = materialize(fragment_ends(fv))
    ends = materialize(end_directions(fv, frags, field))
    cands = materialize(with_cost(bridge_candidates(ends, field, shape, p)))
    taken = materialize(greedy_bridges(frags, cands, p))
    chain, members = chains(frags, taken, fragment_self_costs(fv, frags, path_order))
    ranked = ranked_chains(chain, p.min_chain_length)
    labels = labelled_skeleton(fv, members, ranked, taken)
    return Resolved(skel, frags, fv, ends, cands, taken, chain, members, labels)


def field_to_skeleton(field: DataFrame, shape, p: Params = Params()) -> DataFrame:
    """Smooth the intensity, threshold it, thin it, prune spurs."""
    from strandlake.grid import with_vid
    from strandlake.operators.stencil import gaussian3d, prune_spurs
    from strandlake.operators.thinning import skeletonize

    f = field.filter(F.col("intensity") != 0).select("z", "y", "x", "intensity")
    if p.smooth_sigma > 0:
        f = gaussian3d(f, "intensity", p.smooth_sigma, shape)
    core = with_vid(f.filter(F.col("intensity") >= p.core_threshold).select("z", "y", "x"))
    return prune_spurs(skeletonize(core), p.spur_rounds)


def run_direct(field: DataFrame, shape, p: Params = Params()) -> dict[str, DataFrame]:
    """Whole-volume run: thin, crop the border, resolve, diffuse. ``field``: vid, z, y, x, vol, intensity, o*."""
    from strandlake.operators.chunks import crop

    skel = materialize(field_to_skeleton(field, shape, p))
    if p.cut_border:
        skel, _ = crop(skel, shape, p.cut_border)
        field, shape = crop(field, shape, p.cut_border)
    field = materialize(field)
    r = resolve_skeleton(skel, field, p, shape)
    labels = materialize(r.labels)
    from strandlake.operators.diffuse import foreground

    vol = diffuse(foreground(field, labels, p), labels, p)
    return {"skeleton": labels, "volume": vol, "chains": r.chains, "bridges": r.bridges, "fragments": r.fragments}


def run_chunked(field: DataFrame, shape, p: Params = Params()) -> dict[str, DataFrame]:
    """Overlapping chunks resolved on their own, then stitched by overlap consensus.

    All chunks run in one plan: each chunk's copy is moved to its own place on a wide grid, far enough
    from the next that nothing can interact, and the direct operators run once over all of them.
    The border is cropped first; chunks whose intensity stays below the core threshold are skipped.
    """
    from strandlake.grid import with_vid
    from strandlake.operators.chunks import assign_chunks, axis_starts, consensus_ids, consensus_matches, crop, stitch
    from strandlake.operators.diffuse import foreground
    from strandlake.operators.thinning import skeletonize
    from strandlake.operators.stencil import gaussian3d, prune_spurs

    if p.cut_border:
        field, shape = crop(field, shape, p.cut_border)
    size, ov = p.chunk_size, p.chunk_overlap
    axes = [axis_starts(n, size, ov) for n in shape]
    gap = size + int(p.max_gap) + 64
    if max(len(a) for a in axes) * gap >= 1 << 21:
        raise ValueError("too many chunks along one axis; raise chunk_size")
    c = assign_chunks(field, shape, size, ov)
    live = c.groupBy("chunk").agg(F.max("intensity").alias("m")).filter(F.col("m") >= p.core_threshold).select("chunk")
    c = c.join(live, "chunk", "left_semi")
    ny, nx = len(axes[1]), len(axes[2])
    idx = {"z": F.floor(F.col("chunk") / (ny * nx)), "y": F.floor(F.col("chunk") / nx) % ny, "x": F.col("chunk") % nx}
    start = {k: F.element_at(F.array(*[F.lit(s) for s in a]), (idx[k] + 1).cast("int")) for k, a in zip("zyx", axes)}
    spread = with_vid(c.withColumns({k: (F.col(k) - start[k] + idx[k] * gap).cast("int") for k in "zyx"}))
    spread = materialize(spread)
    wide = tuple(len(a) * gap for a in axes)
    f = spread
    if p.smooth_sigma > 0:
        sides = [[min(size, n - s) for s in a] for a, n in zip(axes, shape)]
        f = gaussian3d(spread.filter(F.col("intensity") != 0), "intensity", p.smooth_sigma, wide, (gap, sides))
    core = with_vid(f.filter(F.col("intensity") >= p.core_threshold).select("z", "y", "x"))
    skel = materialize(prune_spurs(skeletonize(core), p.spur_rounds))
    r = resolve_skeleton(skel, spread, p, wide)
    labels = materialize(r.labels)
    vol = diffuse(foreground(spread, labels, p), labels, p)

    def home(df):
        q = {k: F.floor(F.col(k) / gap) for k in "zyx"}
        chunk = (q["z"] * ny + q["y"]) * nx + q["x"]
        at = {k: F.element_at(F.array(*[F.lit(s) for s in a]), (q[k] + 1).cast("int")) for k, a in zip("zyx", axes)}
        return with_vid(df.select(chunk.cast("long").alias("chunk"), *[(F.col(k) - q[k] * gap + at[k]).cast("int").alias(k) for k in "zyx"], "label"))

    hv, hs = materialize(home(vol)), materialize(home(labels))
    ids = materialize(consensus_ids(hv, consensus_matches(hv, shape, size, ov, p.min_overlap_ratio)))
    return {"volume": stitch(hv, ids), "skeleton": stitch(hs, ids), "ids": ids}
