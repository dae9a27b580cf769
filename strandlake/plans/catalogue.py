"""Every operator as a query over the driver tables: name -> function(spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.vec3 import dot, vec
from strandlake.grid import ball_offsets, pack, with_vid, zyx
from strandlake.operators import (bridges, chunks, components, costs, curves, diffuse, fields, fragments, geometry, matching,
                                  metrics, ranges, ranks, sever, skeleton, stamps, stencil, windows3d)
from strandlake.params import Params
from strandlake.session import materialize
from strandlake.sources import discovery, gad, lift

QUERIES: dict = {}
V = ["vid", "z", "y", "x"]
R = lambda c, n=6: F.round(c, n)


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, cols, n: int = 6) -> DataFrame:
    return df.withColumns({c: R(F.col(c), n) for c in cols})


def extent(vox: DataFrame) -> tuple[int, int, int]:
    r = vox.agg(*[F.max(c) + 1 for c in "zyx"]).first()
    return int(r[0]), int(r[1]), int(r[2])


# ---- voxel neighbourhoods, filters and sets --------------------------------------------------

@query
def voxel_degree(s, d):
    return stencil.degree(lift.skeleton(s, d))


@query
def voxel_classes(s, d):
    return stencil.classify(stencil.degree(lift.skeleton(s, d))).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query
def junction_voxels(s, d):
    return stencil.split_junctions(lift.skeleton(s, d))[0]


@query
def mask_difference(s, d):
    return stencil.split_junctions(lift.skeleton(s, d))[1]


@query
def endpoint_voxels(s, d):
    return stencil.endpoints(lift.skeleton(s, d))


@query
def prune_spurs(s, d):
    return stencil.prune_spurs(lift.skeleton(s, d), 2)


@query
def ball_dilate(s, d):
    return lift.foreground(s, d)


@query
def border_shell(s, d):
    return stencil.border_shell(lift.foreground(s, d)).select(V)


def _labelled_fg(s, d, spacing=3):
    return stencil.dilate(lift.skeleton(s, d, spacing), ball_offsets(1), carry_min="fiber").select(
        *V, (F.col("fiber") + 1).cast("int").alias("label"))


@query
def border_shell_labelled(s, d):
    return stencil.border_shell(_labelled_fg(s, d), "label").select(*V, "label")


@query
def shell_points(s, d):
    """Shell voxels with their current label, 0 where there is none."""
    shell = stencil.border_shell(lift.foreground(s, d)).select(V)
    lab = lift.skeleton(s, d).select("vid", (F.col("fiber") + 1).cast("int").alias("label"))
    return shell.join(lab, "vid", "left").select("z", "y", "x", F.coalesce("label", F.lit(0)).alias("label"))


@query
def six_faces(s, d):
    sk = materialize(lift.skeleton(s, d))
    return chunks.six_faces(sk, extent(sk)).select("vid", "face")


@query
def border_crop(s, d):
    sk = materialize(lift.skeleton(s, d))
    return chunks.crop(sk, extent(sk), 2)[0].select(*V, "fiber")


@query
def sub_box(s, d):
    return chunks.sub_box(lift.skeleton(s, d), (10, 0, 5), (40, 20, 30)).select(V)


@query
def face_of_point(s, d):
    sk = lift.skeleton(s, d)
    return sk.select("vid", chunks.classify_face(F.col("z"), F.col("y"), F.col("x"), 48).alias("face"))


@query
def threshold_core(s, d):
    return lift.skeleton(s, d).filter(F.col("intensity") >= 0.28).select(*V, "intensity")


@query
def fg_union(s, d):
    sk = lift.skeleton(s, d)
    f = sk.withColumn("vol", F.when(F.col("seq") % 3 == 0, 1.0).otherwise(0.0))
    return diffuse.foreground(f, stencil.split_junctions(sk)[0])


@query
def mask_intersection(s, d):
    return lift.foreground(s, d).join(lift.skeleton(s, d).filter("intensity >= 0.28").select("vid"), "vid", "left_semi").select(V)


@query
def median3(s, d):
    fg = materialize(lift.foreground(s, d))
    return stencil.median3(fg, extent(fg))


@query
def gaussian3d(s, d):
    sk = materialize(lift.skeleton(s, d))
    return rounded(stencil.gaussian3d(sk, "intensity", 0.6, extent(sk)), ["intensity"])


@query
def tile_density(s, d):
    t = lift.skeleton(s, d).groupBy(*[F.floor(F.col(c) / 16).cast("int").alias(f"t{c}") for c in "zyx"])
    return t.agg(R(F.count(F.lit(1)) / F.lit(4096.0), 9).alias("density"), F.max("intensity").alias("max_intensity"))


@query
def active_chunks(s, d):
    """Chunks whose largest intensity reaches the core threshold; the others are never opened."""
    sk = materialize(lift.skeleton(s, d))
    c = chunks.assign_chunks(sk, extent(sk), 32, 16)
    return c.groupBy("chunk").agg(F.max("intensity").alias("max_intensity")).filter(F.col("max_intensity") >= 0.28)


@query
def dense_patch(s, d):
    """First of 50 candidate origins (in order of a hash) whose patch has an admissible density; the centre (id 50) if none has."""
    sk = materialize(lift.skeleton(s, d))
    sh, side = extent(sk), 8
    n = s.range(51).select("id", *[F.when(F.col("id") == 50, F.lit(max(m - side, 0) // 2)).otherwise(
        F.floor(((F.col("id") * k + k) % 997) / 997.0 * (max(m - side, 0) + 1))).cast("int").alias(f"{c}0") for c, m, k in zip("zyx", sh, (379, 521, 761))])
    b = n.select("*", *[(F.col(f"{c}0") + (side - 1) / 2).alias(f"m{c}") for c in "zyx"])
    hit = ranges.near_join(b, sk.select("z", "y", "x"), (side - 1) / 2, ("mz", "my", "mx"), ("z", "y", "x"))
    g = n.join(hit.groupBy("id").agg((F.count(F.lit(1)) / F.lit(float(side ** 3))).alias("density")), "id", "left").fillna(0.0, ["density"])
    return g.filter((F.col("id") == 50) | F.col("density").between(0.03, 0.35)).orderBy("id").limit(1)


@query
def mip(s, d):
    return lift.skeleton(s, d).groupBy("y", "x").agg(F.max("intensity").alias("v"))


@query
def intensity_u16(s, d):
    return lift.skeleton(s, d).select("vid", windows3d.to_uint16(F.col("intensity") * 1.5 - 0.1).alias("v"))


@query
def orientation_rgb(s, d):
    return lift.oriented(s, d).select("vid", *[windows3d.to_rgb8(F.col(f"o{c}")).alias(c) for c in "zyx"])


# ---- components, branches, severing ----------------------------------------------------------

@query
def branch_components(s, d):
    return components.connected_components(stencil.split_junctions(lift.skeleton(s, d))[1]).select("vid", "comp")


@query
def junction_clusters(s, d):
    return components.connected_components(stencil.split_junctions(lift.skeleton(s, d))[0]).select("vid", "comp")


@query
def fg_components(s, d):
    cc = components.connected_components(lift.foreground(s, d))
    return cc.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))


@query
def label_components(s, d):
    """Components within equal labels: pieces of a label that do not touch."""
    sk = lift.skeleton(s, d).withColumn("label", (F.col("fiber") + 1).cast("int"))
    return components.connected_components(sk, same="label").select("vid", "label", "comp")


@query
def component_bbox(s, d):
    return components.component_boxes(components.connected_components(lift.foreground(s, d, 8)))


@query
def component_label_class(s, d):
    sk = lift.skeleton(s, d, 8).withColumn("label", F.floor(F.col("seq") / 20).cast("int") + 1)
    cc = materialize(components.connected_components(lift.foreground(s, d, 8)))
    return diffuse.component_classes(cc, sk.filter("fiber % 5 <> 0")).select("comp", "n", "box", "cls")


SEVER = Params(max_rung_length=6, min_neighbor_length=8)


def _branches(s, d):
    o = materialize(lift.oriented(s, d))
    b, c = sever.branches_and_clusters(o)
    return o, materialize(b), materialize(c)


@query
def branch_stats(s, d):
    o, b, _ = _branches(s, d)
    return rounded(sever.branch_stats(b, o), ["mz", "my", "mx"])


@query
def branch_chord(s, d):
    _, b, _ = _branches(s, d)
    return rounded(sever.branch_chords(sever.branch_stats(b)).select("branch", "n", "cz", "cy", "cx", "chord"), ["chord"])


@query
def branch_touch(s, d):
    _, b, c = _branches(s, d)
    return sever.branch_touch(b, c)


@query
def branch_adjacency(s, d):
    _, b, c = _branches(s, d)
    return sever.adjacency_degree(sever.branch_touch(b, c))


@query
def rung_severed(s, d):
    o, b, c = _branches(s, d)
    return sever.severed_branches(b, c, o, SEVER)


@query
def severed_skeleton(s, d):
    o = materialize(lift.oriented(s, d))
    return sever.sever(o.select(V), o, SEVER)


# ---- fragments, bridges, chains --------------------------------------------------------------

BRIDGE = Params(max_gap=4.0)


def _fragments(s, d, spacing=8):
    o = materialize(lift.oriented(s, d, spacing))
    fv = materialize(fragments.fragment_voxels(o.select(V)))
    return o, fv, fragments.fragment_ends(fv)


@query
def fragment_lengths(s, d):
    fv = fragments.fragment_voxels(lift.skeleton(s, d))
    return fv.groupBy("frag").agg(F.count(F.lit(1)).alias("n"))


@query
def long_fragments(s, d):
    return fragments.fragment_voxels(lift.skeleton(s, d), 5).select("vid", "frag")


@query
def fragment_endpoints(s, d):
    return _fragments(s, d, 3)[2]


@query
def fragment_path_order(s, d):
    o, fv, e = _fragments(s, d, 8)
    return fragments.path_positions(fv, materialize(e))


@query
def nematic_tensor(s, d):
    o, fv, e = _fragments(s, d, 3)
    t = fragments.nematic_tensor(fragments.anchors(fv, materialize(e)), o)
    return rounded(t.select("frag", "end", "avid", *[(F.col(f"t{n}") / F.lit(1e9)).alias(f"t{n}") for n, _, _ in fragments.TENSOR]),
                   [f"t{n}" for n, _, _ in fragments.TENSOR])


@query
def end_directions(s, d):
    o, fv, e = _fragments(s, d, 3)
    return rounded(fragments.end_directions(fv, materialize(e), o), ["oz", "oy", "ox", "tz", "ty", "tx"])


def _directed_ends(s, d):
    """Fragment ends with the outward direction of the field around their anchors."""
    o, fv, e = _fragments(s, d, 8)
    e = materialize(e)
    return o, fv, e, materialize(fragments.end_directions(fv, e, o).select("frag", "end", "vid", "z", "y", "x", "oz", "oy", "ox"))


@query
def endpoint_pairs(s, d):
    _, fv, e = _fragments(s, d, 8)
    p = bridges.end_pairs(fragments.end_table(e).select("frag", "end", "z", "y", "x"), 4.0)
    return p.select("frag_a", "end_a", "frag_b", "end_b", F.col("d2").cast("int").alias("d2"))


def _candidates(s, d):
    o, fv, e, ends = _directed_ends(s, d)
    return fv, e, bridges.with_cost(bridges.bridge_candidates(ends, o, None, BRIDGE))


@query
def bridge_candidates(s, d):
    c = _candidates(s, d)[2]
    return rounded(c.select("frag_a", "end_a", "frag_b", "end_b", "gap", "mutual", "cos_a", "cos_b", "durable", "score"),
                   ["gap", "mutual", "cos_a", "cos_b", "durable", "score"])


@query
def bridge_costs(s, d):
    c = _candidates(s, d)[2]
    return rounded(c.select("frag_a", "end_a", "frag_b", "end_b", "cost"), ["cost"], 5)


@query
def matched_bridges(s, d):
    fv, e, c = _candidates(s, d)
    return rounded(matching.greedy_bridges(e, materialize(c), BRIDGE), ["cost"], 5)


@query
def chain_table(s, d):
    fv, e, c = _candidates(s, d)
    m = materialize(matching.greedy_bridges(e, materialize(c), BRIDGE))
    return matching.chains(e, m)[0]


@query
def labelled_skeleton(s, d):
    fv, e, c = _candidates(s, d)
    m = materialize(matching.greedy_bridges(e, materialize(c), BRIDGE))
    ch, mem = matching.chains(e, m)
    return skeleton.labelled_skeleton(fv, mem, matching.ranked_chains(ch, 5), m)


def _resolved(s, d):
    from strandlake.plans.pipeline import resolve_skeleton

    o = materialize(lift.oriented(s, d))
    p = Params(max_gap=3.0)
    return resolve_skeleton(o.select(V), o, p), p


@query
def resolved_network(s, d):
    """The whole direct run: severing, fragments, bridges, chains, labels, diffusion, lengths.

    One row a chain; chains that are too short for a label have none, and no voxels.
    """
    r, p = _resolved(s, d)
    chain, labels = materialize(r.chains), materialize(r.labels)
    volume = diffuse.diffuse(diffuse.foreground(lift.foreground(s, d).withColumn("vol", F.lit(1.0)), labels, p, intensity=None), labels, p)
    ranked = matching.ranked_chains(chain, p.min_chain_length).select("root", "label")
    sizes = [metrics.label_lengths(t).withColumnRenamed("n", n) for t, n in ((labels, "skeleton_voxels"), (volume, "volume_voxels"))]
    out = chain.join(ranked, "root", "left")
    for t in sizes:
        out = out.join(t, "label", "left")
    return out.select("root", "n_fragments", "total_length", "total_cost", F.col("label").cast("int").alias("label"),
                      *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("skeleton_voxels", "volume_voxels")])


def resolved_chains(s, d):
    """Skeleton to chains, without labels and diffusion."""
    return _resolved(s, d)[0].chains.select("root", "n_fragments", "total_length", "total_cost")


@query
def bridge_line_voxels(s, d):
    n = curves.neighbours_on_curve(lift.skeleton(s, d), "fiber", "seq", ["vid"], 3).filter("vid_p3 is not null")
    return skeleton.voxel_lines(n, "vid", "vid_p3", ["fiber", "seq"]).select("fiber", "seq", "i", "z", "y", "x")


@query
def priority_overlay(s, d):
    sk = lift.skeleton(s, d)
    fill = _labelled_fg(s, d).select("vid", "label", F.lit(0).alias("layer"))
    lines = sk.select("vid", F.floor(F.col("seq") / 20).cast("int").alias("label"), F.lit(1).alias("layer"))
    return skeleton.overlay(fill.union(lines), "label", ["layer", "label"])


# ---- diffusion -------------------------------------------------------------------------------

def _seeds(s, d, spacing):
    """Labelled skeleton voxels; every fifth of a fibre has no label yet."""
    sk = lift.skeleton(s, d, spacing).filter("seq % 5 <> 2")
    return materialize(sk.select(*V, (F.floor(F.col("seq") / 20) + 1).cast("int").alias("label")))


@query
def diffuse_flood(s, d):
    return diffuse.diffuse(lift.foreground(s, d, 8), _seeds(s, d, 8)).select("vid", "label")


@query
def diffuse_nearest(s, d):
    return diffuse.diffuse(lift.foreground(s, d, 8), _seeds(s, d, 8), Params(diffuse_rule="nearest")).select("vid", "label")


@query
def prune_repropagate(s, d):
    sk = lift.skeleton(s, d).select(*V, (F.col("fiber") * (1 << 20) + F.floor(F.col("seq") / 9) + 1).cast("long").alias("label"))
    vol = stencil.dilate(sk, ball_offsets(1), carry_min="label")
    return diffuse.prune_and_repropagate(materialize(sk), materialize(vol), 5)[1].select("vid", "label")


# ---- metrics, chunks, borders ----------------------------------------------------------------

def _gt_pred(s, d):
    sk = lift.skeleton(s, d)
    gt = sk.select("vid", (F.col("fiber") + 1).cast("int").alias("label"))
    pred = sk.filter("seq % 7 <> 0").select("vid", (F.floor(F.col("fiber") / 2) * 100 + F.floor(F.col("seq") / 50) + 1).cast("int").alias("label"))
    return gt, pred


@query
def overlap_matrix(s, d):
    return metrics.overlap_matrix(*_gt_pred(s, d))


@query
def panoptic_metrics(s, d):
    return rounded(metrics.panoptic(*_gt_pred(s, d)).drop("error"), ["mean_iou", "sq", "rq_gt", "pq"])


@query
def label_lengths(s, d):
    return metrics.label_lengths(_gt_pred(s, d)[1])


@query
def length_summary(s, d):
    return rounded(metrics.length_summary(metrics.label_lengths(_gt_pred(s, d)[1])), ["mean_length"])


@query
def length_histogram(s, d):
    return metrics.length_histogram(fragment_lengths(s, d))


@query
def chunk_grid(s, d):
    sk = lift.skeleton(s, d)
    return chunks.chunk_grid(s, extent(sk), 32, 16)


@query
def chunk_pairs(s, d):
    sk = lift.skeleton(s, d)
    return chunks.chunk_pairs(chunks.chunk_grid(s, extent(sk), 32, 16))


def _chunked(s, d):
    sk = materialize(lift.skeleton(s, d))
    sh = extent(sk)
    c = chunks.assign_chunks(sk.select(*V, "fiber", "seq"), sh, 32, 16)
    lab = (F.col("fiber") * 4096 + F.floor((F.col("seq") + F.col("chunk") % 3) / 12) + 1).cast("long")   # beyond 32 bits from fiber 524,288 on
    return materialize(c.select("chunk", *V, lab.alias("label"))), sh


@query
def chunk_assignment(s, d):
    return _chunked(s, d)[0].select("chunk", "vid")


@query
def consensus_matches(s, d):
    c, sh = _chunked(s, d)
    m = chunks.consensus_matches(c, sh, 32, 16)
    return rounded(m.withColumns({k: F.col(k).cast("int") for k in ("label_a", "label_b")}), ["ratio"])


@query
def stitched_labels(s, d):
    c, sh = _chunked(s, d)
    ids = chunks.consensus_ids(c, chunks.consensus_matches(c, sh, 32, 16))
    return chunks.stitch(c, ids).select("vid", F.col("label").cast("int").alias("label"))


@query
def border_split(s, d):
    fg = materialize(_labelled_fg(s, d))
    v, _, _ = chunks.crop_and_split(fg, None, extent(fg), 2, 3)
    return v.select("vid", "label")


# ---- curves ----------------------------------------------------------------------------------

def _curve(s, d):
    return lift.skeleton(s, d).select(F.col("fiber").alias("curve"), "seq", "z", "y", "x")


@query
def curve_diff(s, d):
    return curves.curve_diff(_curve(s, d))


@query
def curve_tangent(s, d):
    return rounded(curves.tangents(_curve(s, d)).select("curve", "seq", "tz", "ty", "tx"), ["tz", "ty", "tx"])


@query
def turn_angles(s, d):
    return rounded(curves.turn_cosines(_curve(s, d)), ["cos_turn"])


@query
def segment_self_cost(s, d):
    c = _curve(s, d)
    return rounded(costs.self_costs(curves.turn_cosines(c), curves.curve_lengths(c)), ["curvature_cost", "sharp_cost", "self_cost"], 5)


@query
def sharp_bends(s, d):
    return curves.turn_cosines(_curve(s, d)).groupBy("curve").agg(F.count_if(F.col("cos_turn") < costs.SHARP_COS).alias("n_sharp"))


@query
def arc_length(s, d):
    return rounded(curves.arc_length(_curve(s, d)).select("curve", "seq", "arc"), ["arc"], 5)


@query
def densify(s, d):
    return rounded(curves.densify(_curve(s, d), 6), ["z", "y", "x"])


@query
def resample_unit(s, d):
    return rounded(curves.resample_unit(_curve(s, d)), ["z", "y", "x"], 4)


@query
def inbox_runs(s, d):
    return curves.runs_in_box(_curve(s, d), (5, 0, 0), (60, 26, 23))


@query
def gaussian_1d(s, d):
    return rounded(curves.smooth(_curve(s, d), 1.2, "nearest"), ["z", "y", "x"])


@query
def gaussian_1d_reflect(s, d):
    return rounded(curves.smooth(_curve(s, d), 1.0, "reflect"), ["z", "y", "x"], 5)


@query
def middle_slice(s, d):
    return curves.middle_slice(_curve(s, d)).select("curve", "seq")


@query
def curve_frames(s, d):
    return rounded(curves.frames(_curve(s, d)), ["nz", "ny", "nx", "bz", "by", "bx"])


@query
def through_curves(s, d):
    from strandlake.operators.donors import through_curves as f

    return f(_curve(s, d), 70, 40.0)


# ---- nearest neighbours and fields -----------------------------------------------------------

def _points(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    g = lambda i: F.floor(F.element_at("embedding", i).cast("double") * 100).cast("int") + 100
    return e.select("vec_id", "label", g(1).alias("z"), g(2).alias("y"), g(3).alias("x"))


@query
def embedding_pairs(s, d):
    p = ranges.pairs_within(_points(s, d), 6.0, "vec_id")
    return p.select("vec_id_a", "vec_id_b", F.col("d2").cast("int").alias("d2"))


@query
def nearest_in_group(s, d):
    """Nearest point of the same label among every tenth point."""
    p = _points(s, d)
    n = ranges.nearest(p, p.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "site"), "vec_id", "site", on=["label"], cell=8.0)
    return n.select("vec_id", "site", F.col("d2").cast("int").alias("d2"))


@query
def knn8_periodic(s, d):
    """Points at one place have the same neighbours: the search runs once a place."""
    p = _points(s, d)
    places = p.select("z", "y", "x").distinct().withColumn("at", pack("z", "y", "x"))
    n = ranges.nearest(places, p.withColumnRenamed("vec_id", "site"), "at", "site", k=8, period=(200.0, 200.0, 200.0), cell=16.0)
    found = n.groupBy("at").agg(F.collect_list(F.struct("rank", "site", F.col("d2").cast("int").alias("d2"))).alias("l"))   # eight at most
    here = p.select("vec_id", pack("z", "y", "x").alias("at"))
    return here.join(found.hint("merge"), "at").select("vec_id", F.inline("l"))


@query
def separable_points(s, d):
    p = _points(s, d)
    return ranges.within_distance_anti(p.filter("vec_id % 2 = 1"), p.filter("vec_id % 2 = 0"), 6.0, "vec_id").select("vec_id")


@query
def crossing_dip(s, d):
    """Distances to the two nearest fibres within 3 voxels, and the valley they make."""
    from strandlake.operators.morph import two_nearest_curves

    fg = lift.foreground(s, d)
    t = two_nearest_curves(fg, _curve(s, d), 3.0)
    return t.select("vid", R(F.col("d1")).alias("d1"), R(F.col("d2")).alias("d2"),
                    R(1.5 * F.exp(-(F.col("d1") * F.col("d1") + F.col("d2") * F.col("d2")) / F.lit(4.5))).alias("dip"))


@query
def analytic_field(s, d):
    sk = materialize(lift.skeleton(s, d, 8))
    spine = curves.tangents(sk.select(F.col("fiber").alias("curve"), "seq", "z", "y", "x"))
    f = fields.analytic_field(lift.foreground(s, d, 8), spine, k=8, cell=10.0)
    return rounded(f.select("vid", "curve", "d1", "d2", "intensity"), ["d1", "d2", "intensity"])


@query
def spine_points(s, d):
    c = _curve(s, d)
    return rounded(fields.spine_points(c, 3, (64.0, 64.0, 64.0)), ["z", "y", "x", "tz", "ty", "tx"], 5)


@query
def rasterised_curves(s, d):
    return fields.rasterise(fields.spine_points(_curve(s, d), 3), (64, 64, 64))


@query
def augmented_volume(s, d):
    c = lift.skeleton(s, d, 8).select(F.col("fiber").alias("curve"), "seq", "z", "y", "x", F.lit(1.6).alias("r"))
    sh = extent(c)
    return fields.augmented_tubes(materialize(c), sh, factor=2)[1]   # the volume alone: no search for orientations


@query
def projected_points(s, d):
    c = curves.arc_length(_curve(s, d))
    p = lift.foreground(s, d, 3)
    return rounded(geometry.project_to_curve(p, c), ["pz", "py", "px", "arc", "d2"], 4)


@query
def flip_field(s, d):
    o = geometry.flip(lift.oriented(s, d), "x", 4096)
    return rounded(o.select("vid", "z", "y", "x", "oz", "oy", "ox"), ["oz", "oy", "ox"])


@query
def rotate_field(s, d):
    o = geometry.rotate90(lift.oriented(s, d), "y", "x", 3, 4096)
    return rounded(o.select("vid", "z", "y", "x", "oz", "oy", "ox"), ["oz", "oy", "ox"])


@query
def augmented_field(s, d):
    return geometry.augment_field(lift.oriented(s, d).withColumn("sample", F.col("fiber")), 128, 7).select(
        "sample", "seq", "z", "y", "x", *[R(F.col(f"o{c}")).alias(f"o{c}") for c in "zyx"])


@query
def augmented_curves(s, d):
    c = _curve(s, d).withColumn("block", F.floor(F.col("curve") / 8))
    return rounded(geometry.augment_curves(c), ["z", "y", "x"])


@query
def cropped_curves(s, d):
    c = materialize(_curve(s, d))
    sh = extent(c)
    blocks = 3 + c.agg(F.max("curve")).first()[0] // 8
    b = s.range(30 * blocks).select(F.floor(F.col("id") / 30).alias("block"), (F.col("id") % 30).alias("try"), *[
        F.floor(((F.col("id") * k + k) % 997) / 997.0 * (max(m - 12, 0) + 1)).cast("int").alias(f"{a}0") for a, m, k in zip("zyx", sh, (379, 521, 761))])
    return geometry.crop_curves(c, b, 12, 6, 2)


@query
def overlap_add(s, d):
    """Weighted blend of predictions that differ from window to window."""
    sk = materialize(lift.skeleton(s, d))
    sh = extent(sk)
    p = windows3d.reflect_pad(sk.select("z", "y", "x", "intensity"), sh, 16, 8)
    w = windows3d.to_windows(p, sh, 16, 8)
    w = w.withColumn("v", F.col("intensity") * (1.0 + (F.col("wz") + F.col("wy") + F.col("wx")) % 3))
    return rounded(windows3d.blend(w, sh, 16, 8, ["v"]), ["v"], 7)


@query
def sliding_predict(s, d):
    """A box predictor run on every window of the volume."""
    import numpy as np

    sk = materialize(lift.skeleton(s, d))
    return rounded(windows3d.sliding_predict(sk, extent(sk), lambda a: np.sqrt(np.clip(a, 0, None)), "intensity", 32, 16), ["c0"])


# ---- scores ----------------------------------------------------------------------------------

def _scored(s, d):
    o = lift.oriented(s, d)
    return o.select("fiber", "vid", ((F.col("seq") * 37 + F.col("fiber") * 11) % 200 / 100.0 - 1.0).alias("gt"),
                    ((F.col("seq") * 53 + F.col("fiber") * 7) % 200 / 100.0 - 1.0).alias("pred"), "oz", "oy", "ox",
                    F.col("oz").alias("pz"), (-F.col("oy")).alias("py"), F.col("ox").alias("px"), "intensity")


@query
def intensity_scores(s, d):
    r = metrics.intensity_scores(_scored(s, d))
    return rounded(r, r.columns, 5)


@query
def orientation_scores(s, d):
    r = metrics.orientation_scores(_scored(s, d), by=["fiber"])
    return rounded(r, ["ori_loss", "mean_angle_deg"], 4)


@query
def validation_average(s, d):
    r = metrics.macro_average(metrics.intensity_scores(_scored(s, d), by=["fiber"]), ["weighted_mse", "soft_dice", "dice_score"])
    return rounded(r, ["weighted_mse", "soft_dice", "dice_score"], 4)


# ---- sources ---------------------------------------------------------------------------------

def _documents(s, d):
    """Curve documents made from the event log: one per fibre and 64 events, both point encodings."""
    sk = lift.skeleton(s, d).withColumn("part", F.floor(F.col("seq") / 64))
    k = F.col("seq") % 64
    xyz = F.concat(F.lit("[["), F.concat_ws(",", *[(F.col(c) * 2.0).cast("string") for c in "xyz"]), F.lit('],"m"]'))
    pt = F.concat(F.lit('"Point'), k + 1, F.lit('":'), F.when(k % 2 == 0, xyz).otherwise(
        F.concat(F.lit('{"Coord":'), xyz, F.lit(',"Radius":[3.0,"m"]}'))))
    pts = F.sort_array(F.collect_list(F.struct((-k).alias("k"), pt.alias("t"))))   # 64 at most, last point first
    o = sk.groupBy("fiber", "part").agg(F.array_join(F.transform(pts, lambda e: e["t"]), ",").alias("t"))
    return o.select(F.concat_ws("/", "fiber", "part").alias("doc"), F.concat(
        F.lit('{"Domain":{"VoxelLength":[2.0,"m"],"LengthX":[128.0,"m"],"LengthY":[128.0,"m"],"LengthZ":[128.0,"m"]},"NumberOfObjects":1,"Object1":{"MaterialID":1,'),
        "t", F.lit("}}")).alias("text"))


@query
def gad_points(s, d):
    p = gad.parse_points(_documents(s, d))
    return p.select("doc", "object", "seq", "z", "y", "x", "r")


@query
def gad_objects(s, d):
    """Curve documents written per label: sizes and diameters."""
    p = lift.skeleton(s, d).select((F.col("fiber") * (1 << 20) + F.floor(F.col("seq") / 64)).alias("label"), (F.col("seq") % 64).alias("seq"), "z", "y", "x")
    n = stencil.dilate(lift.skeleton(s, d).select(*V, (F.col("fiber") * (1 << 20) + F.floor(F.col("seq") / 64)).alias("label")), ball_offsets(1), carry_min="label")
    o = gad.object_documents(p, metrics.label_lengths(n), 1.0)
    return o.select("label", "n_points", R(F.get_json_object("json", "$.Diameter").cast("double"), 5).alias("diameter"),
                    F.get_json_object("json", "$.Point1[0][2]").cast("double").alias("first_z"))


def _names(s, d):
    return s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("model_"), F.col("p_partkey"), F.lit("_v"), F.col("p_size"), F.lit(".tif")).alias("name"))


@query
def natural_sort(s, d):
    return discovery.natural_rank(_names(s, d))


@query
def split_train_test(s, d):
    return discovery.train_test(_names(s, d))


@query
def holdout_every_5(s, d):
    return discovery.holdout(_names(s, d))


@query
def repeated_samples(s, d):
    return discovery.repeat_rows(_names(s, d), 3).groupBy("name").agg(F.count(F.lit(1)).alias("copies"))


def _files(s, d):
    """A listing made from orders: which files exist depends on the row."""
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    k = F.concat(F.lit("model_"), F.col("o_orderkey"))
    mk = lambda cond, suf: F.when(cond, F.concat(k, F.lit(suf)))
    key = F.col("o_orderkey")
    arr = F.array_compact(F.array(mk(key % 3 != 0, "_vol.npy"), mk(key % 2 == 0, "_vol.tif"), mk(key % 5 == 0, "_intensity.npy"), mk(key % 4 == 0, "_intensity.tif"),
                                  mk(key % 3 == 1, "_centerline.npy"), mk(key % 7 != 0, "_centerline.tif"), mk(key % 11 != 0, "_ori.npy"),
                                  mk(key % 2 == 0, ".tif"), mk(key % 3 == 0, ".gad")))
    return o.select(F.explode(arr).alias("name"))


@query
def triplet_join(s, d):
    return discovery.triplets(_files(s, d))


@query
def paired_models(s, d):
    return discovery.paired_models(_files(s, d))


@query
def missing_stamps(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey")
    done = s.read.parquet(f"{d}/lineitem.parquet").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return discovery.missing(o, done, ["o_orderkey"])


@query
def patch_status(s, d):
    p = s.read.parquet(f"{d}/customer.parquet").select(discovery.normalize_patch(F.concat(F.lit("a/b/patch_"), F.col("c_custkey"), F.lit("_vol.npy"))).alias("patch"))
    st = s.read.parquet(f"{d}/orders.parquet").select(discovery.normalize_patch(F.col("o_custkey").cast("string")).alias("patch"))
    return discovery.patch_status(p, st)


@query
def masked_crops(s, d):
    from strandlake.operators.donors import masked_crops as f

    return f(_labelled_fg(s, d), 2).select("label", "z", "y", "x")


def _stamp_listing(s, d):
    """Stamp files made from lineitem: which of the three parts exist depends on the row."""
    li = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    k = F.concat(F.lit("patch_"), F.lpad(F.col("l_orderkey").cast("string"), 7, "0"), F.lit("_fiber_"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    mk = lambda cond, part: F.when(cond, F.concat(k, F.lit(f"_{part}.npy")))
    arr = F.array_compact(F.array(mk(F.lit(True), "vol"), mk(F.col("l_returnflag") != "R", "intensity"), mk(F.col("l_linestatus") == "F", "ori"),
                                  F.when(F.col("l_linenumber") == 1, F.concat(F.lit("notes_"), F.col("l_orderkey"), F.lit(".txt")))))
    return li.select("l_orderkey", "l_linenumber", F.explode(arr).alias("name"))


def _patch_key(c):
    return F.concat(F.lit("patch_"), F.lpad(F.col(c).cast("string"), 7, "0"))


@query
def stamps_to_extract(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    vox = li.select(_patch_key("l_orderkey").alias("patch"), F.col("l_linenumber").cast("int").alias("fiber"),
                    F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("l_quantity").cast("int") % 9)))).drop("col")
    return stamps.stamps_to_extract(vox, _stamp_listing(s, d))


@query
def removed_stamps(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").filter("o_orderstatus = 'F'").select(_patch_key("o_orderkey").alias("patch"))
    return stamps.without_patch_stamps(_stamp_listing(s, d).select("name"), o).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query
def cleared_stamps(s, d):
    return stamps.without_stamps(_stamp_listing(s, d).select("name"))


@query
def synced_library(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet").select(_patch_key("l_orderkey").alias("patch"), F.col("l_linenumber").cast("int").alias("fiber"), "l_returnflag", "l_linestatus", "l_orderkey")
    files = _stamp_listing(s, d).filter("l_orderkey % 3 <> 0").select("name")
    return stamps.synced_library(li.filter("l_returnflag <> 'N'"), li.filter("l_linestatus = 'F'"), files)


@query
def save_slots(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return stamps.save_slots(o.select(F.col("o_orderkey").alias("request"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("loaded")),
                             s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("index")))


@query
def patch_checks(s, d):
    pid = pack(*[F.floor(F.col(c) / 24) for c in "zyx"]).alias("patch")
    return stamps.patch_checks(_labelled_fg(s, d).select(pid, "vid", "label"), lift.skeleton(s, d).select(pid, "vid", (F.col("fiber") + 1).cast("int").alias("label")))


@query
def fiber_quality(s, d):
    from strandlake.operators.donors import through_curves as f

    return stamps.fiber_quality(f(_curve(s, d), 70, 75.0)).select("curve", "n", "valid", "reason")


@query
def intact_counts(s, d):
    from strandlake.operators.donors import through_curves as f

    return stamps.intact_counts(f(_curve(s, d), 70, 40.0).withColumn("patch", F.floor(F.col("curve") / 4)))


@query
def labels_by_volume(s, d):
    pid = pack(*[F.floor(F.col(c) / 24) for c in "zyx"]).alias("patch")
    return stamps.by_volume(_labelled_fg(s, d).select(pid, "label"), "patch")


@query
def face_coordinates(s, d):
    f = lift.skeleton(s, d).withColumn("p", stamps.face_coordinates(48)).filter("p is not null")
    return f.select("vid", "p.face", R(F.col("p.u")).alias("u"), R(F.col("p.v")).alias("v"))


@query
def opened_patch(s, d):
    """A cube asked for beyond the volume's end is moved back inside."""
    sk = materialize(lift.skeleton(s, d))
    return stamps.open_patch(sk, extent(sk), (99999, 5, 3), 24)[0].select("z", "y", "x", "fiber")


@query
def one_of_each_stem(s, d):
    return stamps.one_of_each_stem(_files(s, d), ["_vol.tif", "_vol.npy"])


@query
def first_occurrences(s, d):
    e = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("value"), F.col("o_orderkey").alias("at"))
    return stamps.first_occurrences(e, "value", "at")


@query
def metrics_report(s, d):
    return stamps.report_lines(panoptic_metrics(s, d))


@query
def decoded_field(s, d):
    """Sixteen-bit samples of the field scaled to 0..1, and whether the labels make an instance volume."""
    from strandlake.sources.voxels import rescale

    return lift.skeleton(s, d).select("vid", R(rescale(windows3d.to_uint16(F.col("intensity")), 16), 7).alias("v"))


@query
def oriented_training_windows(s, d):
    """Origins of training windows around foreground voxels, clamped to the volume; one for every eighth voxel."""
    from strandlake.operators.patches import sample_windows

    sk = materialize(lift.skeleton(s, d))
    return sample_windows(s, sk.count() // 8, extent(sk), 24, sk, 11)


# ---- kernels on bounded groups ---------------------------------------------------------------

@query
def thinned_foreground(s, d):
    from strandlake.operators.thinning import skeletonize

    return skeletonize(lift.foreground(s, d, 8))


@query
def thinning_checks(s, d):
    """What thinning must keep: the number of components; and no voxel outside the mask."""
    from strandlake.operators.thinning import skeletonize

    fg = materialize(lift.foreground(s, d, 8))
    t = skeletonize(fg)   # a barrier already
    n = components.component_boxes(components.connected_components(t)).agg(F.count(F.lit(1)).alias("n_components"))
    return n.crossJoin(F.broadcast(t.join(fg, "vid", "left_anti").agg(F.count(F.lit(1)).alias("n_outside"))))   # one row each


@query
def curve_order(s, d):
    from strandlake.operators.donors import order_points

    return order_points(lift.skeleton(s, d).select(F.col("fiber").alias("label"), "z", "y", "x"), "export", beyond=True)


def _patches(s, d, side):
    """The foreground cut into cubes: patch id and coordinates inside the patch."""
    fg = lift.foreground(s, d, 8)
    pid = pack(*[F.floor(F.col(c) / side) for c in "zyx"])
    return fg.select(pid.alias("patch"), *[(F.col(c) % side).cast("int").alias(c) for c in "zyx"])


@query
def distance_transform(s, d):
    from strandlake.operators.patches import edt

    return rounded(edt(_patches(s, d, 24), 24), ["dt"])


@query
def routed_curves(s, d):
    """One route per fibre and patch, between its first and last voxel there."""
    from strandlake.operators.patches import edt, route_seeds

    side = 12
    dt = edt(_patches(s, d, side), side)
    pid = pack(*[F.floor(F.col(c) / side) for c in "zyx"])
    sk = lift.skeleton(s, d, 8).select(pid.alias("patch"), F.col("fiber").cast("int").alias("fiber"), "seq", *[(F.col(c) % side).cast("int").alias(c) for c in "zyx"])
    g = sk.groupBy("patch", "fiber").agg(F.min(F.struct("seq", "z", "y", "x")).alias("a"), F.max(F.struct("seq", "z", "y", "x")).alias("b"))
    seeds = g.filter("a.seq < b.seq").select("patch", "fiber", F.explode(F.array("a", "b")).alias("p")).select(
        "patch", "fiber", F.col("p.seq").alias("ord"), "p.z", "p.y", "p.x", F.lit(False).alias("way"))
    return route_seeds(dt, seeds, side)


@query
def tile_routes(s, d):
    """The cheapest way along every fibre, from its first to its last voxel, through voxels of different cost."""
    from strandlake.operators.routing import least_cost_routes

    cost = lift.foreground(s, d, 8).select(F.lit(0).cast("long").alias("space"), "z", "y", "x",
                                           (200_000 + F.pmod(7 * F.col("z") + 13 * F.col("y") + 29 * F.col("x"), F.lit(17)) * 100_000).cast("long").alias("cost"))
    ends = lift.skeleton(s, d, 8).groupBy("fiber").agg(F.min_by("vid", "seq").alias("src"), F.max_by("vid", "seq").alias("dst"))
    asks = ends.select(F.col("fiber").cast("long").alias("route"), F.lit(0).cast("long").alias("space"), "src", "dst")
    return least_cost_routes(cost, asks).select("route", "seq", "vid", "dist")


@query
def refined_curves(s, d):
    """Straight curves, so that the result has a closed form: a point a unit of length from end to end."""
    from strandlake.operators.patches import refine_curves

    e = lift.skeleton(s, d, 8)
    line = e.select(F.col("fiber").alias("curve"), "seq", (F.col("seq") + 0.00001234).alias("z"), (10.00001234 + 0.5 * F.col("seq")).alias("y"),
                    (20.00001234 + 0.25 * (F.col("fiber") % 5) * F.col("seq")).alias("x"), F.lit(False).alias("pin"))
    mask = e.limit(0).select(F.col("fiber").alias("curve"), "vid", "z", "y", "x")
    return rounded(refine_curves(line, mask), ["z", "y", "x"], 4)


@query
def tiled_box(s, d):
    """The foreground written as tiles, and a box of it read back."""
    import uuid

    from strandlake.session import shared_folder
    from strandlake.sources.voxels import read_box, write_tiles

    path = f"{shared_folder(s).rstrip('/')}/strandlake/{uuid.uuid4().hex}"
    write_tiles(lift.foreground(s, d), path, 32)
    return read_box(s, path, (10, 3, 5), (40, 20, 30)).select(V)


@query
def placed_stamps(s, d):
    """Three of four fibres as stamps for a patch of sixteen, at the first of five places that keeps clear of what is there."""
    from strandlake.operators.morph import separable_offsets

    sk = materialize(lift.skeleton(s, d, 8))
    patch = F.floor(F.col("fiber") / 16).alias("patch")
    own = sk.filter("seq < 24").withColumns({"y": F.col("y") % 8, "x": F.col("x") % 8})
    stamps = own.filter("fiber % 4 <> 0").select(F.col("fiber").alias("stamp"), "z", "y", "x", F.lit(1.0).alias("intensity"))
    existing = own.filter("fiber % 4 = 0").select(patch, "z", (F.col("y") + F.col("fiber") % 16).alias("y"), (F.col("x") + 2 * (F.col("fiber") % 16)).alias("x"),
                                                  F.lit(1.0).alias("intensity"))
    tries = own.filter("fiber % 4 <> 0").select(F.col("fiber").alias("stamp"), patch, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("try")).distinct()
    tries = tries.withColumns({"z0": F.lit(0), "y0": ((7 * F.col("stamp") + 5 * F.col("try")) % 24).cast("int"), "x0": ((11 * F.col("stamp") + 13 * F.col("try")) % 40).cast("int")})
    return separable_offsets(stamps, existing, tries)


@query
def label_seeds(s, d):
    from strandlake.operators.patches import seeds_from_labels

    return seeds_from_labels(lift.skeleton(s, d).select(F.col("fiber").alias("label"), "z", "y", "x"), 96)
