"""Branches between junctions, and the removal of short cross links.

A branch voxel has at most two neighbours, and the ones outside its branch are junction voxels; hence
a branch touches at most two junction clusters. Every rule below is linear in the number of branches
because of that: neighbourhoods of a cluster are summed once, never paired up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.vec3 import dot, fixed, norm, safe, unfixed, unit, vec
from strandlake.grid import zyx
from strandlake.operators.components import connected_components
from strandlake.operators.lookup import salted_lookup
from strandlake.operators.stencil import JUNCTION_DEGREE, degree, stencil
from strandlake.params import Params
from strandlake.session import materialize

RUNG_ALIGNMENT = 0.60   # fixed value of rule (b)


def branches_and_clusters(skel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(branch voxels with ``branch``, junction voxels with ``cluster``); ids are smallest voxel ids."""
    # one run for both: voxels connect only to voxels of their own kind
    kind = degree(skel).select("vid", "z", "y", "x", (F.col("deg") >= JUNCTION_DEGREE).cast("int").alias("junction"))
    cc = materialize(connected_components(kind, same="junction"))
    return (cc.filter("junction = 0").drop("junction").withColumnRenamed("comp", "branch"),
            cc.filter("junction = 1").drop("junction").withColumnRenamed("comp", "cluster"))


def branch_stats(branches: DataFrame, field: DataFrame | None = None) -> DataFrame:
    """Per branch: size, first and last voxel in raster order, mean orientation (unit; zero if none)."""
    if field is None:
        return branches.groupBy("branch").agg(
            F.count(F.lit(1)).alias("n"), F.min("vid").alias("first_vid"), F.max("vid").alias("last_vid"))
    b = branches.select("branch", "vid").join(field.select("vid", "oz", "oy", "ox"), "vid", "left")
    g = b.groupBy("branch").agg(
        F.count(F.lit(1)).alias("n"), F.min("vid").alias("first_vid"), F.max("vid").alias("last_vid"),
        *[F.coalesce(F.sum(fixed(F.col(f"o{c}"))), F.lit(0)).alias(f"s{c}") for c in ("z", "y", "x")])
    m = [unfixed(F.col(f"s{c}")) / F.col("n") for c in ("z", "y", "x")]
    u = unit(m)
    return g.select("branch", "n", "first_vid", "last_vid", *[v.alias(f"m{c}") for v, c in zip(u, ("z", "y", "x"))])


def branch_chords(stats: DataFrame) -> DataFrame:
    """Adds the chord (last minus first voxel, in raster order) and its length."""
    a, b = zyx("first_vid"), zyx("last_vid")
    d = [q - p for p, q in zip(a, b)]
    return stats.withColumns({"cz": d[0], "cy": d[1], "cx": d[2]}).withColumn(
        "chord", F.sqrt((F.col("cz") * F.col("cz") + F.col("cy") * F.col("cy") + F.col("cx") * F.col("cx")).cast("double")))


def branch_touch(branches: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct (branch, cluster) pairs where a branch voxel is a 26-neighbour of a junction voxel."""
    b = branches.select("vid", "z", "y", "x", "branch", F.lit(None).cast("long").alias("cluster"))
    c = clusters.select("vid", "z", "y", "x", F.lit(None).cast("long").alias("branch"), "cluster")
    s = stencil(b.union(c), [F.collect_set("branch").alias("bs"), F.max(F.when(F.col("is_self"), F.col("cluster"))).alias("cluster")],
                ["branch", "cluster"])
    return s.filter("cluster is not null").select(F.explode("bs").alias("branch"), "cluster").distinct()


def branch_clusters(touch: DataFrame) -> DataFrame:
    """One row per touching branch: number of clusters, the smaller (c1) and the larger one (c2)."""
    return touch.groupBy("branch").agg(
        F.count(F.lit(1)).alias("n_clusters"), F.min("cluster").alias("c1"), F.max("cluster").alias("c2"))


def adjacency_degree(touch: DataFrame) -> DataFrame:
    """Number of distinct other branches that share a junction cluster, per branch.

    |N(c1) + N(c2)| by inclusion and exclusion, instead of listing the pairs.
    """
    size = touch.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    two = branch_clusters(touch)
    both = two.filter("n_clusters = 2").groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n12"))
    t = salted_lookup(two, size.select(F.col("cluster").alias("c1"), F.col("n").alias("n1")), ["c1"], ["branch"])
    t = salted_lookup(t, size.select(F.col("cluster").alias("c2"), F.col("n").alias("n2")), ["c2"], ["branch"])
    t = salted_lookup(t, both, ["c1", "c2"], ["branch"])
    one = F.col("n1") - 1
    pair = F.col("n1") + F.col("n2") - F.coalesce("n12", F.lit(0)) - 1
    return t.select("branch", F.when(F.col("n_clusters") == 1, one).otherwise(pair).alias("n_adjacent"))


def severed_branches(branches: DataFrame, clusters: DataFrame, field: DataFrame, p: Params = Params()) -> DataFrame:
    """Branches to remove, with the rule that fired (tiny, misaligned, perpendicular)."""
    if p.max_rung_length >= p.min_neighbor_length:
        raise ValueError("max_rung_length must be below min_neighbor_length")
    stats = materialize(branch_chords(branch_stats(branches, field)))
    touch = materialize(branch_touch(branches, clusters))
    two = branch_clusters(touch)
    short = stats.filter(F.col("n") <= p.max_rung_length).join(two, "branch", "left").fillna(0, ["n_clusters"])

    long = stats.filter(F.col("n") >= p.min_neighbor_length).select(F.col("branch").alias("lb"), *[F.col(f"m{c}").alias(f"l{c}") for c in "zyx"])
    ltouch = touch.withColumnRenamed("branch", "lb").join(long, "lb")
    # the first long neighbour of each cluster sets the sign convention there
    first = ltouch.groupBy("cluster").agg(F.min(F.struct("lb", "lz", "ly", "lx")).alias("f"))

    cand = short.filter("n_clusters > 0 and chord >= 1").select("branch", "c1", "c2")
    cand = salted_lookup(cand, first.select(F.col("cluster").alias("c1"), F.col("f").alias("f1")), ["c1"], ["branch"])
    cand = salted_lookup(cand, first.select(F.col("cluster").alias("c2"), F.col("f").alias("f2")), ["c2"], ["branch"])
    cand = cand.withColumn("f", F.least("f1", "f2")).filter("f is not null").select("branch", "c1", "c2", "f")
    cand = materialize(cand)

    sgn = lambda: F.when(dot(vec("l"), [F.col("f.lz"), F.col("f.ly"), F.col("f.lx")]) < 0, -1.0).otherwise(1.0)
    sums = lambda: [F.sum(fixed(sgn() * F.col(f"l{c}"))).alias(f"s{c}") for c in "zyx"] + [F.count(F.lit(1)).alias("k")]
    # signed sum of a cluster's long branches for each reference that is asked for
    asks = cand.select(F.explode(F.array("c1", "c2")).alias("cluster"), "f").distinct()
    per = asks.join(ltouch, "cluster").groupBy("cluster", "f").agg(*sums())
    # branches that touch both clusters were counted twice
    lboth = ltouch.groupBy("lb", "lz", "ly", "lx").agg(F.count(F.lit(1)).alias("m"), F.min("cluster").alias("c1"), F.max("cluster").alias("c2")).filter("m = 2")
    dup = cand.filter("c1 <> c2").select("c1", "c2", "f").distinct().join(lboth, ["c1", "c2"]).groupBy("c1", "c2", "f").agg(*sums())

    ren = lambda df, s, keys: df.select(*keys, *[F.col(v).alias(f"{v}_{s}") for v in ("sz", "sy", "sx", "k")])
    t = salted_lookup(cand, ren(per.withColumnRenamed("cluster", "c1"), "a", ["c1", "f"]), ["c1", "f"], ["branch"])
    t = salted_lookup(t, ren(per.withColumnRenamed("cluster", "c2"), "b", ["c2", "f"]), ["c2", "f"], ["branch"])
    t = salted_lookup(t, ren(dup, "d", ["c1", "c2", "f"]), ["c1", "c2", "f"], ["branch"])
    z0 = lambda c: F.coalesce(F.col(c), F.lit(0))
    other = lambda v: F.when(F.col("c1") == F.col("c2"), F.lit(0)).otherwise(z0(f"{v}_b") - z0(f"{v}_d"))
    trunk = t.select("branch", *[(z0(f"{v}_a") + other(v)).alias(v) for v in ("sz", "sy", "sx", "k")])

    s = short.join(trunk, "branch", "left")
    rd = [F.col(c) / safe(F.col("chord"), 0.5) for c in ("cz", "cy", "cx")]
    m = vec("m")
    has = norm(m) > 1e-8
    own = [F.when(has, a).otherwise(F.lit(b)) for a, b in zip(m, (1.0, 0.0, 0.0))]
    align = F.abs(dot(rd, own))
    mean = [unfixed(F.coalesce(F.col(c), F.lit(0))) / F.greatest(F.coalesce(F.col("k"), F.lit(1)), F.lit(1)) for c in ("sz", "sy", "sx")]
    tn = norm(mean)
    talign = F.abs(dot(rd, [v / safe(tn) for v in mean]))
    rule = (
        F.when(F.col("chord") < 1, F.when(F.col("n_clusters") >= 1, F.lit("tiny")))
        .when((F.col("n_clusters") >= 2) & (align < RUNG_ALIGNMENT), F.lit("misaligned"))
        .when((F.coalesce(F.col("k"), F.lit(0)) > 0) & (tn > 1e-8) & ((1.0 - talign) > p.perp_thresh), F.lit("perpendicular")))
    return s.select("branch", F.col("n").cast("int").alias("n"), rule.alias("rule")).filter("rule is not null")


def sever(skel: DataFrame, field: DataFrame, p: Params = Params()) -> DataFrame:
    """The skeleton without the voxels of severed branches; junction voxels stay."""
    b, c = branches_and_clusters(skel)
    b, c = materialize(b), materialize(c)
    gone = severed_branches(b, c, field, p)
    cols = ["vid", "z", "y", "x"]
    return b.join(gone.select("branch"), "branch", "left_anti").select(cols).union(c.select(cols))
