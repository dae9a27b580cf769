"""Labelled skeletons: fragments in their chain's label, bridges drawn as voxel lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.grid import pack, zyx
from strandlake.operators.lookup import salted_lookup
from strandlake.operators.stencil import dealt


def voxel_lines(df: DataFrame, start: str, end: str, keep: list[str]) -> DataFrame:
    """Voxels of the straight line between two voxel ids, both included, one per step of the longest axis."""
    a, b = [c.cast("int") for c in zyx(start)], [c.cast("int") for c in zyx(end)]
    t = df.select(*keep, *[v.alias(f"a{k}") for v, k in zip(a, "zyx")], *[v.alias(f"b{k}") for v, k in zip(b, "zyx")])
    n = F.greatest(*[F.abs(F.col(f"b{k}") - F.col(f"a{k}")) for k in "zyx"])
    t = t.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    f = F.col("i") / F.greatest(F.col("n"), F.lit(1)).cast("double")
    pos = [F.bround(F.col(f"a{k}") + f * (F.col(f"b{k}") - F.col(f"a{k}"))).cast("int").alias(k) for k in "zyx"]
    t = t.select(*keep, "i", *pos)
    return t.withColumn("vid", pack("z", "y", "x"))


def overlay(df: DataFrame, value: str, priority: list[str]) -> DataFrame:
    """One value per voxel: that of the row with the highest priority (the last writer)."""
    return dealt(df, "vid").groupBy("vid").agg(F.max_by(value, F.struct(*priority)).alias(value))


def labelled_skeleton(fv: DataFrame, members: DataFrame, ranked: DataFrame, bridges: DataFrame) -> DataFrame:
    """vid, z, y, x, label. Fragments first, bridge lines over them, later labels over earlier ones."""
    lab = members.join(ranked.select("root", "label"), "root").select("frag", "label")
    body = salted_lookup(fv.select("vid", "frag"), lab, ["frag"], ["vid"], "inner").select(
        "vid", "label", F.lit(0).alias("layer"))
    lines = voxel_lines(bridges.join(lab.withColumnRenamed("frag", "frag_a"), "frag_a"), "vid_a", "vid_b", ["label"])
    both = body.union(lines.select("vid", "label", F.lit(1).alias("layer")))
    out = overlay(both, "label", ["layer", "label"])
    return out.select("vid", *zyx("vid"), F.col("label").cast("int").alias("label"))
