"""Label statistics, agreement with ground truth, and field scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.vec3 import clip, dot, norm, vec


def label_lengths(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def length_summary(lengths: DataFrame, n: str = "n") -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n_labels"), F.sum(n).alias("total"),
                       (F.sum(n) / F.count(F.lit(1))).alias("mean_length"), F.max(n).alias("max_length"))


HISTOGRAM_EDGES = 40


def length_histogram(lengths: DataFrame, n: str = "n", edges: int = HISTOGRAM_EDGES) -> DataFrame:
    """Counts in ``edges - 1`` bins, evenly spaced in the logarithm from max(1, min) to max + 1.

    The range is one row, computed by a scalar aggregate; nothing else leaves the executors.
    """
    r = lengths.agg(F.greatest(F.min(n), F.lit(1)).cast("double").alias("lo"), (F.max(n) + 1).cast("double").alias("hi"))
    j = lengths.crossJoin(F.broadcast(r))
    pos = (F.log10(F.col(n).cast("double")) - F.log10("lo")) / (F.log10("hi") - F.log10("lo")) * (edges - 1)
    b = F.least(F.floor(pos + 1e-9), F.lit(edges - 2)).cast("int")
    return j.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def overlap_matrix(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(g, p, n): voxels shared by each ground-truth and predicted label."""
    a = gt.select("vid", F.col("label").alias("g"))
    return a.join(pred.select("vid", F.col("label").alias("p")), "vid").groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))


def panoptic(gt: DataFrame, pred: DataFrame, iou_threshold: float = 0.5) -> DataFrame:
    """One row of detection and segmentation metrics.

    Best prediction of a truth label: largest overlap, ties to the smaller id. ``rq_gt`` divides by
    the number of truth labels. A merge is an unmatched prediction that touches several truth labels.
    """
    ov = overlap_matrix(gt, pred)
    gs = label_lengths(gt).select(F.col("label").alias("g"), F.col("n").alias("ng"))
    ps = label_lengths(pred).select(F.col("label").alias("p"), F.col("n").alias("np"))
    best = ov.groupBy("g").agg(F.max(F.struct("n", (-F.col("p")).alias("mp"))).alias("b"), F.count(F.lit(1)).alias("k"))
    best = best.select("g", (-F.col("b.mp")).alias("p"), F.col("b.n").alias("n"), "k").join(ps, "p")
    t = gs.join(best, "g", "left")
    iou = F.col("n") / F.greatest(F.col("ng") + F.col("np") - F.col("n"), F.lit(1))
    t = t.withColumn("iou", iou).withColumn("hit", F.coalesce(F.col("iou") >= iou_threshold, F.lit(False)))
    per_gt = t.agg(
        F.count(F.lit(1)).alias("n_gt"),
        F.count_if("hit").alias("matched"),
        F.count_if(~F.col("hit") & (F.coalesce("k", F.lit(0)) > 1)).alias("split"),
        F.count_if(~F.col("hit") & (F.coalesce("k", F.lit(0)) <= 1)).alias("missing"),
        (F.sum(F.when(F.col("hit"), F.bround(F.col("iou") * 1e9).cast("long"))) / F.lit(1e9)).alias("iou_sum"))
    free = ov.join(t.filter("hit").select("p").distinct(), "p", "left_anti").groupBy("p").agg(F.count(F.lit(1)).alias("k"))
    merges = free.agg(F.count_if(F.col("k") > 1).alias("merge"))
    n_pred = ps.agg(F.count(F.lit(1)).alias("n_pred"))
    r = per_gt.crossJoin(merges).crossJoin(n_pred)   # three one-row tables
    sq = F.coalesce(F.col("iou_sum") / F.greatest(F.col("matched"), F.lit(1)), F.lit(0.0))
    rq = F.col("matched") / F.greatest(F.col("n_gt"), F.lit(1))
    return r.select("n_gt", "n_pred", "matched", "split", "merge", "missing",
                    sq.alias("mean_iou"), sq.alias("sq"), rq.alias("rq_gt"), (sq * rq).alias("pq"),
                    F.when(F.col("n_gt") == 0, "no ground truth").alias("error"))


def intensity_scores(df: DataFrame, pred: str = "pred", gt: str = "gt", by: list[str] | None = None,
                     n_voxels: int | None = None, eps: float = 1e-8) -> DataFrame:
    """Weighted squared error, soft and binary Dice, and the negative-valley term.

    Rows may be sparse: a voxel with pred = gt = 0 adds nothing but its weight of 1, so ``n_voxels``
    (per group) restores the exact mean; left out, the rows given are taken to be all voxels.
    """
    p, g = F.col(pred).cast("double"), F.col(gt).cast("double")
    fg = F.when(F.abs(g) > 0.05, 1.0).otherwise(0.0)
    w = 1.0 + 3.0 * fg + 4.0 * F.when(g > 0.30, 1.0).otherwise(0.0)
    pp, pg = F.greatest(p, F.lit(0.0)), F.greatest(g, F.lit(0.0))
    np_, ng = F.greatest(-p, F.lit(0.0)) * fg, F.greatest(-g, F.lit(0.0))
    bp, bg = F.when(pp > 0.30, 1).otherwise(0), F.when(pg > 0.30, 1).otherwise(0)
    grouped = df.groupBy(*by) if by else df.groupBy()
    a = grouped.agg(
        F.count(F.lit(1)).alias("k"), F.sum((p - g) * (p - g) * w).alias("se"), F.sum(w).alias("w"),
        F.sum(pp * pg).alias("pi"), F.sum(pp * pp).alias("pe"), F.sum(pg * pg).alias("ge"),
        F.sum(bp * bg).alias("bi"), F.sum(bp).alias("bp"), F.sum(bg).alias("bg"),
        F.sum(np_ * ng).alias("ni"), F.sum(np_ * np_).alias("npe"), F.sum(ng * ng).alias("nge"), F.sum(np_).alias("nps"))
    extra = (F.lit(float(n_voxels)) - F.col("k")) if n_voxels else F.lit(0.0)
    total = F.lit(float(n_voxels)) if n_voxels else F.col("k").cast("double")
    soft = (2.0 * F.col("pi") + eps) / (F.col("pe") + F.col("ge") + eps)
    nsoft = (2.0 * F.col("ni") + eps) / (F.col("npe") + F.col("nge") + eps)
    some = F.col("nge") > 1e-4
    mse = F.col("se") / (F.col("w") + extra)
    neg = F.when(some, F.col("nge") / (F.col("ge") + eps) * (1.0 - nsoft)).otherwise(F.col("npe") / total)
    return a.select(
        *(by or []), mse.alias("weighted_mse"), soft.alias("soft_dice"), (1.0 - soft).alias("dice_loss"),
        ((2.0 * F.col("bi") + eps) / (F.col("bp") + F.col("bg") + eps)).alias("dice_score"), neg.alias("neg_loss"),
        F.when(some, nsoft).when(F.col("nps") < 1e-4, 1.0).otherwise(0.0).alias("neg_soft_dice"),
        (mse + (1.0 - soft) + neg).alias("loss_total"))


def orientation_scores(df: DataFrame, pred: str = "p", gt: str = "o", intensity: str = "intensity",
                       by: list[str] | None = None, floor: float = 0.10) -> DataFrame:
    """Weighted 1 - |cos| and the angle of the weighted mean |cos|, in degrees."""
    a, b = vec(pred), vec(gt)
    d = clip(F.abs(dot(a, b)), 0.0, 1.0)
    valid = F.when(norm(b) > 1e-4, 1.0).otherwise(0.0)
    w = clip(F.abs(F.col(intensity)) + floor * valid, 0.0, 1.0) * valid
    grouped = df.groupBy(*by) if by else df.groupBy()
    s = grouped.agg(F.sum(w).alias("w"), F.sum(w * (1.0 - d)).alias("l"), F.sum(w * d).alias("d"))
    ok = F.col("w") > 0
    den = F.when(ok, F.col("w")).otherwise(1.0)
    return s.select(*(by or []), F.when(ok, F.col("l") / den).otherwise(0.0).alias("ori_loss"),
                    F.when(ok, F.acos(clip(F.col("d") / den, 0.0, 1.0)) * (180.0 / math.pi)).otherwise(0.0).alias("mean_angle_deg"))


def macro_average(scores: DataFrame, cols: list[str]) -> DataFrame:
    """Unweighted mean of per-volume scores."""
    return scores.agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n_volumes"))
