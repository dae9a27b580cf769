"""Ordered-sequence operators on curves (curve id, dense 0-based seq, z, y, x).

A curve may be arbitrarily long, so no window spans one. Curves are cut into runs of ``CHUNK``
points; each run borrows the few points it needs from its neighbours, and running sums are carried
over runs by a small table of run totals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.vec3 import dot, safe, sub, vec
from strandlake.operators.lookup import salted_lookup
from strandlake.session import materialize

CHUNK = 4096
AX = ("z", "y", "x")


def neighbours_on_curve(df: DataFrame, curve: str, seq: str, cols: list[str], reach: int, chunk: int = CHUNK) -> DataFrame:
    """Adds ``<col>_m<k>`` and ``<col>_p<k>`` (k steps before and after; null beyond the ends)."""
    s = F.col(seq)
    home = F.floor(s / chunk)
    copies = F.array_compact(F.array(
        home,
        F.when(s % chunk < reach, home - 1),
        F.when(s % chunk >= chunk - reach, home + 1)))
    w = Window.partitionBy(curve, "_c").orderBy(seq)
    out = df.withColumn("_h", home).withColumn("_c", F.explode(copies))
    for k in range(1, reach + 1):
        for c in cols:
            out = out.withColumn(f"{c}_m{k}", F.lag(c, k).over(w)).withColumn(f"{c}_p{k}", F.lead(c, k).over(w))
    return out.filter("_h = _c").drop("_h", "_c")


def running_sum(df: DataFrame, curve: str, seq: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Inclusive running sum of an integer (or fixed-point) value along each curve, in three levels."""
    out = df.withColumn("_v", value).withColumn("_c", F.floor(F.col(seq) / chunk))
    w = Window.partitionBy(curve, "_c").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    tot = out.groupBy(curve, "_c").agg(F.sum("_v").alias("_t")).withColumn("_d", F.floor(F.col("_c") / chunk))
    sup = tot.groupBy(curve, "_d").agg(F.sum("_t").alias("_u"))
    wb = lambda keys, o: Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    sup = sup.select(curve, "_d", F.coalesce(F.sum("_u").over(wb([curve], "_d")), F.lit(0)).alias("_o2"))
    tot = tot.withColumn("_o1", F.coalesce(F.sum("_t").over(wb([curve, "_d"], "_c")), F.lit(0)))
    offs = tot.join(sup, [curve, "_d"]).select(curve, "_c", (F.col("_o1") + F.col("_o2")).alias("_o"))
    return (out.withColumn(name, F.sum("_v").over(w)).join(offs, [curve, "_c"])
            .withColumn(name, F.col(name) + F.col("_o")).drop("_v", "_c", "_o"))


def curve_diff(df: DataFrame, curve="curve", seq="seq") -> DataFrame:
    """First difference to the next point (the last point of a curve has none)."""
    n = neighbours_on_curve(df, curve, seq, list(AX), 1).filter(F.col("z_p1").isNotNull())
    return n.select(curve, seq, *[(F.col(f"{c}_p1") - F.col(c)).alias(f"d{c}") for c in AX])


def tangents(df: DataFrame, curve="curve", seq="seq") -> DataFrame:
    """Unit tangents: central difference, one-sided at the ends."""
    n = neighbours_on_curve(df, curve, seq, list(AX), 1)
    d = [F.coalesce(F.col(f"{c}_p1"), F.col(c)).cast("double") - F.coalesce(F.col(f"{c}_m1"), F.col(c)).cast("double") for c in AX]
    n = n.withColumns({f"t{c}": v for c, v in zip(AX, d)})
    t = vec("t")
    nn = safe(F.sqrt(dot(t, t)))
    return n.withColumn("_n", nn).select(*df.columns, *[(F.col(f"t{c}") / F.col("_n")).alias(f"t{c}") for c in AX])


def turn_cosines(df: DataFrame, curve="curve", seq="seq") -> DataFrame:
    """Cosine between consecutive steps, one row per interior point (seq of the middle point)."""
    n = neighbours_on_curve(df, curve, seq, list(AX), 1).filter(F.col("z_p1").isNotNull() & F.col("z_m1").isNotNull())
    a = [F.col(c).cast("double") - F.col(f"{c}_m1") for c in AX]
    b = [F.col(f"{c}_p1").cast("double") - F.col(c) for c in AX]
    na, nb = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-8)), F.greatest(F.sqrt(dot(b, b)), F.lit(1e-8))
    c = dot(a, b) / (na * nb)
    return n.select(curve, seq, F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)).alias("cos_turn"))


def arc_length(df: DataFrame, curve="curve", seq="seq") -> DataFrame:
    """Cumulative arc length, summed in nine-decimal fixed point."""
    n = neighbours_on_curve(df, curve, seq, list(AX), 1)
    d = [F.col(c).cast("double") - F.coalesce(F.col(f"{c}_m1"), F.col(c)) for c in AX]
    step = F.bround(F.sqrt(dot(d, d)) * F.lit(1e9)).cast("long")
    n = running_sum(n.select(*df.columns, step.alias("_step")), curve, seq, F.col("_step"), "_arc")
    return n.select(*df.columns, (F.col("_arc") / F.lit(1e9)).alias("arc"))


def curve_lengths(df: DataFrame, curve="curve", seq="seq") -> DataFrame:
    return df.groupBy(curve).agg(F.count(F.lit(1)).alias("n"))


def densify(df: DataFrame, factor: int, curve="curve", seq="seq", cols=AX) -> DataFrame:
    """``n * factor`` points per curve, evenly spaced in the index parameter from 0 to n-1.

    Output i sits at t = i (n-1) / (m-1); the source segment with floor(t) = s makes it. Index
    arithmetic is integer, so both ends are hit exactly.
    """
    n = neighbours_on_curve(df, curve, seq, list(cols), 1)
    n = salted_lookup(n, curve_lengths(df, curve, seq), [curve], [seq], "inner")
    n = n.withColumns({"_m1": F.col("n") * factor - 1, "_n1": F.greatest(F.col("n") - 1, F.lit(1))})
    up = lambda k: F.expr(f"({k} * _m1 + _n1 - 1) div _n1")
    s = seq
    i0 = F.when(F.col("n") == 1, F.lit(0)).when(F.col(s) == F.col("n") - 1, F.col("_m1")).otherwise(up(s))
    i1 = F.when(F.col(s) == F.col("n") - 1, F.col("_m1")).otherwise(F.least(up(f"({s} + 1)") - 1, F.col("_m1") - 1))
    n = n.withColumns({"_i0": i0.cast("long"), "_i1": i1.cast("long")}).filter("_i0 <= _i1")
    n = n.withColumn("i", F.explode(F.sequence("_i0", "_i1")))
    t = (F.col("i") * F.col("_n1") - F.col(s) * F.col("_m1")).cast("double") / F.greatest(F.col("_m1"), F.lit(1)).cast("double")
    t = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(t)
    return n.select(curve, F.col("i").alias(seq), *[
        (F.col(c).cast("double") + (F.coalesce(F.col(f"{c}_p1"), F.col(c)).cast("double") - F.col(c).cast("double")) * t).alias(c)
        for c in cols])


def resample_unit(df: DataFrame, curve="curve", seq="seq") -> DataFrame:
    """Even resampling by arc length: ceil(L) + 1 points, so steps of about one voxel.

    A sample belongs to the segment whose arc interval holds it, so each segment makes its own.
    """
    a = arc_length(df, curve, seq)
    total = a.groupBy(curve).agg(F.max("arc").alias("_len"))
    n = neighbours_on_curve(a, curve, seq, [*AX, "arc"], 1)
    n = salted_lookup(n, total, [curve], [seq], "inner").filter("_len > 0")
    n = n.withColumn("_m", F.ceil("_len")).withColumn("_h", F.col("_len") / F.col("_m"))
    last = F.col("z_p1").isNull()
    k0 = F.when(last, F.col("_m")).otherwise(F.ceil(F.col("arc") / F.col("_h")))
    k1 = F.when(last, F.col("_m")).otherwise(F.least(F.ceil(F.col("arc_p1") / F.col("_h")) - 1, F.col("_m") - 1))
    n = n.withColumns({"_k0": k0, "_k1": k1}).filter("_k0 <= _k1").withColumn("k", F.explode(F.sequence("_k0", "_k1")))
    t = F.when(last, F.lit(0.0)).otherwise(
        (F.col("k") * F.col("_h") - F.col("arc")) / F.greatest(F.col("arc_p1") - F.col("arc"), F.lit(1e-12)))
    return n.select(curve, F.col("k").cast("long").alias(seq), *[
        (F.col(c) + (F.coalesce(F.col(f"{c}_p1"), F.col(c)) - F.col(c)) * t).alias(c) for c in AX])


def runs_in_box(df: DataFrame, lo, hi, curve="curve", seq="seq") -> DataFrame:
    """Maximal runs of consecutive points inside a half-open box: (curve, run, first, last, n).

    A run starts where the previous point is outside; the running sum of starts numbers the runs.
    """
    inside = None
    for c, a, b in zip(AX, lo, hi):
        k = (F.col(c) >= a) & (F.col(c) < b)
        inside = k if inside is None else inside & k
    m = neighbours_on_curve(df.select(curve, seq, inside.alias("inside")), curve, seq, ["inside"], 1)
    m = m.withColumn("start", (F.col("inside") & ~F.coalesce(F.col("inside_m1"), F.lit(False))).cast("long"))
    r = running_sum(m, curve, seq, F.col("start"), "run").filter("inside")
    return r.groupBy(curve, "run").agg(
        F.min(seq).alias("first"), F.max(seq).alias("last"), F.count(F.lit(1)).alias("n"))


def smooth(df: DataFrame, sigma: float, mode: str = "nearest", curve="curve", seq="seq") -> DataFrame:
    """1-D Gaussian along each curve. Ends: ``nearest`` repeats the end point, ``reflect`` mirrors it.

    Points are scattered to the 2R+1 positions they contribute to; mirrored or repeated positions fold
    back onto the end they belong to. Weighted sums use fixed point of eleven decimals.
    """
    from strandlake.operators.stencil import gaussian_weights

    w = gaussian_weights(sigma)
    r = len(w) // 2
    sizes = curve_lengths(df, curve, seq)
    base = salted_lookup(df.select(curve, seq, *AX), sizes, [curve], [seq], "inner")
    if mode == "nearest":
        n = neighbours_on_curve(base, curve, seq, list(AX), r)
        outs = []
        for c in AX:
            acc = F.col(c).cast("double") * w[r]
            left, right = F.col(c), F.col(c)
            for k in range(1, r + 1):
                left, right = F.coalesce(F.col(f"{c}_m{k}"), left), F.coalesce(F.col(f"{c}_p{k}"), right)
                acc = acc + (left.cast("double") + right.cast("double")) * w[r + k]
            outs.append(acc.alias(c))
        return n.select(curve, seq, *outs)
    d = F.explode(F.array(*[F.struct(F.lit(k - r).alias("d"), F.lit(w[k]).alias("w")) for k in range(2 * r + 1)]))
    img = F.explode(F.array_compact(F.array(
        F.col(seq), F.when(F.col(seq) < r, -1 - F.col(seq)), F.when(F.col(seq) >= F.col("n") - r, 2 * F.col("n") - 1 - F.col(seq)))))
    m = base.withColumn("_p", img).withColumn("_o", d).withColumn("_t", F.col("_p") + F.col("_o.d"))
    m = m.filter((F.col("_t") >= 0) & (F.col("_t") < F.col("n")))
    g = m.groupBy(curve, F.col("_t").alias(seq)).agg(*[
        F.sum(F.bround(F.col(c).cast("double") * F.col("_o.w") * 1e11).cast("long")).alias(c) for c in AX])
    return g.select(curve, seq, *[(F.col(c) / F.lit(1e11)).alias(c) for c in AX])


def middle_slice(df: DataFrame, fraction: float = 0.06, at_least: int = 3, curve="curve", seq="seq") -> DataFrame:
    """Drops ``max(at_least, int(fraction * n))`` points at either end."""
    b = salted_lookup(df, curve_lengths(df, curve, seq), [curve], [seq], "inner")
    k = F.greatest(F.lit(at_least), F.floor(F.col("n") * fraction))
    return b.filter((F.col(seq) >= k) & (F.col(seq) < F.col("n") - k)).drop("n")


# ---- rotation-minimising frames -------------------------------------------------------------

def _step_matrices(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The linear map that carries the normal from point i to i+1 (two reflections), for all i; a repeated point keeps its frame."""
    eye = np.eye(3)
    v1 = p[1:] - p[:-1]
    c1 = np.einsum("ij,ij->i", v1, v1)
    same = c1 < 1e-8
    c1 = np.where(same, 1.0, c1)
    r1 = eye - 2.0 * v1[:, :, None] * v1[:, None, :] / c1[:, None, None]
    v2 = t[1:] - np.einsum("nij,nj->ni", r1, t[:-1])
    c2 = np.einsum("ij,ij->i", v2, v2)
    flat = c2 < 1e-8
    r2 = eye - 2.0 * v2[:, :, None] * v2[:, None, :] / np.where(flat, 1.0, c2)[:, None, None]
    r2[flat] = eye
    out = np.einsum("nij,njk->nik", r2, r1)
    out[same] = eye
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, first row of each group) of sorted batches, many groups at a time; a group that a batch cuts waits for the next one."""
    held: list[pa.RecordBatch] = []

    def split(frame: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(frame), bool)
        new[:1] = True
        for k in keys:
            v = frame[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        ends = [[x.column(x.schema.get_field_index(k))[i].as_py() for k in keys] for x, i in ((held[0], 0), (batch, batch.num_rows - 1))]
        if ends[0] == ends[1]:
            continue   # one group so far
        table = pa.Table.from_batches(held)
        frame = table.to_pandas()
        at = split(frame)
        yield frame.iloc[:at[-1]], at[:-1]
        held = table.slice(int(at[-1])).to_batches()
    if held:
        frame = pa.Table.from_batches(held).to_pandas()
        yield frame, split(frame)


def in_runs(df: DataFrame, f: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, keys: list[str]) -> DataFrame:
    """What f makes of whole groups, sorted by ``keys`` and seq. Tasks stream their groups: short ones share a call, so none costs one of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame, at in whole_groups(batches, keys):
            yield from pa.Table.from_pandas(f(frame, at), preserve_index=False).to_batches()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, "seq").mapInArrow(run, schema)


def _carried(frame: pd.DataFrame, at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``start`` (a matrix a run) carried along every run: one value a row. Runs advance side by side."""
    m = np.empty((len(frame), 3, 3))
    if len(frame) > 1:
        m[1:] = _step_matrices(frame[["z", "y", "x"]].to_numpy(float), frame[["tz", "ty", "tx"]].to_numpy(float))
    size = np.diff(np.append(at, len(frame)))
    order = np.argsort(-size, kind="stable")
    first, many = at[order], np.searchsorted(-size[order], -np.arange(1, size.max() + 1), "right")
    out = np.empty((len(frame), 3, start.shape[2]))
    out[at] = start
    for i in range(1, int(size.max())):
        row = first[:many[i]] + i   # the runs that are at least i + 1 long
        out[row] = m[row] @ out[row - 1]
    return out


def _run_products(frame: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
    last = np.append(at[1:], len(frame)) - 1
    prod = _carried(frame, at, np.broadcast_to(np.eye(3), (len(at), 3, 3)))[last]
    return pd.DataFrame({"curve": frame["curve"].to_numpy()[at], "c": frame["c"].to_numpy()[at], "m": list(prod.reshape(-1, 9))})


def _run_frames(frame: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
    starts = frame["start"].iloc[at]
    known = starts.notna().to_numpy()   # a curve without its first point has no frames
    n = _carried(frame, at, np.stack([np.asarray(v, float) if k else np.zeros(3) for v, k in zip(starts, known)])[:, :, None])[:, :, 0]
    t = frame[["tz", "ty", "tx"]].to_numpy(float)
    n -= np.einsum("ij,ij->i", n, t)[:, None] * t
    n /= np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-8)
    b = np.cross(t, n)
    p = frame[["z", "y", "x"]].to_numpy(float)
    inside = np.ones(len(frame), bool)
    inside[at] = False
    for i in np.flatnonzero((((p[1:] - p[:-1]) ** 2).sum(1) < 1e-8) & inside[1:]):
        n[i + 1], b[i + 1] = n[i], b[i]
    one = at[(np.diff(np.append(at, len(frame))) == 1) & (frame["seq"].to_numpy()[at] == 0)]   # a curve of one point has no tangent: a fixed frame
    n[one], b[one] = (0.0, 1.0, 0.0), (1.0, 0.0, 0.0)
    keep = (frame["home"] == frame["c"]).to_numpy() & np.repeat(known, np.diff(np.append(at, len(frame))))
    out = pd.DataFrame({"curve": frame["curve"].to_numpy(), "seq": frame["seq"].to_numpy(), "nz": n[:, 0], "ny": n[:, 1], "nx": n[:, 2],
                        "bz": b[:, 0], "by": b[:, 1], "bx": b[:, 2]})
    return out[keep]


def _prefix_starts(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("c")
    cur = np.asarray(pdf["n0"].iloc[0], float)
    starts = []
    for m in pdf["m"]:
        cur = np.asarray(m).reshape(3, 3) @ cur
        starts.append(cur.tolist())
    return pd.DataFrame({"curve": pdf["curve"], "c": pdf["c"] + 1, "start": starts})   # the starts of the runs that follow


def frames(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rotation-minimising frame (curve, seq, n*, b*) of curves (curve, seq, z, y, x).

    The normal is carried from point to point by a linear map, and linear maps compose: runs of
    ``chunk`` points are reduced to one matrix each, matrices are folded along the curve (one row per
    run), and every run is then filled in from its own start.
    """
    t = tangents(df.filter("curve is not null").select("curve", F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("double").alias(c) for c in AX]))
    t0 = vec("t")
    # the start normal is the cross product of the first tangent with the first axis, or the second where the first is nearly along it
    along = F.abs(t0[0]) >= 0.9
    n0 = [F.when(along, -t0[2]).otherwise(F.lit(0.0)), F.when(along, F.lit(0.0)).otherwise(t0[2]), F.when(along, t0[0]).otherwise(-t0[1])]
    nn = safe(F.sqrt(dot(n0, n0)))
    t = materialize(t.withColumn("home", F.floor(F.col("seq") / chunk)).withColumn("n0", F.when(F.col("seq") == 0, F.array(*[v / nn for v in n0]))))
    # a run ends with the first point of the next one, so that its product covers the joint
    joint = (F.col("seq") % chunk == 0) & (F.col("seq") > 0)
    joined = t.withColumn("c", F.explode(F.array_compact(F.array(F.col("home"), F.when(joint, F.col("home") - 1)))))
    # only a run that another follows needs a product: none where curves are short
    followed = t.filter(joint).select("curve", (F.col("home") - 1).alias("c"))
    prods = in_runs(joined.drop("n0").join(followed, ["curve", "c"], "left_semi"), _run_products, f"curve {_ty(df)}, c long, m array<double>", ["curve", "c"])
    starts = prods.join(t.filter("seq = 0").select("curve", "n0"), "curve").groupBy("curve").applyInPandas(
        _prefix_starts, f"curve {_ty(df)}, c long, start array<double>")
    joined = joined.join(starts, ["curve", "c"], "left").withColumn("start", F.coalesce("start", "n0"))
    return in_runs(joined.drop("n0"), _run_frames, f"curve {_ty(df)}, seq long, nz double, ny double, nx double, bz double, by double, bx double", ["curve", "c"])


def _ty(df: DataFrame) -> str:
    return df.schema["curve"].dataType.simpleString()
