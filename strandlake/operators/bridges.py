"""Bridge candidates: pairs of fragment ends within reach that point at each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.vec3 import dot, fixed, safe, unfixed, unit, vec
from strandlake.grid import pack
from strandlake.operators.costs import bridge_cost
from strandlake.operators.ranges import pairs_within
from strandlake.params import Params
from strandlake.session import materialize


def end_pairs(ends: DataFrame, max_gap: float) -> DataFrame:
    """Pairs of ends of different fragments within a closed ball; a is the earlier (frag, end)."""
    e = ends.withColumn("ek", F.struct("frag", "end"))
    extra = [c for c in ends.columns if c not in ("z", "y", "x")]
    return pairs_within(e, max_gap, "ek", extra=extra).filter("frag_a <> frag_b").drop("ek_a", "ek_b")


def gap_samples(n: int, lo: float = 0.15, hi: float = 0.85) -> list[float]:
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n)]


def bridge_candidates(ends: DataFrame, field: DataFrame, shape: tuple[int, int, int] | None = None,
                      p: Params = Params(), max_gap: float | None = None) -> DataFrame:
    """Admissible bridges.

    ``ends``: frag, end, vid, z, y, x, o* (outward). Cheap tests on the pair come first; only pairs
    that pass them and span more than two voxels sample the field along the gap.
    Output directions o*_b are reversed, so that both run along the bridge.
    """
    gap_max = p.max_gap if max_gap is None else max_gap
    c = end_pairs(ends, gap_max)
    d = [(F.col(f"{k}_b") - F.col(f"{k}_a")).cast("double") for k in "zyx"]
    a, b = [F.col(f"o{k}_a") for k in "zyx"], [F.col(f"o{k}_b") for k in "zyx"]
    dist = F.sqrt("d2")
    touch = dist < 0.5
    g = [F.when(touch, v).otherwise(w / safe(dist, 0.5)) for v, w in zip(a, d)]
    c = c.withColumns({f"g{k}": v for k, v in zip("zyx", g)}).withColumn("gap", F.when(touch, 0.5).otherwise(dist))
    g = vec("g")
    c = c.withColumns({"mutual": F.abs(dot(a, b)), "cos_a": dot(a, g), "cos_b": dot(g, [-v for v in b])})
    c = c.filter((F.col("mutual") >= p.mutual_thresh) & (F.col("cos_a") >= p.min_turn_cos) & (F.col("cos_b") >= p.min_turn_cos))
    c = c.withColumns({f"o{k}_b": -F.col(f"o{k}_b") for k in "zyx"})
    c = c.select("frag_a", "end_a", "vid_a", "frag_b", "end_b", "vid_b", "gap", "mutual", "cos_a", "cos_b",
                 *[F.col(f"{v}{k}{s}") for s in ("_a", "_b") for v in ("", "o") for k in "zyx"], "gz", "gy", "gx")
    c = materialize(c)   # read three times below; the pair search should run once
    near = c.filter("gap <= 2").withColumns({
        "durable": F.lit(1.0),
        **{f"s{k}": F.col(f"o{k}_a") + F.col(f"o{k}_b") for k in "zyx"}, "n_samples": F.lit(2)})
    # nearest voxels along the gap, then the field there (absent = no direction)
    far = c.filter("gap > 2")
    t = F.explode(F.array(*[F.lit(v) for v in gap_samples(p.gap_samples)]))
    key = ["frag_a", "end_a", "frag_b", "end_b"]
    s = far.select(*key, *[f"{k}_{e}" for e in "ab" for k in "zyx"], "gz", "gy", "gx", t.alias("t"))
    pos = []
    for i, k in enumerate("zyx"):
        q = F.greatest(F.bround(F.col(f"{k}_a") + F.col("t") * (F.col(f"{k}_b") - F.col(f"{k}_a"))), F.lit(0.0))
        if shape:
            q = F.least(q, F.lit(float(shape[i] - 1)))
        pos.append(q.cast("int"))
    s = s.select(*key, "gz", "gy", "gx", pack(*pos).alias("vid"))
    s = s.join(field.select("vid", "oz", "oy", "ox"), "vid", "left").fillna(0.0, ["oz", "oy", "ox"])
    u = unit(vec("o"))
    s = s.withColumns({f"u{k}": v for k, v in zip("zyx", u)})
    hit = F.when(F.abs(dot(vec("u"), vec("g"))) >= p.durable_thresh, 1).otherwise(0)
    s = s.groupBy(*key).agg((F.sum(hit) / F.count(F.lit(1))).alias("durable"), F.count(F.lit(1)).cast("int").alias("n_samples"),
                            *[unfixed(F.sum(fixed(F.col(f"u{k}")))).alias(f"s{k}") for k in "zyx"])
    far = far.join(s.filter(F.col("durable") >= p.durable_min_fraction), key)
    cols = near.columns
    out = near.union(far.select(cols))
    score = (0.40 * F.col("mutual") + 0.25 * F.col("cos_a") + 0.25 * F.col("cos_b") + 0.20 * F.col("durable")
             - 0.10 * F.col("gap") / 25.0)
    return out.withColumn("score", score)


def with_cost(cands: DataFrame) -> DataFrame:
    a, b = [F.col(f"o{k}_a") for k in "zyx"], [F.col(f"o{k}_b") for k in "zyx"]
    m = [F.col(f"s{k}") / F.col("n_samples") for k in "zyx"]
    return cands.withColumn("cost", bridge_cost(a, b, F.col("gap"), m, F.col("cos_a"), F.col("cos_b")))
