"""Voxel tables derived from an event log, so that operators can run on any driver table.

Each user owns a small square column of the grid: consecutive events climb along z and wander by at
most two cells sideways. The sequence number is found without sorting a whole user in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.grid import ball_offsets, with_vid
from strandlake.operators.ranks import sequence_in_group
from strandlake.operators.curves import neighbours_on_curve
from strandlake.operators.stencil import dilate

LAYER = 4096          # events of one user per layer along z
LANE = 256            # x distance between layers
BANDS = 262_144       # bands of 16 users before the next z block


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def skeleton(spark: SparkSession, sf_dir: str, spacing: int = 3) -> DataFrame:
    """vid, z, y, x, fiber, seq, intensity; one voxel per event."""
    e = events(spark, sf_dir).select("event_id", "ts", "user_id", "value")
    e = sequence_in_group(e, ["user_id"], ["ts", "event_id"], bucket=F.expr("unix_seconds(cast(ts as timestamp)) div 21600"))
    band = F.floor(F.col("user_id") / 16)
    z = F.col("seq") % LAYER + 2 * LAYER * F.floor(band / BANDS)
    y = spacing * (band % BANDS) + F.col("event_id") % 3
    x = spacing * (F.col("user_id") % 16) + F.pmod(F.floor("value"), F.lit(3)) + LANE * F.floor(F.col("seq") / LAYER)
    return with_vid(e.select(
        z.cast("int").alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"),
        F.col("user_id").alias("fiber"), "seq", (F.col("value") / 500.0).alias("intensity")))


def oriented(spark: SparkSession, sf_dir: str, spacing: int = 3) -> DataFrame:
    """The skeleton with its unit tangent (oz, oy, ox): central difference along the sequence."""
    s = skeleton(spark, sf_dir, spacing)
    n = neighbours_on_curve(s, "fiber", "seq", ["z", "y", "x"], 1)
    d = [F.coalesce(F.col(f"{c}_p1"), F.col(c)) - F.coalesce(F.col(f"{c}_m1"), F.col(c)) for c in ("z", "y", "x")]
    n = n.withColumns({"dz": d[0], "dy": d[1], "dx": d[2]})
    nn = F.sqrt((F.col("dz") * F.col("dz") + F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).cast("double"))
    n = n.withColumn("nn", F.when(nn < 1e-8, F.lit(1.0)).otherwise(nn))
    return n.select("vid", "z", "y", "x", "fiber", "seq", "intensity",
                    *[(F.col(f"d{c}") / F.col("nn")).alias(f"o{c}") for c in ("z", "y", "x")])


def foreground(spark: SparkSession, sf_dir: str, spacing: int = 3) -> DataFrame:
    """Ball of radius 1 around every skeleton voxel."""
    return dilate(skeleton(spark, sf_dir, spacing), ball_offsets(1))
