"""Row numbers without sorting a whole group, or the whole table, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import materialize


def sequence_in_group(df: DataFrame, group: list[str], order: list[str], bucket: Column, name: str = "seq",
                      fan: int = 256) -> DataFrame:
    """Zero-based position of each row in its group's order.

    ``bucket`` must not decrease along the order. Rows are numbered inside (group, bucket); bucket
    offsets come from a running sum over bucket counts, itself done in two levels of ``fan`` buckets.
    A group with a third of all rows is thus spread over all of its buckets.
    """
    w = Window.partitionBy(*group, "_b").orderBy(*order)
    rows = df.withColumn("_b", bucket)
    # the source is read twice instead of being cached: counting needs two narrow columns only
    counts = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_s", F.floor(F.col("_b") / fan))
    sup = counts.groupBy(*group, "_s").agg(F.sum("_n").alias("_sn"))
    before = Window.orderBy("_s").partitionBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    sup = sup.select(*group, "_s", F.coalesce(F.sum("_sn").over(before), F.lit(0)).alias("_soff"))
    inner = Window.partitionBy(*group, "_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(sup.hint("merge"), [*group, "_s"]).select(
        *group, "_b", (F.col("_in") + F.col("_soff")).alias("_off"))
    numbered = rows.withColumn("_i", F.row_number().over(w) - 1)
    # nearly as many buckets as rows where groups are small: never a broadcast
    return numbered.join(offs.hint("merge"), [*group, "_b"]).withColumn(name, (F.col("_i") + F.col("_off")).cast("long")).drop("_b", "_i", "_off")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """One-based row number over the whole table in the given (total) order.

    Range partitions are sorted locally and shifted by the sizes of the partitions before them; only
    one count per partition meets in one place. The checkpoint pins the partition boundaries.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    s = materialize(s.withColumn("_m", F.monotonically_increasing_id()))
    s = s.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # one row per range partition: the count is set by the job, not by the data
    return s.join(F.broadcast(offs), "_p").withColumn(name, (F.col("_i") + F.col("_off") + 1).cast("long")).drop("_m", "_p", "_i", "_off")
