"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8   # at least; a larger job spreads a key over a quarter of its shuffle partitions


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "left",
                  salts: int | None = None) -> DataFrame:
    """Join a large table with a table that has one row per key.

    The left rows of a key are spread over ``salts`` partitions by a hash of ``spread``; the right
    table, small by comparison, is copied that often. Worst-case load per task falls by the same factor,
    whatever the key distribution. The join is never a broadcast: the copies compress to next to nothing, so
    their size in shuffle blocks does not tell how much the driver would hold.
    """
    salts = salts or max(SALTS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    l = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return l.join(r.hint("merge"), [*keys, "_salt"], how).drop("_salt")
