"""Helpers that the operators share: reading tables, guarded columns, kernels on words and hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.session import materialize

LANES = np.uint64(0x0101010101010101)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def stored(df: DataFrame, **options: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and lost executors cost only a re-read."""
    return materialize(df, **options)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bit_sums(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits (lowest first) is set in each consecutive group of ``counts`` hashes.

    Eight byte lanes are summed at once: runs of at most 255 hashes cannot overflow a lane.
    """
    out = np.zeros((len(counts), 64), dtype=np.int64)
    if not len(hashes):
        return out
    runs = (counts + 254) // 255
    group = np.repeat(np.arange(len(counts)), runs)
    first = np.repeat(np.cumsum(counts) - counts, runs)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(runs) - runs, runs)
    begins = first + 255 * nth
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, begins)
        np.add.at(out[:, bit::8], group, lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64))
    return out


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of each group: bit i is set where over half of the group's hashes have it set; an empty group gives zero."""
    bits = bit_sums(hashes, counts) * 2 > counts[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)
