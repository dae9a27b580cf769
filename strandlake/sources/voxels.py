"""Voxel volumes: dense .npy files as a Spark data source, value rescaling, tiled Parquet tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.grid import AXIS, tile_of


class Slab(InputPartition):
    def __init__(self, z0: int, z1: int):
        self.z0, self.z1 = z0, z1


class NpyReader(DataSourceReader):
    """Rows (z, y, x, v0[, v1, v2]) of the non-zero voxels; one partition per slab of slices.

    With a box, only slabs that meet it are partitions, and only its rows and columns are read from their slices. The box is an
    option of the relation, not a pushed filter: Spark 4.1 keeps the reader of a Python source between queries of one
    DataFrame, and with it the filters of an earlier query.
    """

    def __init__(self, path: str, slab: int, low: list[int], high: list[int]):
        self.path, self.slab = path, slab
        a = np.load(path, mmap_mode="r")
        self.shape = a.shape
        # a vector field is stored component first or component last
        self.first = a.ndim == 4 and a.shape[0] == 3 and a.shape[-1] != 3
        sides = a.shape[1:] if self.first else a.shape[:3]
        self.box = {c: [max(a, 0), min(b + 1, n)] for c, n, a, b in zip("zyx", sides, low, high)}

    def partitions(self):
        low, high = self.box["z"]
        slabs = [Slab(max(z, low), min(z + self.slab, high)) for z in range(low - low % self.slab, high, self.slab)]
        return slabs if slabs and all(a < b for a, b in self.box.values()) else [Slab(0, 0)]

    def read(self, part):
        a = np.load(self.path, mmap_mode="r")
        (y0, y1), (x0, x1) = self.box["y"], self.box["x"]
        for z in range(part.z0, part.z1):
            s = np.asarray(a[:, z, y0:y1, x0:x1] if self.first else a[z, y0:y1, x0:x1])
            s = s[None] if s.ndim == 2 else (s if self.first else np.moveaxis(s, -1, 0))
            y, x = np.nonzero((s != 0).any(axis=0))
            if not len(y):
                continue
            cols = [pa.array(np.full(len(y), z, np.int32)), pa.array((y + y0).astype(np.int32)), pa.array((x + x0).astype(np.int32))]
            cols += [pa.array(s[c, y, x].astype(np.float64)) for c in range(len(s))]
            yield pa.RecordBatch.from_arrays(cols, names=["z", "y", "x", *[f"v{c}" for c in range(len(s))]])


class NpyVolume(DataSource):
    @classmethod
    def name(cls):
        return "voxel_npy"

    def schema(self):
        a = np.load(self.options["path"], mmap_mode="r")
        k = 1 if a.ndim == 3 else 3
        return "z int, y int, x int, " + ", ".join(f"v{c} double" for c in range(k))

    def reader(self, schema):
        low, high = ([int(v) for v in self.options.get(side, default).split(",")] for side, default in (("low", "0,0,0"), ("high", f"{AXIS},{AXIS},{AXIS}")))
        return NpyReader(self.options["path"], int(self.options.get("slab", "8")), low, high)


def read_npy(spark: SparkSession, path: str, slab: int = 8, lo=None, hi=None) -> DataFrame:
    """Non-zero voxels of a (D, H, W), (D, H, W, 3) or (3, D, H, W) array on a shared path, or of an inclusive box of it."""
    spark.dataSource.register(NpyVolume)
    r = spark.read.format("voxel_npy").option("slab", slab)
    for name, side in (("low", lo), ("high", hi)):
        r = r if side is None else r.option(name, ",".join(str(int(v)) for v in side))
    return r.load(path)


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """Voxels of a volume by its kind: a dense .npy array, or a folder of tiles. Other files raise."""
    if path.lower().endswith(".npy"):
        return read_npy(spark, path)
    if "." not in path.rstrip("/").rsplit("/", 1)[-1] or path.rstrip("/").lower().endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"no reader for this kind of volume: {path}")


def npy_shape(path: str) -> tuple[int, ...]:
    return np.load(path, mmap_mode="r").shape


def to_mask(df: DataFrame, value: str = "v0") -> DataFrame:
    """Binary mask: above 127 where the maximum exceeds 1, else above 0.5."""
    top = df.agg(F.max(value).alias("_top"))
    j = df.crossJoin(F.broadcast(top))   # one row
    return j.filter(F.col(value) > F.when(F.col("_top") > 1, 127.0).otherwise(0.5)).drop("_top")


def rescale(c: Column, bits: int) -> Column:
    """Integer samples of 8 or 16 bits to 0..1."""
    return c / F.lit(float((1 << bits) - 1))


def is_instance(df: DataFrame, path: str, value: str = "v0") -> bool:
    """Whether a volume holds labels: by name, else by more than one distinct value among its non-zero voxels."""
    name = path.rsplit("/", 1)[-1].lower()
    if "instance" in name or "seg" in name:
        return True
    return df.filter(F.col(value) != 0).agg(F.min(value) != F.max(value)).first()[0] or False


def write_tiles(vox: DataFrame, path: str, size: int = 256, mode: str = "overwrite") -> None:
    """Parquet sorted by tile and voxel, so that box predicates prune row groups by their statistics."""
    t = vox.withColumn("tile", tile_of(size))
    t.repartitionByRange("tile", "z").sortWithinPartitions("tile", "z", "y", "x").write.mode(mode).parquet(path)


def read_box(spark: SparkSession, path: str, lo, hi) -> DataFrame:
    """Voxels of an inclusive box; nothing else is read, whatever the kind of volume (tiles: row groups by their statistics)."""
    if path.lower().endswith(".npy"):
        return read_npy(spark, path, lo=lo, hi=hi)
    df = read_volume(spark, path)
    for c, a, b in zip("zyx", lo, hi):
        df = df.filter(F.col(c).between(a, b))
    return df


def uint16_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """Labels for a 16-bit export; raises at run time above 65,535 instead of wrapping around."""
    c = F.col(label)
    return labels.withColumn(label, F.when(c <= 65535, c).otherwise(F.raise_error(F.lit("label above 65535"))).cast("int"))


def write_npy_slabs(labels: DataFrame, path: str, shape, label: str = "label", slab: int = 16) -> int:
    """Dense int32 export, one .npy file per slab of slices, written by the tasks. Returns the slab count."""
    import os

    d, h, w = shape
    os.makedirs(path, exist_ok=True)

    def run(key, pdf):
        z0 = int(key[0]) * slab
        a = np.zeros((min(slab, d - z0), h, w), np.int32)
        pdf = pdf.dropna()
        a[pdf["z"].to_numpy(int) - z0, pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)] = pdf["v"].to_numpy(int)
        np.save(os.path.join(path, f"slab_{int(key[0]):06d}.npy"), a)
        return pd.DataFrame({"k": [int(key[0])]})

    n = -(-d // slab)
    empty = labels.sparkSession.range(n).select(F.col("id").alias("s"), *[F.lit(None).cast("int").alias(c) for c in ("z", "y", "x", "v")])
    rows = labels.select(F.floor(F.col("z") / slab).alias("s"), "z", "y", "x", F.col(label).cast("int").alias("v")).union(empty)
    return rows.groupBy("s").applyInPandas(run, "k long").count()
