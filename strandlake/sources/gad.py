"""Curve-geometry documents (JSON with keys Object1..N, Point1..M) to curve tables and back."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators.ranks import global_rank

MAP = "map<string,string>"
# Fixed values of the file format that a reader looks at.
OBJECT_TYPE = "CurvedCircularFiber"
UNIT = "m"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))


def parse_points(docs: DataFrame, min_points: int = 2) -> DataFrame:
    """(doc, object, seq, z, y, x, r) in voxels; points sorted by number, short objects skipped.

    A point is ``[[x, y, z], unit]`` or ``{"Coord": [[x, y, z], unit], "Radius": [r, unit]}``.
    """
    d = docs.select("doc", F.from_json("text", MAP).alias("m"))
    d = d.select("doc", F.get_json_object(F.col("m")["Domain"], "$.VoxelLength[0]").cast("double").alias("voxel"), F.explode("m").alias("k", "v"))
    d = d.filter(F.col("k").rlike(r"^Object\d+$")).select(
        "doc", "voxel", F.regexp_extract("k", r"(\d+)$", 1).cast("int").alias("object"), F.explode(F.from_json("v", MAP)).alias("k", "v"))
    d = d.filter(F.col("k").rlike(r"^Point\d+$"))
    xyz = F.from_json(F.coalesce(F.get_json_object("v", "$.Coord[0]"), F.get_json_object("v", "$[0]")), "array<double>")
    d = d.select("doc", "object", F.regexp_extract("k", r"(\d+)$", 1).cast("int").alias("p"), xyz.alias("c"), "voxel",
                 F.get_json_object("v", "$.Radius[0]").cast("double").alias("r"))
    w = Window.partitionBy("doc", "object")   # a document is one row to begin with, so this is bounded
    d = d.withColumn("seq", F.row_number().over(w.orderBy("p")).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return d.filter(F.col("n") >= min_points).select(
        "doc", "object", "seq", *[(F.col("c")[i] / F.col("voxel")).alias(c) for i, c in ((2, "z"), (1, "y"), (0, "x"))],
        (F.col("r") / F.col("voxel")).alias("r"))


def domain(docs: DataFrame) -> DataFrame:
    """(doc, voxel, d, h, w): voxel length and grid size of each document."""
    m = F.from_json("text", MAP)["Domain"]
    num = lambda k: F.get_json_object(m, f"$.{k}[0]").cast("double")
    return docs.select("doc", num("VoxelLength").alias("voxel"), *[
        F.bround(num(f"Length{a}") / num("VoxelLength")).cast("int").alias(c) for a, c in (("Z", "d"), ("Y", "h"), ("X", "w"))])


def with_curve_id(points: DataFrame) -> DataFrame:
    """Adds ``curve``: one id per (document, object)."""
    return points.withColumn("curve", F.xxhash64("doc", "object"))


def diameter(vol_count, n_points, voxel: float):
    """Diameter in metres from the mean cross-section (at least half a voxel)."""
    import math

    area = F.greatest(vol_count / F.greatest(n_points, F.lit(1)), F.lit(0.5))
    return F.lit(2.0 * voxel) * F.sqrt(area / math.pi)


def object_documents(points: DataFrame, sizes: DataFrame | None = None, voxel: float = 1e-6, default_diameter: float = 7.0,
                     min_points: int = 2) -> DataFrame:
    """(label, n_points, json): one JSON object per label from its ordered points (label, seq, z, y, x).

    ``sizes``: (label, n) voxel counts of the instance volume, for the diameter.
    """
    entry = F.struct(F.concat(F.lit('"Point'), F.col("seq") + 1, F.lit('":[['),
                              F.concat_ws(",", *[(F.col(c) * voxel).cast("string") for c in ("x", "y", "z")]), F.lit('],"m"]')).alias("t"))
    g = points.groupBy("label").agg(F.count(F.lit(1)).alias("n_points"), F.sort_array(F.collect_list(F.struct("seq", entry.alias("e")))).alias("l"))
    g = g.filter(F.col("n_points") >= min_points)
    if sizes is not None:
        g = g.join(sizes.select("label", F.col("n").alias("vol")), "label", "left")
        dia = diameter(F.coalesce("vol", F.lit(0)), F.col("n_points"), voxel)
    else:
        dia = F.lit(default_diameter * voxel)
    head = F.to_json(F.struct(F.lit(OBJECT_TYPE).alias("Type"), F.lit(1).alias("MaterialID"), dia.alias("Diameter"), (F.col("n_points") - 1).alias("NumberOfSegments")))
    body = F.array_join(F.transform("l", lambda e: e["e"]["t"]), ",")
    return g.select("label", "n_points", F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(","), body, F.lit("}")).alias("json"))


def write_document(objects: DataFrame, path: str, shape, voxel: float = 1e-6, periodic: bool = False, created: datetime | None = None) -> None:
    """Writes the objects as text parts that concatenate, in name order, to one document; ``created`` dates its header."""
    d, h, w = shape
    sides = {f"Length{a}": [n * voxel, UNIT] for a, n in zip("XYZ", (w, h, d))}
    origin = {f"Origin{a}": [0.0, UNIT] for a in "XYZ"}
    wraps = {f"Periodic{a}": periodic for a in "XYZ"}
    stamp = {"CreationDate": created.strftime("%Y-%m-%d"), "CreationTime": created.strftime("%H:%M:%S")} if created else {}
    head = {"Description": "Curves resolved by strandlake", **stamp, "Domain": {"VoxelLength": [voxel, UNIT], **sides, **origin, **wraps}}
    r = global_rank(objects, [F.col("label")], "k")
    body = r.select("k", F.concat(F.lit('"Object'), F.col("k"), F.lit('":'), F.col("json"), F.lit(",")).alias("value"))
    n = objects.count()
    spark = objects.sparkSession
    first = spark.range(1).select(F.lit(0).cast("long").alias("k"), F.lit(json.dumps(head)[:-1] + ",").alias("value"))
    last = spark.range(1).select(F.lit(n + 1).cast("long").alias("k"), F.lit(f'"NumberOfObjects":{n}}}').alias("value"))
    out = first.union(body).union(last)
    out.repartitionByRange("k").sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)
