"""File listings as tables: pairing, triplets, splits, status and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.ranks import global_rank


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, name, length) of files; contents are not read (the column is pruned)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
            .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length"))


def natural_key(c: Column) -> Column:
    """Sort key that orders digit runs of any length as numbers: their length comes first; text is lower-cased."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    plain = lambda s: F.regexp_replace(s, r"^0+(?=\d)", "")
    pad = lambda s: F.when(s.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(plain(s)).cast("string"), 10, "0"), plain(s))).otherwise(
        F.concat(F.lit("1"), s))
    return F.array_join(F.transform(parts, pad), "\u0001")


def natural_rank(names: DataFrame, name: str = "name", rank: str = "rank") -> DataFrame:
    return global_rank(names.withColumn("_k", natural_key(F.col(name))), [F.col("_k"), F.col(name)], rank).drop("_k")


def stem(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]*$", "")


def paired_models(files: DataFrame) -> DataFrame:
    """(stem, name, idx): image files with a geometry file of the same stem; idx is the first number."""
    img = files.filter(F.lower("name").rlike(r"\.tiff?$")).withColumn("stem", stem(F.col("name")))
    geo = files.filter(F.lower("name").rlike(r"\.gad$")).select(stem(F.col("name")).alias("stem"))
    return img.join(geo, "stem", "left_semi").select("stem", "name", F.regexp_extract("name", r"(\d+)", 1).try_cast("int").alias("idx"))


# Fallback order of the scalar field (fixed values).
INTENSITY_SUFFIXES = ["_intensity.npy", "_intensity.tif", "_centerline.npy", "_centerline.tif"]


def triplets(files: DataFrame) -> DataFrame:
    """(stem, vol, intensity, ori): complete triplets; the scalar field takes the first suffix that exists.

    One aggregation instead of six self-joins: every file contributes its role and priority.
    """
    role = F.when(F.col("name").rlike(r"_vol\.(npy|tif)$"), "vol").when(F.col("name").rlike(r"_ori\.npy$"), "ori")
    prio = F.when(F.col("name").endswith(".npy"), 0).otherwise(1)
    for i, s in enumerate(INTENSITY_SUFFIXES):
        role = role.when(F.col("name").endswith(s), "intensity")
        prio = F.when(F.col("name").endswith(s), i).otherwise(prio)
    t = files.select("name", role.alias("role"), prio.alias("prio"),
                     F.regexp_replace("name", r"_(vol|ori|intensity|centerline)\.(npy|tif)$", "").alias("stem")).filter("role is not null")
    pick = lambda r: F.min_by(F.when(F.col("role") == r, F.col("name")), F.when(F.col("role") == r, F.struct("prio", "name"))).alias(r)
    return t.groupBy("stem").agg(pick("vol"), pick("intensity"), pick("ori")).filter(
        "vol is not null and intensity is not null and ori is not null")


def first_by_priority(files: DataFrame, patterns: list[str]) -> DataFrame:
    """The file that matches the earliest pattern (ties by path), as a one-row table."""
    p = None
    for i, pat in enumerate(patterns):
        c = F.col("name").rlike(pat)
        p = F.when(c, i) if p is None else p.when(c, i)
    return files.withColumn("prio", p).filter("prio is not null").agg(F.min_by("path", F.struct("prio", "path")).alias("path"))


def train_test(names: DataFrame, fraction: float = 0.1, name: str = "name") -> DataFrame:
    """Natural order; the last max(1, round-half-even(n * fraction)) go to test."""
    r = natural_rank(names, name)
    n = names.agg(F.count(F.lit(1)).alias("n"))
    k = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(fraction)).cast("long"))
    return r.crossJoin(F.broadcast(n)).select(name, "rank", F.when(F.col("rank") > F.col("n") - k, "test").otherwise("train").alias("part"))


def holdout(names: DataFrame, every: int = 5, name: str = "name") -> DataFrame:
    """Every ``every``-th item from the first is held out for validation; the last one if none is."""
    r = global_rank(names, [F.col(name)], "rank")
    return r.select(name, "rank", F.when((F.col("rank") - 1) % every == 0, "val").otherwise("train").alias("part"))


def repeat_rows(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))


def normalize_patch(c: Column) -> Column:
    """'1', 'patch_0001', 'patch_0001_vol.npy' or a path to 'patch_0001', numbers with at least four digits.

    The number after 'patch_' counts, else the first one; a name without a number stays as it is.
    """
    base = F.element_at(F.split(c, "/"), -1)
    named = F.regexp_extract(base, r"patch_(\d+)", 1)
    n = F.regexp_replace(F.when(named != "", named).otherwise(F.regexp_extract(base, r"(\d+)", 1)), r"^0+(?=\d)", "")
    return F.when(n == "", base).otherwise(F.concat(F.lit("patch_"), F.repeat(F.lit("0"), F.greatest(F.lit(0), 4 - F.length(n))), n))


def patch_status(patches: DataFrame, stamps: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(patch, n_stamps, status): patches with the number of extracted stamps, zero included."""
    n = stamps.groupBy("patch").agg(F.count(F.lit(1)).alias("n_stamps"))
    j = patches.select("patch").distinct().join(n, "patch", "left").fillna(0, ["n_stamps"])
    j = j.withColumn("status", F.when(F.col("n_stamps") > 0, "extracted").otherwise("missing"))
    return j if meta is None else j.join(meta, "patch", "left")


def missing(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """What still has to be made."""
    return wanted.join(existing.select(*keys).distinct(), keys, "left_anti")


def read_patch_meta(spark: SparkSession, path: str) -> DataFrame:
    """Patch descriptions; malformed files are dropped; sorted by index."""
    schema = ("patch_index int, origin_zyx array<int>, cube_size int, num_fibers int, intact_donor_fibers_count int, "
              "density double, timestamp string, seeds array<struct<fiber_id:int,face:string,u:double,v:double,pos3d:array<int>,is_waypoint:boolean>>")
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path).filter(
        "patch_index is not null").orderBy("patch_index")


RAW_OR_SEGMENTED = r"(instance|seg|label|mask)"   # fixed value: names that mark label volumes
EXCLUDED = r"(_ori|_intensity|_centerline|checkpoint|_meta)"


def available_volumes(files: DataFrame) -> DataFrame:
    """Volume files with their kind, raw first, then by name."""
    v = files.filter(F.lower("name").rlike(r"\.(tiff?|npy)$") & ~F.lower("name").rlike(EXCLUDED))
    k = F.when(F.lower("name").rlike(RAW_OR_SEGMENTED), "segmented").otherwise("raw")
    return v.select("path", "name", "length", k.alias("kind")).orderBy(F.col("kind"), F.lower("name"), "path")
