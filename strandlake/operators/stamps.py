"""Books of a curation folder as tables: saved patches, extracted stamps, donor library, checks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.ranks import global_rank

STAMP = r"^(.*?)_fiber_(\d+)_(vol|intensity|ori)\.npy$"   # fixed value: names of stamp files
LEAST_VOXELS = 3


def stamp_files(files: DataFrame) -> DataFrame:
    """(patch, fiber, part, name) of the stamp files in a listing."""
    return files.filter(F.col("name").rlike(STAMP)).select(
        F.regexp_extract("name", STAMP, 1).alias("patch"), F.regexp_extract("name", STAMP, 2).cast("int").alias("fiber"),
        F.regexp_extract("name", STAMP, 3).alias("part"), "name")


def stamps_to_extract(labels: DataFrame, files: DataFrame, least: int = LEAST_VOXELS) -> DataFrame:
    """(patch, fiber, n): labels (patch, fiber, one row a voxel) of ``least`` voxels or more that lack one of their three files."""
    whole = stamp_files(files).groupBy("patch", "fiber").agg(F.count_distinct("part").alias("k")).filter("k = 3")
    size = labels.groupBy("patch", "fiber").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return size.join(whole, ["patch", "fiber"], "left_anti")


def without_patch_stamps(files: DataFrame, patches: DataFrame) -> DataFrame:
    """The listing after the stamps of some patches were removed; other files stay."""
    named = files.withColumn("patch", F.when(F.col("name").rlike(STAMP), F.regexp_extract("name", STAMP, 1)))
    return named.join(patches.select("patch").distinct(), "patch", "left_anti").select(*files.columns)


def without_stamps(files: DataFrame) -> DataFrame:
    """The listing after all stamps were cleared."""
    return files.filter(~F.col("name").rlike(STAMP))


def synced_library(library: DataFrame, donors: DataFrame, files: DataFrame) -> DataFrame:
    """(patch, fiber, change): what a rebuild does to the donor library.

    Donors count if their patch has a stamp; rows are 'added', 'kept' or 'removed' against the old library.
    """
    allowed = stamp_files(files).filter("part = 'vol'").select("patch").distinct()
    new = donors.select("patch", "fiber").distinct().join(allowed, "patch", "left_semi").withColumn("new", F.lit(True))
    old = library.select("patch", "fiber").distinct().withColumn("old", F.lit(True))
    j = new.join(old, ["patch", "fiber"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("kept")
    return j.select("patch", "fiber", change.alias("change"))


def save_slots(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """(request, index): the loaded index where one is overwritten, else the next free ones in order of request.

    ``requests``: request, loaded (null for a new patch); ``existing``: index of saved patches.
    """
    top = existing.agg(F.coalesce(F.max("index"), F.lit(0)).alias("top"))
    fresh = global_rank(requests.filter("loaded is null"), [F.col("request")], "k").crossJoin(F.broadcast(top))   # one row
    return requests.filter("loaded is not null").select("request", F.col("loaded").alias("index")).union(
        fresh.select("request", (F.col("top") + F.col("k")).alias("index")))


def patch_checks(volume: DataFrame, skeleton: DataFrame) -> DataFrame:
    """(patch, skel_voxels, vol_voxels, mismatches, status): the volume must carry the skeleton's label on every skeleton voxel."""
    s = skeleton.select("patch", "vid", F.col("label").alias("want")).join(volume.select("patch", "vid", "label"), ["patch", "vid"], "left")
    bad = F.count_if(~F.col("want").eqNullSafe(F.col("label")))
    c = s.groupBy("patch").agg(F.count(F.lit(1)).alias("skel_voxels"), bad.alias("mismatches"))
    n = volume.groupBy("patch").agg(F.count(F.lit(1)).alias("vol_voxels"))
    j = n.join(c, "patch", "full").fillna(0, ["skel_voxels", "vol_voxels", "mismatches"])
    return j.select("patch", "skel_voxels", "vol_voxels", "mismatches", F.when(F.col("mismatches") == 0, "CLEAN").otherwise("ERROR").alias("status"))


def fiber_quality(curves: DataFrame) -> DataFrame:
    """Adds reason to rows of ``through_curves``: why a curve is no donor, null for a donor."""
    reason = (F.when(F.col("n") < 15, "too_short").when(F.col("length") < 75, "short_length")
              .when(F.col("entry_face").isNull() | F.col("exit_face").isNull() | (F.col("entry_face") == F.col("exit_face")), "invalid_endpoints")
              .when(~F.col("valid"), "parallel_sliced"))
    return curves.withColumn("reason", reason)


def intact_counts(curves: DataFrame, patch: str = "patch") -> DataFrame:
    """(patch, num_fibers, intact): curves and valid donors of each patch."""
    return curves.groupBy(patch).agg(F.count(F.lit(1)).alias("num_fibers"), F.count_if("valid").alias("intact"))


def by_volume(labels: DataFrame, group: str, label: str = "label", least: int = 8, at_most: int | None = None) -> DataFrame:
    """(group, label, n, rank): labels of ``least`` voxels or more, the largest first (ties: smaller label), numbered from 1 in their group.

    ``at_most`` is an optional limit on labels a group; there is none by default.
    """
    from pyspark.sql import Window

    n = labels.groupBy(group, label).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    r = n.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), label)))   # labels of one patch
    return r if at_most is None else r.filter(F.col("rank") <= at_most)


def face_coordinates(size: int, z: str = "z", y: str = "y", x: str = "x"):
    """struct(face, u, v): the face within one voxel of a point, and the point's place on it; null inside."""
    s = float(size - 1)
    axes = [(z, y, x), (y, z, x), (x, z, y)]
    out = None
    for axis, a, b in axes:
        for name, near in ((f"{axis}_min", F.col(axis) <= 1), (f"{axis}_max", F.col(axis) >= size - 2)):
            here = F.struct(F.lit(name).alias("face"), (F.col(a) / s).alias("u"), (F.col(b) / s).alias("v"))
            out = F.when(near, here) if out is None else out.when(near, here)
    return out


def open_patch(field: DataFrame, shape, origin, size: int) -> tuple[DataFrame, tuple[int, int, int]]:
    """(voxels in patch coordinates, origin used): the origin is clamped so that the cube fits where the volume allows."""
    at = tuple(max(0, min(int(o), n - size)) for o, n in zip(origin, shape))
    inside = field
    for c, o in zip("zyx", at):
        inside = inside.filter(F.col(c).between(o, o + size - 1))
    return inside.withColumns({c: (F.col(c) - o).cast("int") for c, o in zip("zyx", at)}), at


def one_of_each_stem(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """(stem, name): one file a stem, of the first suffix in the list that exists."""
    prio, cut = None, F.col("name")
    for i, s in enumerate(suffixes):
        hit = F.col("name").endswith(s)
        prio = F.when(hit, i) if prio is None else prio.when(hit, i)
        cut = F.when(hit, F.expr(f"substring(name, 1, length(name) - {len(s)})")).otherwise(cut)
    f = files.select("name", prio.alias("p"), cut.alias("stem")).filter("p is not null")
    return f.groupBy("stem").agg(F.min_by("name", F.struct("p", "name")).alias("name"))


def first_occurrences(items: DataFrame, value: str, position: str) -> DataFrame:
    """(value, rank): distinct values in the order of their first position."""
    return global_rank(items.groupBy(value).agg(F.min(position).alias("_at")), [F.col("_at"), F.col(value)], "rank").select(value, "rank")


def report_lines(metrics: DataFrame) -> DataFrame:
    """(line, text): a one-row metrics table as report lines, real numbers with four decimals."""
    def shown(c):
        return F.format_string("%.4f", F.col(c)) if dict(metrics.dtypes)[c] in ("double", "float") else F.col(c).cast("string")

    rows = F.array(*[F.concat(F.rpad(F.lit(c), max(20, len(c)), " "), F.lit(": "), shown(c)) for c in metrics.columns])
    return metrics.select(F.posexplode(rows).alias("line", "text"))
