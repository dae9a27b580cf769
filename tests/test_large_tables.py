"""What must hold when tables are large: plans that do not send them through the driver, bounded groups."""

import numpy as np
from pyspark.sql import functions as F

from strandlake.grid import with_vid
from strandlake.operators import chunks, fragments, geometry, ranges, ranks, thinning
from strandlake.operators.lookup import salted_lookup
from strandlake.operators.morph import separable_offsets
from strandlake.operators.windows3d import sliding_predict
from strandlake.session import materialize


def plan(df, capsys):
    capsys.readouterr()
    df.write.format("noop").mode("overwrite").save()
    df.explain()
    return capsys.readouterr().out


def points(spark, n=300):
    c = [(F.col("id") * k % 17).cast("int").alias(a) for a, k in zip("zyx", (3, 5, 7))]
    return materialize(spark.range(n).select("id", (F.col("id") % 7).alias("g"), *c))   # a few kB as a file


def test_box_join_is_shuffled(spark, capsys):
    p = points(spark)
    assert "Broadcast" not in plan(ranges.near_join(p, p.toDF("i", "h", "a", "b", "c"), 2.0, "zyx", "abc"), capsys)


def test_pair_join_is_shuffled(spark, capsys):
    assert "Broadcast" not in plan(ranges.pairs_within(points(spark), 2.0, "id"), capsys)


def test_salted_copies_are_shuffled(spark, capsys):
    p = points(spark)
    assert "Broadcast" not in plan(salted_lookup(p, p.select("g").distinct(), ["g"], ["id"]), capsys)


def test_bucket_offsets_are_shuffled(spark, capsys):
    assert "Broadcast" not in plan(ranks.sequence_in_group(points(spark), ["g"], ["id"], F.floor(F.col("id") / 10)), capsys)


def test_stamp_rounds_are_shuffled(spark, capsys):
    p = points(spark)
    stamps = p.select(F.col("g").alias("stamp"), "z", "y", "x", F.lit(1.0).alias("intensity"))
    tries = stamps.select("stamp", (F.col("stamp") % 2).alias("patch"), F.lit(0).alias("try"), *[(F.col("stamp") * 40).cast("int").alias(f"{c}0") for c in "zyx"]).distinct()
    lines = p.limit(0).select((F.col("g") % 2).alias("patch"), "z", "y", "x", F.lit(1.0).alias("intensity"))
    out = separable_offsets(materialize(stamps), materialize(lines), materialize(tries))
    assert "Broadcast" not in plan(out, capsys)
    assert out.count() == 7


def test_stored_voxels_of_value_zero_are_predicted(spark, vox):
    v = vox([(0, 0, 0, 0.0), (1, 2, 3, 0.25), (9, 9, 9, 0.0)], "v double")
    got = {(r.z, r.y, r.x): r.c0 for r in sliding_predict(v, (10, 10, 10), np.sqrt, "v", 8, 4).collect()}
    assert {k: round(x, 6) for k, x in got.items()} == {(0, 0, 0): 0.0, (1, 2, 3): 0.5, (9, 9, 9): 0.0}


def test_search_starts_as_small_as_sites_are_dense(spark):
    c = [((F.col("id") * k) % 101 / 16.0).alias(a) for a, k in zip("zyx", (3, 5 * 101 + 7, 11))]
    p = materialize(spark.range(3000).select("id", *c))
    assert ranges.first_radius(p, "zyx", [], 16.0, 8) <= 2.0       # one cell of 16 holds all of them
    got = {(r.id, r["rank"]): (r.site, r.d2) for r in ranges.nearest(p.filter("id % 50 = 0"), p.withColumnRenamed("id", "site"), "id", "site", k=3, cell=16.0).collect()}
    rows = np.array([(r.z, r.y, r.x) for r in p.orderBy("id").collect()])
    for i in range(0, 3000, 50):
        d2 = ((rows - rows[i]) ** 2).sum(1)
        want = np.lexsort((np.arange(3000), d2))[:3]
        assert [got[i, r][0] for r in (1, 2, 3)] == want.tolist()


def test_copies_at_one_place_leave_the_search(spark):
    p = materialize(spark.range(4000).select("id", *[F.lit(1.0).alias(c) for c in "zyx"]))
    n = ranges.nearest(p.limit(5), p.withColumnRenamed("id", "site"), "id", "site", k=8)
    rows = n.collect()
    assert len(rows) == 40 and all(r.site == r["rank"] - 1 and r.d2 == 0.0 for r in rows)


def test_folded_search_has_one_row_a_point(spark):
    p = points(spark)
    n = ranges.nearest(p, p.withColumnRenamed("id", "site"), "id", "site", k=4, fold=[F.max("d2").alias("far"), F.min("_first").alias("own")])
    rows = n.collect()
    assert len(rows) == 300 and n.columns == ["id", "far", "own"]


def test_balls_that_overlap_are_expanded_in_one_task(spark, capsys):
    from strandlake.operators.fields import augmented_tubes, augmented_volume, dilate_by_radius

    p = points(spark)
    assert "REPARTITION_BY_COL" in plan(dilate_by_radius(p, (20, 20, 20), fixed=2.0), capsys)
    c = p.select(F.col("g").alias("curve"), F.floor(F.col("id") / 7).alias("seq"), "z", "y", "x", F.lit(1.6).alias("r"))
    one, all_ = augmented_tubes(c, (24, 24, 24), factor=2)[1], augmented_volume(c, (24, 24, 24), factor=2)["volume"]
    assert sorted(r.vid for r in one.collect()) == sorted(r.vid for r in all_.collect())


def test_neighbourhoods_keep_their_partitions(spark, vox, capsys):
    from strandlake.operators.stencil import degree

    assert "REPARTITION_BY_NUM" in plan(degree(vox([(1, 1, 1), (1, 1, 2)])), capsys)


def test_expanding_steps_have_more_tasks_than_shuffle_partitions(spark, vox, capsys):
    from strandlake.operators.skeleton import overlay
    from strandlake.operators.stencil import TASKS, degree

    v = vox([(1, 1, 1, 4), (1, 1, 2, 5)], "label int")
    n = TASKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (degree(v), overlay(v.select("vid", "label"), "label", ["label"])):
        assert f", {n}), REPARTITION_BY_NUM" in plan(df, capsys)


def test_points_move_once_to_be_paired(spark, capsys):
    p = points(spark).filter("id < 120").withColumn("w", F.concat(F.lit("w"), "id"))
    out = ranges.pairs_within(p, 2.0, "id", extra=["w"])
    assert plan(out, capsys).count("Exchange") == 1
    rows = [(r.id, (r.z, r.y, r.x)) for r in p.collect()]
    want = {(i, j) for i, a in rows for j, b in rows if i < j and sum((u - v) ** 2 for u, v in zip(a, b)) <= 4}
    got = [(r.id_a, r.id_b, r.w_a, r.w_b) for r in out.collect()]
    assert len(got) == len(want) and {g[:2] for g in got} == want and all(g[2:] == (f"w{g[0]}", f"w{g[1]}") for g in got)


def test_pairs_are_compared_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    at = rng.integers(0, 6, (90, 3)).astype(float)
    want = {(i, j) for i in range(90) for j in range(i) if ((at[i] - at[j]) ** 2).sum() <= 4}
    for rows in (1, 50, 1 << 20):
        monkeypatch.setattr(ranges, "PAIR_ROWS", rows)
        got = [(max(i, j), min(i, j)) for a, b, _ in ranges.close_pairs(at, np.ones(90, dtype=bool), 2.0) for i, j in zip(a.tolist(), b.tolist())]
        assert len(got) == len(want) and set(got) == want


def test_ends_meet_their_surroundings_in_large_cells(spark, vox, monkeypatch):
    from strandlake.operators import fragments

    asked = []

    def spy(left, right, reach, lcols, rcols, on=None, size=None, keep_cell=False):
        asked.append((reach, size or 2 * reach + 1))
        return ranges.near_join(left, right, reach, lcols, rcols, on, size, keep_cell)

    monkeypatch.setattr(fragments, "near_join", spy)
    fv = vox([(z, 3, 3, 0.0, 0.0, 1.0) for z in range(9)], "oz double, oy double, ox double").withColumn("frag", F.lit(1).cast("long"))
    ends = spark.createDataFrame([(1, 9, (3 << 21) + 3, (8 << 42) + (3 << 21) + 3)], "frag long, length int, head long, tail long")
    assert fragments.end_directions(fv, ends, fv).count() == 2
    assert len(asked) == 2 and all(size >= 4 * reach for reach, size in asked)


def test_links_do_not_expand_voxels(spark, capsys):
    at = [(z, y, 64 + x) for z, y, x in ((1, 1, -2), (1, 1, -1), (1, 2, 0), (2, 3, 1), (9, 9, 9))]   # over the face of a tile, and one alone
    fv = with_vid(spark.createDataFrame(at, "z int, y int, x int")).withColumn("frag", F.lit(1).cast("long"))
    li = fragments.links(fv)
    assert "HashAggregate" not in plan(li, capsys)   # lists of every place's voxels are sorted and spilled
    vid = [r["vid"] for r in fv.collect()]
    assert {r["vid"]: r["nb"] for r in li.collect()} == {vid[0]: [vid[1]], vid[1]: [vid[0], vid[2]], vid[2]: [vid[1], vid[3]], vid[3]: [vid[2]], vid[4]: []}


def test_projection_evaluates_each_place_once(spark):
    c = spark.range(6).selectExpr("1L as curve", "id as seq", "double(id) as z", "0.0D as y", "0.0D as x", "double(id) as arc")
    p = spark.createDataFrame([(1, 2, 1, 0), (2, 9, 0, 0)], "vid long, z int, y int, x int")
    out = geometry.project_to_curve(p, c)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("1.0E-8") <= 2   # one foot a segment
    assert [(r["vid"], round(r["pz"], 6), round(r["d2"], 6)) for r in out.orderBy("vid").collect()] == [(1, 2.0, 1.0), (2, 5.0, 16.0)]


def test_thinning_stops_after_six_idle_passes(spark, monkeypatch):
    made = []
    monkeypatch.setattr(thinning, "materialize", lambda df: made.append(1) or materialize(df))
    block = with_vid(spark.range(27).selectExpr("int(id div 9) as z", "int(id div 3 % 3) as y", "int(id % 3) as x"))
    assert 0 < thinning.skeletonize(block).count() < 27
    assert (len(made) - 1) % 6   # whole rounds would end at a multiple of six


def test_shared_voxels_are_counted_before_they_are_paired(spark):
    at = with_vid(spark.range(40).selectExpr("int(id) as z", "1 as y", "1 as x"))
    c = materialize(chunks.assign_chunks(at, (40, 2, 2), 16, 8).withColumn("label", F.lit(1)))
    plan = chunks.chunk_overlaps(c)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3   # lists of a voxel, equal lists, pairs
    got = {(r["chunk_a"], r["chunk_b"]): r["n"] for r in chunks.chunk_overlaps(c).collect()}
    size = {(r["chunk"], r["other"]): r["n"] for r in chunks.overlap_sizes(c, (40, 2, 2), 16, 8).collect()}
    assert got == {(0, 1): 8, (1, 2): 8, (2, 3): 8} and size == got | {(b, a): n for (a, b), n in got.items()}


def event_folder(spark, path, rows):
    """A folder with an event table of (event_id, seconds, user_id, value)."""
    e = spark.createDataFrame([(i, t, u, "a", v, "{}") for i, t, u, v in rows], "event_id long, t long, user_id long, event_type string, value double, props string")
    e.select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_labels_of_large_user_numbers(spark, tmp_path):
    from strandlake.plans.catalogue import QUERIES

    d = event_folder(spark, tmp_path, [(2 * i + u % 2, 1_700_000_000 + 60 * i, u, float(i)) for i in range(60) for u in (600_064, 600_065)])
    got = {r["vid"]: r["label"] for r in QUERIES["stitched_labels"](spark, d).collect()}
    assert len(got) == 120 and set(got.values()) == set(range(1, max(got.values()) + 1))
    x = lambda v: v & ((1 << 21) - 1)
    assert {got[v] for v in got if x(v) < 3}.isdisjoint({got[v] for v in got if x(v) >= 3})   # of one user and the other


def test_chunk_labels_of_more_than_32_bits_are_told_apart(spark):
    labels = [(0, 3), (0, (1 << 32) + 1), (1, 1), (1, 1 << 34)]
    df = spark.createDataFrame(labels, "chunk long, label long")
    none = df.limit(0).select(F.col("chunk").alias("chunk_a"), F.col("label").alias("label_a"), F.col("chunk").alias("chunk_b"), F.col("label").alias("label_b"))
    got = {(r["chunk"], r["label"]): r["global_id"] for r in chunks.consensus_ids(df, none).collect()}
    assert got == {k: i + 1 for i, k in enumerate(labels)}


def test_balls_and_medians_fill_tiles_as_arrays(spark, capsys):
    """Against brute force, over tile faces and across borders narrower than a ball; no voxel is expanded as a row."""
    from strandlake.operators.fields import dilate_by_radius
    from strandlake.operators.stencil import median3

    shape = (9, 7, 40)
    rows = [(0.4, 6.6, 31.5, 1.5), (8.5, 3.0, 0.0, 2.0), (4.5, 0.2, 33.2, 5.5), (4.5, 0.2, 33.2, 1.0), (2.0, 2.0, 39.7, 3.0), (5.0, 5.0, 15.0, 2.25), (None, 1.0, 1.0, 2.0)]
    points = spark.createDataFrame(rows, "z double, y double, x double, r double")
    want = np.zeros(shape, bool)
    for *c, r in rows[:-1]:
        c, k = [round(v) for v in c], int(r)
        for o in np.ndindex(*(2 * k + 1,) * 3):
            o = [v - k for v in o]
            if sum(v * v for v in o) <= r * r:
                want[tuple((a + b) % n for a, b, n in zip(c, o, shape))] = True
    balls = dilate_by_radius(points, shape)
    got = [(r.z, r.y, r.x, r.vid) for r in balls.collect()]
    assert len(got) == len(set(got)) and {g[:3] for g in got} == set(zip(*(v.tolist() for v in np.nonzero(want))))
    assert all(v == (z << 42) + (y << 21) + x for z, y, x, v in got)
    wide = np.pad(want, 1, "symmetric").astype(int)
    count = sum(wide[i:i + 9, j:j + 7, k:k + 40] for i in range(3) for j in range(3) for k in range(3))
    median = median3(balls, shape)
    assert sorted((r.z, r.y, r.x) for r in median.collect()) == sorted(zip(*(v.tolist() for v in np.nonzero(count >= 14))))
    assert plan(median, capsys).count("FlatMapGroupsInArrow") >= 2
