"""Thinning, patches, curves, windows, sources and the two full runs."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake import Params
from strandlake.grid import with_vid
from strandlake.operators import components, curves, donors, fields, morph, patches, ranges, splines, thinning, windows3d
from strandlake.plans.pipeline import run_chunked, run_direct
from strandlake.sources import discovery, gad, voxels

from test_network import brute_components, line


def test_thinning_keeps_topology_and_ignores_tiles(vox):
    body = {(z, y, x) for z in range(18) for y in range(2, 7) for x in range(2, 7)}
    body |= {(z, y, x) for z in range(7, 12) for y in range(2, 16) for x in range(3, 6)}
    ring = {(z, y, x) for z in range(3) for y in range(25, 36) for x in range(25, 36)} - {(z, y, x) for z in range(3) for y in range(28, 33) for x in range(28, 33)}
    df = vox(sorted(body | ring)).cache()
    got = [{(r.z, r.y, r.x) for r in thinning.skeletonize(df, tile=t).collect()} for t in (96, 7)]
    assert got[0] == got[1]
    assert len(brute_components(got[0])) == 2
    assert len(got[0]) < 70
    loop = [p for p in got[0] if p[1] > 20]
    assert len(loop) >= 12    # the hole survives


def test_edt(spark):
    rng = np.random.default_rng(0)
    m = rng.random((12, 12, 12)) < 0.7
    zero = np.argwhere(~m)
    df = spark.createDataFrame([(1, *map(int, p)) for p in np.argwhere(m)], "patch long, z int, y int, x int")
    for r in patches.edt(df, 12).collect():
        assert r.dt == pytest.approx(np.sqrt(((zero - (r.z, r.y, r.x)) ** 2).sum(1).min()))


def test_routing_refinement_and_targets(spark):
    pts = [(1, z, y, x) for z in range(24) for y in range(9, 14) for x in range(9, 14) if (y - 11) ** 2 + (x - 11) ** 2 <= 4]
    vol = spark.createDataFrame(pts, "patch long, z int, y int, x int")
    dt = patches.edt(vol, 24)
    seeds = spark.createDataFrame([(1, 1, 0, 0, 10, 11, False), (1, 1, 1, 12, 11, 11, True), (1, 1, 2, 23, 11, 10, False), (1, 2, 0, 0, 11, 12, False)],
                                  "patch long, fiber int, ord long, z int, y int, x int, way boolean")
    path = patches.route_seeds(dt, seeds, 24).cache()
    one = sorted((r.seq, r.z, r.y, r.x) for r in path.filter("fiber = 1").collect())
    assert one[0][1:] == (0, 10, 11) and one[-1][1:] == (23, 11, 10) and (12, 11, 11) in {o[1:] for o in one}
    assert path.filter("fiber = 2").count() > 10
    p = path.filter("fiber = 1").withColumn("curve", F.lit(1).cast("long"))
    body = with_vid(vol.drop("patch")).withColumns({"curve": F.lit(1).cast("long"), "label": F.lit(1).cast("long")})
    ref = patches.refine_curves(p, body).cache()
    q = np.array([(r.z, r.y, r.x) for r in ref.orderBy("seq").collect()])
    assert np.linalg.norm(q - (12, 11, 11), axis=1).min() < 0.5
    assert np.abs(q[3:-3, 1:] - 11).max() < 1.0
    f = patches.target_fields(body, ref)
    assert f.count() == len(pts) and f.agg(F.max("intensity")).first()[0] > 0.9 and f.agg(F.min(F.abs("oz"))).first()[0] > 0.5


def test_visiting_order_is_the_shortest():
    assert patches.visiting_order((0, 0, 0), [(6, 0, 0), (2, 0, 0), (4, 0, 0)], (8, 0, 0)) == [1, 2, 0]


def test_frames_do_not_depend_on_the_run_length(spark):
    t = np.linspace(0, 6, 50)
    rows = [(1, i, float(5 * np.cos(a)), float(5 * np.sin(a)), float(a)) for i, a in enumerate(t)]
    df = spark.createDataFrame(rows, "curve long, seq long, z double, y double, x double")
    a, b = (sorted(map(tuple, curves.frames(df, c).collect())) for c in (4096, 7))
    assert np.allclose(a, b) and len(a) == 50
    n = np.array(a)[:, 2:5]
    assert np.allclose((n * np.array(a)[:, 5:8]).sum(1), 0, atol=1e-9) and np.allclose(np.linalg.norm(n, axis=1), 1)


def test_short_curves_share_a_call(spark):
    """Groups that batches cut come whole, and a task makes frames and splines of many short curves at once."""
    rows = pa.RecordBatch.from_pydict({"curve": [1, 1, 1, 2, 3, 3, 3, 3, 4], "seq": [0, 1, 2, 0, 0, 1, 2, 3, 0]})
    cut = [rows.slice(0, 2), rows.slice(2, 3), rows.slice(5, 1), rows.slice(6, 0), rows.slice(6, 3)]
    got = [(f["curve"].iloc[a], len(f.iloc[a:b])) for f, at in curves.whole_groups(iter(cut), ["curve"]) for a, b in zip(at, [*at[1:], len(f)])]
    assert got == [(1, 3), (2, 1), (3, 4), (4, 1)]
    df = spark.range(240).selectExpr("id div 6 as curve", "id % 6 as seq", "double(id % 6) as z", "double(id % 5) as y", "1.0D as x", "false as pin")
    for out in (curves.frames(df), splines.spline_curves(df)):
        assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString() and out.select("curve").distinct().count() == 40


def test_windows_over_chunks_equal_whole_curves(spark):
    rows = [(c, i, i, (i * 7) % 5, (i * 3) % 4) for c in (1, 2) for i in range(60 * c)]
    df = spark.createDataFrame(rows, "curve long, seq long, z int, y int, x int").cache()
    a = curves.neighbours_on_curve(df, "curve", "seq", ["y"], 2)
    b = curves.neighbours_on_curve(df, "curve", "seq", ["y"], 2, chunk=8)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    s = curves.running_sum(df, "curve", "seq", F.col("y"), "s", chunk=5).collect()
    for r in s:
        assert r.s == sum((i * 7) % 5 for i in range(r.seq + 1))


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    p, q = rng.integers(0, 60, (80, 3)), rng.integers(0, 60, (40, 3))
    mk = lambda a, k: spark.createDataFrame([(i, *map(int, v)) for i, v in enumerate(a)], f"{k} long, z int, y int, x int")
    got = {(r.i, r["rank"]): (r.d2, r.j) for r in ranges.nearest(mk(p, "i"), mk(q, "j"), "i", "j", k=3).collect()}
    for i, v in enumerate(p):
        want = sorted((float(((u - v) ** 2).sum()), j) for j, u in enumerate(q))[:3]
        assert [got[(i, k + 1)] for k in range(3)] == want


def test_identity_predictor_returns_the_volume(vox):
    rng = np.random.default_rng(1)
    rows = [(*map(int, p), float(i % 9 + 1)) for i, p in enumerate({tuple(v) for v in rng.integers(0, 20, (60, 3))})]
    df = vox(rows, "vol double")
    got = {(r.z, r.y, r.x): r.c0 for r in windows3d.sliding_predict(df, (20, 20, 20), lambda a: a, "vol", 8, 4).collect()}
    assert got.keys() == {r[:3] for r in rows} and all(got[r[:3]] == pytest.approx(r[3], abs=1e-6) for r in rows)


def _field(vox, lines, n=40):
    rows = {}
    for x in lines:
        for z in range(2, n - 2):
            if x == lines[0] and 17 <= z <= 20:
                continue
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    rows[(z, 10 + dy, x + dx)] = 1.0 if not dy and not dx else 0.5
    return vox([(*k, v, v, 1.0, 0.0, 0.0) for k, v in rows.items()], "vol double, intensity double, oz double, oy double, ox double")


def test_direct_and_chunked_runs(vox):
    f = _field(vox, (8, 28)).cache()
    p = Params(cut_border=0, durable_min_fraction=0.0, chunk_size=32, chunk_overlap=16, min_chain_length=5)
    d = run_direct(f, (40, 40, 40), p)
    v = {(r.z, r.y, r.x): r.label for r in d["volume"].collect()}
    left, right = {v[k] for k in v if k[2] < 18}, {v[k] for k in v if k[2] > 18}
    assert len(v) == f.count() + 4   # the gap of four voxels is bridged
    assert len(left) == 1 and len(right) == 1 and left != right
    c = run_chunked(f, (40, 40, 40), p)
    low = (1 << 21) - 1
    w = {(r.vid >> 42, r.vid >> 21 & low, r.vid & low): r.label for r in c["volume"].collect()}
    pairs = {(v[k], w[k]) for k in v if k in w}
    assert set(v) >= {(r.z, r.y, r.x) for r in f.collect()} and set(w) >= {(r.z, r.y, r.x) for r in f.collect()}
    assert len(pairs) == 2 and len({a for a, _ in pairs}) == 2 and len({b for _, b in pairs}) == 2   # one label each, in both runs
    assert c["skeleton"].count() > 60


def test_documents_round_trip(spark, tmp_path):
    doc = {"Domain": {"VoxelLength": [2.0, "m"], "LengthX": [20.0, "m"], "LengthY": [20.0, "m"], "LengthZ": [40.0, "m"]}, "NumberOfObjects": 2,
           "Object1": {f"Point{i}": [[2.0 * i, 4.0, 6.0], "m"] for i in range(1, 13)},
           "Object2": {"Point1": {"Coord": [[1.0, 2.0, 3.0], "m"], "Radius": [3.0, "m"]}}}
    (tmp_path / "a.gad").write_text(json.dumps(doc, indent=1))
    docs = gad.read_documents(spark, str(tmp_path))
    p = gad.parse_points(docs).orderBy("seq").collect()
    assert [r.x for r in p] == [float(i) for i in range(1, 13)] and {r.object for r in p} == {1} and p[0].z == 3.0
    d = gad.domain(docs).first()
    assert (d.d, d.h, d.w) == (20, 10, 10)
    o = gad.object_documents(spark.createDataFrame([(r.object, r.seq, r.z, r.y, r.x) for r in p], "label int, seq long, z double, y double, x double"), voxel=2.0)
    gad.write_document(o, str(tmp_path / "out"), (20, 10, 10), 2.0)
    text = "".join(open(tmp_path / "out" / f).read() for f in sorted(os.listdir(tmp_path / "out")) if f.startswith("part"))
    assert json.loads(text)["Object1"]["Point12"][0][0] == 24.0 and json.loads(text)["NumberOfObjects"] == 1


def test_incremental_preparation(spark, tmp_path):
    from strandlake.streaming.documents import prepare_new

    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    doc = lambda: json.dumps({"Domain": {"VoxelLength": [1.0, "m"]}, "Object1": {"Point1": [[1, 1, 1], "m"], "Point2": [[2, 2, 2], "m"]}})
    (src / "a.gad").write_text(doc())
    prepare_new(spark, str(src), out, str(tmp_path / "ck"))
    (src / "b.gad").write_text(doc())
    prepare_new(spark, str(src), out, str(tmp_path / "ck"))
    assert spark.read.parquet(out).groupBy("doc").count().collect().__len__() == 2


def test_boxes_open_only_their_slabs(spark, tmp_path):
    rng = np.random.default_rng(5)
    a = (rng.random((40, 11, 13)) < 0.3).astype(np.uint8) * 9
    np.save(tmp_path / "v.npy", a)
    path = str(tmp_path / "v.npy")
    whole, box = voxels.read_npy(spark, path, 4), voxels.read_npy(spark, path, 4, (10, 2, 7), (14, 6, 7))
    want = {(z, y, x) for z, y, x in np.argwhere(a).tolist() if 10 <= z <= 14 and 2 <= y <= 6 and x == 7}
    assert {(r.z, r.y, r.x) for r in box.collect()} == want and want
    assert whole.rdd.getNumPartitions() == 10 and box.rdd.getNumPartitions() == 2
    assert voxels.read_npy(spark, path, 4, (100, 0, 0)).count() == 0 and whole.count() == np.count_nonzero(a)
    assert voxels.read_box(spark, path, (10, 2, 7), (14, 6, 7)).count() == len(want)
    with pytest.raises(ValueError):
        voxels.read_volume(spark, "/x/volume.nii")


def test_npy_source_and_tiles(spark, tmp_path):
    a = np.zeros((20, 6, 7), np.float32)
    a[3, 2, 1], a[19, 5, 6] = 200.0, 90.0
    np.save(tmp_path / "v.npy", a)
    df = voxels.read_npy(spark, str(tmp_path / "v.npy"))
    assert {(r.z, r.y, r.x, r.v0) for r in df.collect()} == {(3, 2, 1, 200.0), (19, 5, 6, 90.0)}
    assert df.rdd.getNumPartitions() == 3
    assert voxels.to_mask(df).count() == 1
    o = np.zeros((3, 4, 5, 6))
    o[:, 1, 2, 3] = (1, 0, -1)
    np.save(tmp_path / "o.npy", o)
    assert [tuple(r) for r in voxels.read_npy(spark, str(tmp_path / "o.npy")).collect()] == [(1, 2, 3, 1.0, 0.0, -1.0)]
    voxels.write_tiles(with_vid(df), str(tmp_path / "t"))
    box = voxels.read_box(spark, str(tmp_path / "t"), (0, 0, 0), (10, 9, 9))
    assert box.count() == 1 and "PushedFilters: [IsNotNull(z)" in box._jdf.queryExecution().executedPlan().toString()
    n = voxels.write_npy_slabs(df.withColumn("label", F.lit(7)), str(tmp_path / "s"), a.shape, slab=8)
    assert n == 3 and np.load(tmp_path / "s" / "slab_000002.npy")[3, 5, 6] == 7


def test_patch_names_and_stamps(spark, vox):
    names = spark.createDataFrame([("1",), ("patch_0001",), ("patch_0001_vol.npy",), ("data/curated/patch_0001",)], "n string")
    assert {r[0] for r in names.select(discovery.normalize_patch(F.col("n"))).collect()} == {"patch_0001"}
    lab = vox([(z, 10 * i, 10 * i, i) for i in (1, 2) for z in range(5, 25)], "label int")
    m = donors.masked_crops(lab, 2).collect()
    assert len(m) == 40 and {(r.y, r.x) for r in m} == {(2, 2)} and {r.z for r in m} == set(range(2, 22))
    o = donors.order_points(lab, "export").collect()
    assert [r.z for r in sorted((r for r in o if r.label == 1), key=lambda r: r.seq)] in (list(range(5, 25)), list(range(24, 4, -1)))


def test_morph_bends_a_straight_donor(spark):
    ball = [(z, y, x) for z in range(30) for y in range(3, 10) for x in range(3, 10) if (y - 6) ** 2 + (x - 6) ** 2 <= 4]
    mask = with_vid(spark.createDataFrame([(9, *p) for p in ball], "curve long, z int, y int, x int"))
    dc = spark.createDataFrame([(9, i, float(i), 6.0, 6.0) for i in range(30)], "curve long, seq long, z double, y double, x double")
    tc = spark.createDataFrame([(1, i, 10.0, 4.0 + i, 10.0) for i in range(20)], "curve long, seq long, z double, y double, x double")
    picks = spark.createDataFrame([(1, 9)], "curve long, donor long")
    got = {(r.z, r.y, r.x) for r in morph.deform(tc, {"curves": dc, "mask": mask}, picks, (24, 32, 24)).collect()}
    assert {(10, y, 10) for y in range(4, 24)} <= got and (10, 12, 12) in got and (10, 12, 14) not in got
    assert not any(p[1] < 3 or p[1] > 24 for p in got)
    body = with_vid(spark.createDataFrame(sorted(got), "z int, y int, x int"))
    r = {(x.z, x.y, x.x): x for x in morph.render(body, tc).collect()}
    assert r[(10, 12, 10)].intensity == pytest.approx(1.0) and r[(10, 12, 10)].oy == pytest.approx(1.0)


def test_separable_stamping(spark):
    ex = spark.createDataFrame([(1, z, 5, 5, 1.0, 1.0, 0.0, 0.0) for z in range(10)], "patch long, z int, y int, x int, intensity double, oz double, oy double, ox double")
    st = spark.createDataFrame([(7, z, 0, 0, 1.0, 1.0, 0.0, 0.0) for z in range(10)], "stamp long, z int, y int, x int, intensity double, oz double, oy double, ox double")
    tries = spark.createDataFrame([(7, 0, 1, 0, 6, 6), (7, 1, 1, 0, 5, 11)], "stamp long, try int, patch long, z0 int, y0 int, x0 int")
    off = morph.separable_offsets(st, ex, tries)
    assert [(r["try"], r.x0) for r in off.collect()] == [(1, 11)]
    assert morph.merge_stamps(ex, st, off).count() == 20


def test_augmented_volume(spark):
    c = spark.createDataFrame([(1, i, 4.0 + i, 12.0, 12.0, 2.0) for i in range(14)], "curve long, seq long, z double, y double, x double, r double")
    v = fields.augmented_volume(c, (24, 24, 24))
    n = v["volume"].count()
    assert n > 100 and v["orientation"].count() == n and v["centerline"].count() > 50
