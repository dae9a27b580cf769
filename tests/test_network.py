"""Components, severing, fragments, matching and diffusion on small shapes, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import Params
from strandlake.grid import OFFSETS_26, pack
from strandlake.operators import components, diffuse, fragments, matching, sever, stencil
from strandlake.plans.pipeline import resolve_skeleton


def line(z0, z1, y, x):
    return [(z, y, x) for z in range(z0, z1)]


def brute_components(pts):
    left, out = set(pts), []
    while left:
        todo, comp = [left.pop()], set()
        while todo:
            p = todo.pop()
            comp.add(p)
            for d in OFFSETS_26:
                q = tuple(a + b for a, b in zip(p, d))
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out.append(comp)
    return out


def test_components_match_brute_force_for_every_tiling(vox):
    rng = np.random.default_rng(3)
    pts = {tuple(map(int, p)) for p in rng.integers(0, 20, (500, 3))}
    want = {frozenset(c) for c in brute_components(pts)}
    df = vox(sorted(pts)).cache()
    for tile in (64, 4):
        got = {}
        for r in components.connected_components(df, tile=tile).collect():
            got.setdefault(r.comp, set()).add((r.z, r.y, r.x))
        assert {frozenset(c) for c in got.values()} == want
        v = lambda p: (p[0] << 42) + (p[1] << 21) + p[2]
        assert all(k == min(map(v, c)) for k, c in got.items())


def test_edge_components_on_a_long_path_and_a_star(spark):
    e = [(i, i + 1) for i in range(100, 300)] + [(1000, i) for i in range(1001, 1200)]
    r = components.edge_components(spark.createDataFrame(e, "a long, b long")).collect()
    assert {x.v: x.root for x in r} == {**{i: 100 for i in range(100, 301)}, **{i: 1000 for i in range(1000, 1200)}}


def test_edge_components_over_many_partitions(spark):
    """Partitions that adaptive execution may not merge: contraction alone is not enough."""
    rng = np.random.default_rng(9)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(1000, 1150)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in e:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.v: r.root for r in components.edge_components(spark.createDataFrame(e, "a long, b long")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {v: find(v) for a, b in e if a != b for v in (a, b)}


def test_flood_crosses_tiles(vox):
    pts = [(z, 5, 5, 7 if z == 0 else 3 if z == 29 else None) for z in range(30)]
    for tile in (4, 48):
        got = {r.vid >> 42: r.label for r in diffuse.flood(vox(pts, "label int"), tile).collect()}
        assert got == {z: 7 if z < 15 else 3 for z in range(30)}


def test_h_ladder_loses_its_rung(vox):
    rails = line(0, 80, 10, 10) + line(0, 80, 10, 20)
    rung = [(40, 10, x) for x in range(11, 20)]
    field = vox([(*p, 1.0, 0.0, 0.0) for p in rails] + [(*p, 1.0, 0.0, 0.0) for p in rung], "oz double, oy double, ox double")
    out = {(r.z, r.y, r.x) for r in sever.sever(field.select("vid", "z", "y", "x"), field).collect()}
    assert not {(40, 10, x) for x in range(13, 18)} & out
    assert set(rails) <= out


def test_ring_and_line_ends(vox):
    ring = [(0, 0, 1), (0, 0, 2), (0, 1, 3), (0, 2, 3), (0, 3, 2), (0, 3, 1), (0, 2, 0), (0, 1, 0)]
    fv = fragments.fragment_voxels(vox(ring + line(10, 20, 5, 5) + [(30, 1, 1)]))
    ends = {r.frag: r for r in fragments.fragment_ends(fv.cache()).collect()}
    v = lambda z, y, x: (z << 42) + (y << 21) + x
    assert (ends[v(0, 0, 1)].head, ends[v(0, 0, 1)].tail) == (v(0, 3, 2), v(0, 0, 1))
    assert (ends[v(10, 5, 5)].head, ends[v(10, 5, 5)].tail) == (v(10, 5, 5), v(19, 5, 5))
    assert ends[v(30, 1, 1)].head == ends[v(30, 1, 1)].tail


def test_path_positions(vox):
    pts = [(i, int(3 * np.sin(i / 3)) + 5, 5) for i in range(12)]
    fv = fragments.fragment_voxels(vox(pts)).cache()
    ends = fragments.fragment_ends(fv)
    got = sorted((r.seq, r.vid) for r in fragments.path_positions(fv, ends).collect())
    n = [s for s, _ in got]
    assert n == sorted(set(n))


def python_greedy(ends, cands, limit=35.0):
    parent = {f: f for f in ends}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    used, out = set(), []
    for c in sorted(cands, key=lambda c: (c[4], -c[5], c[0], c[1], c[2], c[3])):
        fa, ea, fb, eb, cost, _ = c
        ea, eb = (0 if ends[fa] else ea), (0 if ends[fb] else eb)
        if cost > limit or (fa, ea) in used or (fb, eb) in used or find(fa) == find(fb):
            continue
        parent[find(fa)] = find(fb)
        used |= {(fa, ea), (fb, eb)}
        out.append((c[0], c[1], c[2], c[3]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_distributed_matching_is_the_sequential_one(spark, seed):
    rnd = random.Random(seed)
    single = {f: rnd.random() < 0.2 for f in range(1, 40)}
    cands = set()
    while len(cands) < 160:
        a, b = sorted(rnd.sample(range(1, 40), 2))
        cands.add((a, rnd.randint(0, 1), b, rnd.randint(0, 1)))
    rows = [(*c, float(rnd.randint(1, 12) * 3), 0.5) for c in sorted(cands)]
    ends = spark.createDataFrame([(f, 1, f * 10, f * 10 + (0 if s else 1)) for f, s in single.items()], "frag long, length int, head long, tail long")
    c = spark.createDataFrame(rows, "frag_a long, end_a int, frag_b long, end_b int, cost double, score double")
    c = c.withColumns({"vid_a": F.lit(0).cast("long"), "vid_b": F.lit(0).cast("long")}).cache()
    want = python_greedy(single, rows)
    for bound in (matching.SOLVED, len(rows) - 1, 0):   # everything in a task; whole components; rounds
        got = matching.greedy_bridges(ends, c, bound=bound).collect()
        assert sorted((r.frag_a, r.end_a, r.frag_b, r.end_b) for r in got) == want


def test_long_rising_rows_take_few_rounds(spark):
    n = 12_000
    ends = spark.range(2 * n + 2).select(F.col("id").alias("frag"), F.lit(9).alias("length"), F.col("id").alias("head"), (F.col("id") + 1).alias("tail"))
    zero = {"vid_a": F.lit(0).cast("long"), "vid_b": F.lit(0).cast("long"), "score": F.lit(0.5)}
    shape = "frag_a long, end_a int, frag_b long, end_b int, cost double"
    joined = [(i, 1, i + 1, 0, 1 + i / n) for i in range(n)]                     # one long path, every bridge dearer than the last
    contested = [(i, 0, i + 1, 0, 1 + i / n) for i in range(n)]                  # every bridge shares an end with the next one
    for rows in (joined, contested):
        c = spark.createDataFrame(rows, shape).withColumns(zero)
        got = matching.greedy_bridges(ends, c, bound=100, max_rounds=3).collect()
        assert sorted((r.frag_a, r.end_a, r.frag_b, r.end_b) for r in got) == python_greedy({i: False for i in range(2 * n + 2)}, [(*r, 0.5) for r in rows])


def test_broken_line_becomes_one_chain(vox):
    pts = line(0, 20, 5, 5) + line(26, 50, 5, 5) + line(5, 45, 5, 25)
    field = vox([(z, 5, x, 1.0, 0.0, 0.0) for z in range(60) for x in (5, 25)], "oz double, oy double, ox double")
    r = resolve_skeleton(vox(pts), field, Params(), (60, 40, 40))
    ch = sorted((c.n_fragments, c.total_length) for c in r.chains.collect())
    assert ch == [(1, 40), (2, 44)]
    lab = {(x.z, x.y, x.x): x.label for x in r.labels.collect()}
    assert {lab[(z, 5, 5)] for z in range(50)} == {1} and {lab[(z, 5, 25)] for z in range(5, 45)} == {2}


def test_ranks_in_rounds_are_those_of_whole_pieces(vox):
    ring = [(0, 5, x) for x in range(3, 9)] + [(0, 9, x) for x in range(3, 9)] + [(0, y, 2) for y in range(6, 9)] + [(0, y, 9) for y in range(6, 9)]
    fv = fragments.fragment_voxels(vox(ring + line(3, 40, 1, 1) + line(5, 6, 20, 20))).cache()
    ends = fragments.fragment_ends(fv).cache()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(fragments.fragment_ends(fv, bound=1)) == rows(ends)
    assert rows(fragments.path_positions(fv, ends, bound=1)) == rows(fragments.path_positions(fv, ends))
    assert fv.count() == fragments.path_positions(fv, ends).count() and ends.filter("length > 15").count() == 2


def test_triangle_refuses_the_cycle(spark):
    ends = spark.createDataFrame([(f, 5, f * 10, f * 10 + 1) for f in (1, 2, 3)], "frag long, length int, head long, tail long")
    rows = [(1, 1, 2, 0, 1.0, 0.0), (2, 1, 3, 0, 1.0, 0.0), (1, 0, 3, 1, 2.0, 0.0)]
    c = spark.createDataFrame(rows, "frag_a long, end_a int, frag_b long, end_b int, cost double, score double").withColumns(
        {"vid_a": F.lit(0).cast("long"), "vid_b": F.lit(0).cast("long")})
    assert matching.greedy_bridges(ends, c).count() == 2


def test_diffusion_respects_components_and_locks(vox):
    fg = vox([(z, y, x) for z in range(10) for y in range(4) for x in range(4)] + [(z, 10, 10) for z in range(5)])
    skel = vox([(0, 1, 1, 1), (9, 2, 2, 2)], "label int")
    for p in (Params(), Params(diffuse_rule="nearest")):
        got = {(r.z, r.y, r.x): r.label for r in diffuse.diffuse(fg, skel, p).collect()}
        assert len(got) == 160 and got[(0, 1, 1)] == 1 and got[(9, 2, 2)] == 2
        assert got[(1, 1, 1)] == 1 and got[(8, 2, 2)] == 2


def test_stencil_needs_one_exchange(vox):
    plan = stencil.degree(vox([(1, 1, 1), (1, 1, 2)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_resolved_network_labels_and_fills_the_volume(spark):
    """Every step that the query names leaves its trace: labels by length, and each voxel of the volume in one of them."""
    from strandlake.plans.catalogue import QUERIES
    from strandlake.sources import lift

    d = "/root/testdata/sf0.001"
    rows = QUERIES["resolved_network"](spark, d).collect()
    kept = sorted((r for r in rows if r["label"] is not None), key=lambda r: r["label"])
    assert [r["label"] for r in kept] == list(range(1, len(kept) + 1)) and len(kept) > 5
    assert [r["root"] for r in kept] == [r["root"] for r in sorted(kept, key=lambda r: (-r["total_length"], r["root"]))]
    assert all((r["label"] is None) == (r["total_length"] < 5) for r in rows)
    assert all(r["skeleton_voxels"] == r["volume_voxels"] == 0 for r in rows if r["label"] is None)
    assert all(0 < r["skeleton_voxels"] <= r["volume_voxels"] for r in kept)
    fg = lift.foreground(spark, d).count()
    assert fg * 0.5 < sum(r["volume_voxels"] for r in kept) <= fg + sum(r["skeleton_voxels"] for r in kept)
