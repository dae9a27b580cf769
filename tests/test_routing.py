import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.grid import pack
from strandlake.operators import patches, routing

STEPS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if a or b or c]


def dijkstra(cost, a, b):
    """Exact distances, then the smallest previous voxel from the end back."""
    best, heap = {a: 0}, [(0, a)]
    w = lambda p, q: routing.HALF_STEP[sum(abs(x - y) for x, y in zip(p, q))] * (cost[p] + cost[q])
    near = lambda p: [q for q in (tuple(x + o for x, o in zip(p, s)) for s in STEPS) if q in cost]
    while heap:
        d, p = heapq.heappop(heap)
        if d > best[p]:
            continue
        for q in near(p):
            if d + w(p, q) < best.get(q, 1 << 62):
                best[q] = d + w(p, q)
                heapq.heappush(heap, (best[q], q))
    if b not in best:
        return None
    way = [b]
    while way[-1] != a:
        p = way[-1]
        way.append(min(q for q in near(p) if q in best and best[q] + w(p, q) == best[p]))
    return [(*p, best[p]) for p in way[::-1]]


def maze(rnd, size, share):
    return {(z, y, x): rnd.choice([200_000, 1_000_000, 1_000_000, 5_000_000]) for z in range(size) for y in range(size) for x in range(size) if rnd.random() < share}


@pytest.mark.parametrize("tile", [4, 32])
def test_routes_are_the_sequential_ones(spark, tile):
    rnd = random.Random(4)
    rows, asks, want = [], [], {}
    for space in (7, 8):
        cost = maze(rnd, 12, 0.25 + 0.1 * (space - 7))
        rows += [(space, *p, c) for p, c in cost.items()]
        for _ in range(4):
            a, b = rnd.sample(sorted(cost), 2)
            asks.append((len(asks), space, a, b))
            want[len(asks) - 1] = dijkstra(cost, a, b)
    asks.append((99, 8, asks[-1][2], asks[-1][2]))
    want[99] = [(*asks[-1][2], 0)]
    c = spark.createDataFrame(rows, "space long, z int, y int, x int, cost long")
    vid = lambda p: (p[0] << 42) + (p[1] << 21) + p[2]
    r = spark.createDataFrame([(i, s, vid(a), vid(b)) for i, s, a, b in asks], "route long, space long, src long, dst long")
    got = {}
    for x in routing.least_cost_routes(c, r, tile).orderBy("route", "seq").collect():
        got.setdefault(x.route, []).append((x.z, x.y, x.x, x.dist))
        assert x.seq == len(got[x.route]) - 1
    assert got == {k: v for k, v in want.items() if v}
    assert len(got) >= 5


def test_a_long_winding_route(spark):
    """One corridor over many tiles, 600 voxels long."""
    path = [(0, y, x if y % 4 == 0 else 59 - x) for y in range(0, 20, 2) for x in range(60)]
    path += [(0, y, 59 if y % 4 == 1 else 0) for y in range(1, 19, 2)]
    c = spark.createDataFrame([(0, *p, 1_000_000) for p in path], "space long, z int, y int, x int, cost long")
    r = spark.createDataFrame([(1, 0, 0, 18 << 21)], "route long, space long, src long, dst long")
    cost = {p: 1_000_000 for p in path}
    want = dijkstra(cost, (0, 0, 0), (0, 18, 0))
    got = [(x.z, x.y, x.x, x.dist) for x in routing.least_cost_routes(c, r, 16).orderBy("seq").collect()]
    assert got == want and len(got) > 550


def test_a_patch_is_routed_the_same_way():
    rnd = random.Random(9)
    for _ in range(6):
        cost = maze(rnd, 9, rnd.choice([0.3, 0.7, 1.0]))
        box = np.full((9, 9, 9), -1, dtype=np.int64)
        for p, c in cost.items():
            box[p] = c
        a, b = rnd.sample(sorted(cost), 2)
        got, want = patches.least_cost_path(box, a, b), dijkstra(cost, a, b)
        assert (got is None) == (want is None) and (want is None or [tuple(p) for p in got.tolist()] == [w[:3] for w in want])


def test_lane_and_box(spark):
    """The straight lane wins among equal ways, and nothing leaves the padded box."""
    c = spark.range(20 * 20 * 20).select(F.lit(0).cast("long").alias("space"), *[(F.floor(F.col("id") / d) % 20).cast("int").alias(n) for n, d in (("z", 400), ("y", 20), ("x", 1))],
                                         F.lit(8_000_000).cast("long").alias("cost"))
    r = spark.createDataFrame([(1, 0, (2 << 42) + (2 << 21) + 2, (17 << 42) + (9 << 21) + 4)], "route long, space long, src long, dst long")
    got = np.array([(x.z, x.y, x.x) for x in routing.least_cost_routes(c, r, 8, weight=0.2, pad=1).orderBy("seq").collect()])
    a, b = got[0], got[-1]
    u = (b - a) / np.linalg.norm(b - a)
    off = (got - a) - ((got - a) @ u)[:, None] * u
    assert len(got) == 16 and np.linalg.norm(off, axis=1).max() < 0.9


def test_no_way_and_no_requests(spark):
    c = spark.createDataFrame([(0, 0, 0, 0, 5), (0, 0, 0, 9, 5)], "space long, z int, y int, x int, cost long")
    r = spark.createDataFrame([(1, 0, 0, 9)], "route long, space long, src long, dst long")
    assert routing.least_cost_routes(c, r, 4).collect() == []
    assert routing.least_cost_routes(c, r.limit(0), 4).collect() == []
