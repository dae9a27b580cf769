"""Least-cost routes through voxel costs of any extent.

A step to one of 26 neighbours costs its length times the mean cost of both voxels. Costs are whole numbers, so
distances are exact, ties are decided by the smaller previous voxel, and a route does not depend on the tiling.

Only the rims of tiles are kept as state: the least distance at which a route enters each voxel of a tile from outside. A round
takes, of every route, the tiles whose entries improved and lie in the route's cheapest bucket, settles each tile as a
whole and hands its exits to the neighbours. A route is done when no entry is cheaper than its end. The way back is found without
walking tile after tile: a tile tells for each voxel of its surface where the way leaves the tile, and those jumps are followed by
pointer doubling. Routes and tiles are rows, so a busy tile is no hot group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.grid import MASK, OFFSETS_26, halo, pack, tile_of
from strandlake.operators.lookup import salted_lookup
from strandlake.session import materialize, release

TILE = 32
UNIT = 1_000_000                       # of a voxel cost of 1
HALF_STEP = {1: 5_000, 2: 7_071, 3: 8_660}   # half the length of a step, in ten-thousandths
FAR = np.int64(1) << np.int64(62)


def steps_of(shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Flat step to each of the 26 neighbours in a box, rising, and half its length."""
    step = np.array([(dz * shape[1] + dy) * shape[2] + dx for dz, dy, dx in OFFSETS_26])
    return step, np.array([HALF_STEP[abs(a) + abs(b) + abs(e)] for a, b, e in OFFSETS_26], dtype=np.int64)


def spread(c: np.ndarray, d: np.ndarray, shape: tuple[int, ...], front: np.ndarray, bound: np.ndarray | None = None) -> None:
    """Lowers the distances d (flat) of a box with barriers all around. Only voxels with news pass them on; beyond its bound a voxel takes none."""
    step, half = steps_of(shape)
    while len(front):
        near = front[:, None] + step
        new = d[front][:, None] + half * (c[front][:, None] + c[near])
        better = (c[near] >= 0) & (new < d[near])
        if bound is not None:
            better &= new <= bound[near]
        to, new = near[better], new[better]
        np.minimum.at(d, to, new)
        to = np.sort(to)
        front = to[np.append(True, to[1:] != to[:-1])[:len(to)]]


def padded(box: np.ndarray, fill: int) -> np.ndarray:
    out = np.full(tuple(n + 2 for n in box.shape), fill, dtype=np.int64)
    out[1:-1, 1:-1, 1:-1] = box
    return out


def settle(cost: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Least distances inside a box, from starting values; cost < 0 is a barrier."""
    c, d = padded(cost, -1), padded(np.where(cost >= 0, dist, FAR), FAR)
    flat = d.ravel()
    spread(c.ravel(), flat, c.shape, np.flatnonzero(flat < FAR))
    return d[1:-1, 1:-1, 1:-1]


def previous_of(c: np.ndarray, d: np.ndarray, shape: tuple[int, ...], at: np.ndarray) -> np.ndarray:
    """Smallest best previous voxel of each voxel ``at`` (flat, in a box with barriers all around); -1 where none explains its distance."""
    out = np.full(len(at), -1, dtype=np.int64)
    for step, half in zip(*steps_of(shape)):
        u = at + step
        fits = (out < 0) & (c[u] >= 0) & (d[u] < FAR) & (d[u] + half * (c[at] + c[u]) == d[at])
        out[fits] = u[fits]
    return out


def cheapest_way(cost: np.ndarray, a: tuple, b: tuple, first: np.ndarray | None = None) -> np.ndarray | None:
    """Voxels of the cheapest way from a to b (whole positive costs, negative ones are barriers); ties by the smaller previous voxel.

    A way through the ends and the voxels ``first`` alone gives a bound, where there is one. A voxel farther from a than the bound less what the
    way to b takes at least lies on no cheapest way: nothing is passed on to it.
    """
    c = padded(cost, -1)
    shape, c = c.shape, c.ravel()
    flat = lambda p: int(np.ravel_multi_index(tuple(v + 1 for v in p), shape))
    src, dst = flat(a), flat(b)
    if c[src] < 0 or c[dst] < 0:
        return None
    bound = None
    if first is not None:
        d = np.full(len(c), FAR, dtype=np.int64)
        d[src] = 0
        few = padded(first, 0).ravel() > 0
        few[[src, dst]] = True
        spread(np.where(few, c, -1), d, shape, np.array([src]))
        if d[dst] < FAR:
            z, y, x = np.ix_(*[np.abs(np.arange(n) - 1 - v) for n, v in zip(shape, b)])
            most = np.maximum(np.maximum(z, y), x)
            bound = d[dst] - most.ravel() * (2 * HALF_STEP[1] * int(c[c >= 0].min()))
    d = np.full(len(c), FAR, dtype=np.int64)
    d[src] = 0
    spread(c, d, shape, np.array([src]), bound)
    if d[dst] >= FAR:
        return None
    step, half = steps_of(shape)
    out = [dst]
    while True:
        u = out[-1] + step
        fits = np.flatnonzero((c[u] >= 0) & (d[u] + half * (c[out[-1]] + c[u]) == d[out[-1]]))
        if not len(fits):
            return np.stack(np.unravel_index(out[::-1], shape), 1) - 1
        out.append(int(u[fits[0]]))


def lane(shape_from, shape_to, a, b, weight: float) -> np.ndarray:
    """Extra cost of each voxel of a box: its distance from the straight line between a and b."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    z, y, x = np.ix_(*[np.arange(p, q, dtype=float) for p, q in zip(shape_from, shape_to)])
    u = b - a
    span = float((u * u).sum())
    if weight == 0 or span == 0:
        return np.zeros([q - p for p, q in zip(shape_from, shape_to)], dtype=np.int64)
    t = np.clip(((z - a[0]) * u[0] + (y - a[1]) * u[1] + (x - a[2]) * u[2]) / span, 0, 1)
    off = [(v - p - t * w) ** 2 for v, p, w in zip((z, y, x), a, u)]
    return np.floor(np.sqrt(off[0] + off[1] + off[2]) * (weight * UNIT) + 0.5).astype(np.int64)


def cost_tiles(cost: DataFrame, tile: int = TILE) -> DataFrame:
    """(space, tile, costs): the costs of a tile and of one voxel around it, packed; -1 where there is no voxel."""
    side = tile + 2

    def pack_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tile"].iloc[0])
        low = [(t >> s & MASK) * tile - 1 for s in (42, 21, 0)]
        box = np.full((side,) * 3, -1, dtype=np.int64)
        box[tuple(pdf[c].to_numpy(np.int64) - o for c, o in zip("zyx", low))] = pdf["cost"].to_numpy(np.int64)
        return pd.DataFrame({"space": [pdf["space"].iloc[0]], "tile": [t], "costs": [zlib.compress(box.tobytes(), 1)]})

    rows = halo(cost.select("space", "z", "y", "x", "cost"), tile, 1)
    return rows.groupBy("space", "tile").applyInPandas(pack_tile, "space long, tile long, costs binary")


def rims(side: int) -> tuple[np.ndarray, np.ndarray]:
    """(the outermost voxels of a box, those just inside them), as masks."""
    ring, shell = np.ones((side,) * 3, dtype=bool), np.zeros((side,) * 3, dtype=bool)
    ring[1:-1, 1:-1, 1:-1] = False
    shell[1:-1, 1:-1, 1:-1] = True
    shell[2:-2, 2:-2, 2:-2] = False
    return ring, shell


class _Tile:
    """One tile of one route: box of costs, starting values, and the voxels as ids."""

    def __init__(self, r, tile: int, weight: float, pad: int | None):
        t = int(r.tile)
        self.side = tile + 2
        self.low = [(t >> s & MASK) * tile - 1 for s in (42, 21, 0)]
        high = [o + self.side for o in self.low]
        a, b = ([int(v) >> s & MASK for s in (42, 21, 0)] for v in (r.src, r.dst))
        cost = np.frombuffer(zlib.decompress(r.costs), np.int64).reshape((self.side,) * 3) if r.costs is not None else np.full((self.side,) * 3, -1, dtype=np.int64)
        cost = np.where(cost >= 0, cost + lane(self.low, high, a, b, weight), -1)
        if pad is not None:
            for axis, (p, q, o) in enumerate(zip(a, b, self.low)):
                at = np.arange(o, o + self.side)
                out = (at < min(p, q) - pad) | (at > max(p, q) + pad)
                cost = np.where(np.expand_dims(out, [i for i in range(3) if i != axis]), -1, cost)
        self.cost = cost
        self.inner = np.full_like(cost, -1)
        self.inner[1:-1, 1:-1, 1:-1] = cost[1:-1, 1:-1, 1:-1]
        start = np.full((self.side,) * 3, FAR, dtype=np.int64)
        vids, dist, by = (np.array(c, dtype=np.int64) for c in (r.vids, r.dists, r.bys))
        at = self.flat(vids)
        start.ravel()[at] = dist
        self.dist = np.where(self.inner >= 0, start, FAR)
        spread(self.inner.ravel(), self.dist.ravel(), self.inner.shape, np.flatnonzero(self.dist < FAR))   # the ring is the barrier
        self.entry, self.by = start, dict(zip(at.tolist(), by.tolist()))

    def flat(self, vids: np.ndarray) -> np.ndarray:
        z, y, x = ((vids >> s & MASK) - o for s, o in zip((42, 21, 0), self.low))
        return (z * self.side + y) * self.side + x

    def vids(self, flat: np.ndarray) -> np.ndarray:
        z, y, x = (v + o for v, o in zip(np.unravel_index(flat, (self.side,) * 3), self.low))
        return (z << 42) + (y << 21) + x

    def outside(self) -> np.ndarray:
        """What the neighbours know of the ring at most: the voxels that gave entries, and ways from them along the ring."""
        start = np.full(self.cost.size, FAR, dtype=np.int64)
        cost = self.cost.ravel()
        for at, by in self.by.items():
            u = int(self.flat(np.array([by]))[0])
            if u != at:
                apart = [abs(a - b) for a, b in zip(np.unravel_index(at, self.cost.shape), np.unravel_index(u, self.cost.shape))]
                start[u] = min(start[u], self.entry.ravel()[at] - HALF_STEP[int(sum(apart))] * (cost[at] + cost[u]))
        return settle(np.where(rims(self.side)[0], self.cost, -1), start.reshape(self.cost.shape)).ravel()

    def exits(self, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(voxel, distance, previous voxel) of the ring around the tile, where a way out is no longer than the limit and news to the neighbours."""
        best, by = np.full(self.cost.size, FAR), np.full(self.cost.size, -1, dtype=np.int64)
        ring, shell = rims(self.side)
        ring = ring.ravel()
        src = np.flatnonzero(shell.ravel() & (self.dist.ravel() < limit))   # rising, so the smaller previous voxel comes first
        cost, dist, known = self.cost.ravel(), self.dist.ravel(), self.outside()
        for dz, dy, dx in OFFSETS_26[::-1]:
            step = (dz * self.side + dy) * self.side + dx
            to = src + step
            d = dist[src] + HALF_STEP[abs(dz) + abs(dy) + abs(dx)] * (cost[src] + cost[to])
            ok = ring[to] & (cost[to] >= 0) & (d <= np.minimum(limit, known[to]))
            to, d, s = to[ok], d[ok], src[ok]
            better = (d < best[to]) | (d == best[to]) & (s < by[to])
            best[to[better]], by[to[better]] = d[better], s[better]
        at = np.flatnonzero(best < FAR)
        return self.vids(at), best[at], self.vids(by[at])

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """(voxel, its previous voxel), flat, for each voxel reached; -1 where the way came from outside, or a smaller outside voxel explains it as well."""
        dist, entry = self.dist.ravel(), self.entry.ravel()
        at = np.flatnonzero(dist < FAR)
        inside = previous_of(self.inner.ravel(), dist, self.inner.shape, at)
        for v, by in self.by.items():
            i = int(np.searchsorted(at, v))
            if i < len(at) and at[i] == v and dist[v] == entry[v] and (inside[i] < 0 or by <= int(self.vids(inside[i:i + 1])[0])):
                inside[i] = -1
        return at, inside


def _tasks(rim: DataFrame, routes: DataFrame, tiles: DataFrame) -> DataFrame:
    """One row for each (route, tile) of rim: its entries, ends, limit and costs."""
    e = rim.groupBy("route", "tile").agg(F.collect_list(F.struct("vid", "dist", "by")).alias("e"))   # at most a tile's surface
    e = e.select("route", "tile", F.col("e.vid").alias("vids"), F.col("e.dist").alias("dists"), F.col("e.by").alias("bys"))
    tasks = salted_lookup(e.join(routes, "route"), tiles, ["space", "tile"], ["route"])
    return tasks.repartition(int(rim.sparkSession.conf.get("spark.sql.shuffle.partitions")), "route", "tile")   # few bytes, much work: not to be coalesced


def _explore(tile: int, weight: float, pad: int | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                t = _Tile(r, tile, weight, pad)
                limit = int(r.limit)
                end = int(t.flat(np.array([r.dst]))[0]) if r.home else -1
                if end >= 0:
                    limit = min(limit, int(t.dist.ravel()[end]))
                vid, dist, by = t.exits(limit)
                z, y, x = ((vid >> s & MASK) // tile for s in (42, 21, 0))
                yield pd.DataFrame({"route": r.route, "tile": (z << 42) + (y << 21) + x, "vid": vid, "dist": dist, "by": by})
                if end >= 0 and limit < FAR:   # the end itself, as an entry of no tile
                    yield pd.DataFrame({"route": [r.route], "tile": [-1], "vid": [r.dst], "dist": [limit], "by": [r.dst]})
    return run


def _jumps(tile: int, weight: float, pad: int | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                t = _Tile(r, tile, weight, pad)
                voxel, before = t.before()
                n = np.arange(len(voxel))
                to, steps = np.where(before >= 0, np.searchsorted(voxel, before), n), (before >= 0).astype(np.int64)
                while True:   # to the voxel at which the way entered the tile
                    nxt = to[to]
                    if (nxt == to).all():
                        break
                    steps, to = steps + steps[to], nxt
                place = np.stack(np.unravel_index(voxel, (t.side,) * 3))
                keep = ((place == 1) | (place == tile)).any(axis=0)
                if r.home:
                    keep |= voxel == int(t.flat(np.array([r.dst]))[0])
                at = np.flatnonzero(keep & (t.dist.ravel()[voxel] <= int(r.limit)))
                out = np.array([t.by.get(i, -1) for i in voxel[to[at]].tolist()], dtype=np.int64)
                more = (out >= 0) & (out != t.vids(voxel[to[at]]))   # the start entered from itself
                yield pd.DataFrame({"route": r.route, "v": t.vids(voxel[at]), "u": out, "steps": steps[at] + 1})[more]
    return run


def _pieces(tile: int, weight: float, pad: int | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                t = _Tile(r, tile, weight, pad)
                before = dict(zip(*(v.tolist() for v in t.before())))
                way, place = [], []
                for v, back in zip(r.marks, r.backs):
                    at = int(t.flat(np.array([v]))[0])
                    while at >= 0:
                        way.append(at)
                        place.append(int(back))
                        at, back = before.get(at, -1), back + 1
                flat = np.array(way, dtype=np.int64)
                yield pd.DataFrame({"route": r.route, "back": np.array(place, dtype=np.int64), "vid": t.vids(flat), "dist": t.dist.ravel()[flat]})
    return run


def least_cost_routes(cost: DataFrame, requests: DataFrame, tile: int = TILE, weight: float = 0.0, pad: int | None = None, bucket: int | None = None,
                      max_rounds: int = 100_000) -> DataFrame:
    """(route, seq, vid, z, y, x, dist) of the cheapest way from src to dst; a route without a way has no rows.

    ``cost``: space, z, y, x, cost (whole, positive, in UNIT; voxels that are missing are barriers); ``requests``: route, space, src, dst (voxel
    ids, route unique). ``weight`` makes voxels dearer by their distance from the straight line; ``pad`` keeps a route in the box of
    its ends, grown by so much. ``bucket`` is the width of a round's distances (default: what crosses four tiles at unit cost).
    """
    bucket = bucket or 8 * HALF_STEP[1] * UNIT * tile
    home = tile_of(tile, *[F.shiftright("dst", s).bitwiseAND(F.lit(MASK)) for s in (42, 21, 0)])
    start = tile_of(tile, *[F.shiftright("src", s).bitwiseAND(F.lit(MASK)) for s in (42, 21, 0)])
    tiles = materialize(cost_tiles(cost, tile))
    req = materialize(requests.select("route", "space", "src", "dst", home.alias("end"), start.alias("start")))
    rim = materialize(req.select("route", F.col("start").alias("tile"), F.col("src").alias("vid"), F.lit(0).cast("long").alias("dist"),
                                 F.col("src").alias("by"), F.lit(True).alias("news")))
    shape = "route long, tile long, vid long, dist long, by long"
    for _ in range(max_rounds):
        found = rim.filter("tile = -1").select("route", F.col("dist").alias("known"))
        open_ = rim.filter("tile >= 0 and news").groupBy("route", "tile").agg(F.min("dist").alias("least"))
        open_ = open_.join(found, "route", "left").filter(F.col("known").isNull() | (F.col("least") < F.col("known")))
        first = open_.groupBy("route").agg(((F.floor(F.min("least") / bucket) + 1) * bucket).alias("upto"))
        now = materialize(open_.join(first, "route").filter("least < upto").select("route", "tile"))
        if now.isEmpty():
            break
        routes = req.join(found, "route", "left").select("route", "space", "src", "dst", "end", F.coalesce("known", F.lit(int(FAR))).alias("limit"))
        work = _tasks(rim.filter("tile >= 0").join(now, ["route", "tile"], "left_semi").select("route", "tile", "vid", "dist", "by"), routes, tiles)
        sent = work.withColumn("home", F.col("end") == F.col("tile")).mapInPandas(_explore(tile, weight, pad), shape)
        old = rim.join(now.withColumn("went", F.lit(True)), ["route", "tile"], "left").select(
            "route", "tile", "vid", "dist", "by", (F.col("news") & F.col("went").isNull()).alias("news"), F.lit(True).alias("old"))
        both = old.union(sent.select("route", "tile", "vid", "dist", "by", F.lit(True), F.lit(False)))
        best = F.min(F.struct("dist", "by")).alias("b")
        merged = both.groupBy("route", "tile", "vid").agg(best, F.min(F.when(F.col("old"), F.col("dist"))).alias("had"), F.max(F.when(F.col("old"), F.col("news"))).alias("news"))
        fresh = F.coalesce(F.col("b.dist") < F.col("had"), F.lit(True)) | F.coalesce("news", F.lit(False))
        past, rim = rim, materialize(merged.select("route", "tile", "vid", F.col("b.dist").alias("dist"), F.col("b.by").alias("by"), fresh.alias("news")))
        release(past, now)
    else:
        raise RuntimeError("routing did not finish")
    # the way back
    ends = materialize(rim.filter("tile = -1").select("route", F.col("dist").alias("limit")))
    routes = req.join(ends, "route").select("route", "space", "src", "dst", "end", "limit")
    near = rim.filter("tile >= 0").join(ends, "route").filter("dist <= limit").select("route", "tile", "vid", "dist", "by")
    work = _tasks(near, routes, tiles).withColumn("home", F.col("end") == F.col("tile"))
    jump = materialize(work.mapInPandas(_jumps(tile, weight, pad), "route long, v long, u long, steps long"))
    marks = materialize(routes.select("route", F.col("dst").alias("v"), F.lit(0).cast("long").alias("back")))
    while True:
        ahead = marks.join(jump, ["route", "v"]).select("route", F.col("u").alias("v"), (F.col("back") + F.col("steps")).alias("back"))
        more = materialize(marks.union(ahead).distinct())
        if more.count() == marks.count():
            break
        second = jump.select("route", F.col("v").alias("u"), F.col("u").alias("w"), F.col("steps").alias("more"))
        longer = materialize(jump.join(second, ["route", "u"]).select("route", "v", F.col("w").alias("u"), (F.col("steps") + F.col("more")).alias("steps")))
        release(marks, jump)
        marks, jump = more, longer
    here = marks.withColumn("tile", tile_of(tile, *[F.shiftright("v", s).bitwiseAND(F.lit(MASK)) for s in (42, 21, 0)]))
    here = here.groupBy("route", "tile").agg(F.collect_list(F.struct("v", "back")).alias("m")).select(
        "route", "tile", F.col("m.v").alias("marks"), F.col("m.back").alias("backs"))   # at most a tile's surface
    pieces = work.join(here, ["route", "tile"]).mapInPandas(_pieces(tile, weight, pad), "route long, back long, vid long, dist long")
    pieces = materialize(pieces.distinct())
    size = pieces.groupBy("route").agg(F.max("back").alias("last"))
    xyz = [F.shiftright("vid", s).bitwiseAND(F.lit(MASK)).cast("int").alias(c) for c, s in zip("zyx", (42, 21, 0))]
    return pieces.join(size, "route").select("route", (F.col("last") - F.col("back")).alias("seq"), "vid", *xyz, "dist")
