"""Curve thinning of a voxel mask, tile by tile, with the result independent of the tiling.

One pass looks at the voxels that are open in one of six directions and removes those that are no curve
end and whose removal keeps the topology. Candidates are re-tested in eight parity classes of absolute
coordinates; voxels of one class never touch, so a class can go at once. A decision therefore depends
on voxels at most nine steps away, and tiles that carry a halo of nine decide their own voxels exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.grid import DX, DY, DZ, MASK, OFFSETS_27, halo, tile_of, zyx
from strandlake.session import materialize, release

HALO = 9
TILE = 96
DIRECTIONS = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]

_O = np.array(OFFSETS_27)
_CENTRE = 13
_D = np.abs(_O[:, None, :] - _O[None, :, :])
_A26 = ((_D.max(2) == 1)).astype(np.float32)
_A26[_CENTRE] = _A26[:, _CENTRE] = 0
_N18 = (np.abs(_O).sum(1) <= 2) & (np.abs(_O).sum(1) > 0)
_A6 = ((_D.sum(2) == 1) & _N18[:, None] & _N18[None, :]).astype(np.float32)
_N6 = np.abs(_O).sum(1) == 1


def _spread(seed: np.ndarray, inside: np.ndarray, adj: np.ndarray) -> np.ndarray:
    cur = seed
    while True:
        nxt = (cur | ((cur.astype(np.float32) @ adj) > 0)) & inside
        if (nxt == cur).all():
            return cur
        cur = nxt


def _first(mask: np.ndarray) -> np.ndarray:
    out = np.zeros_like(mask)
    out[np.arange(len(mask)), mask.argmax(1)] = True
    return out & mask


def removable(n: np.ndarray) -> np.ndarray:
    """For neighbourhoods (m, 27): simple points that are not curve ends."""
    fg = n.copy()
    fg[:, _CENTRE] = False
    ok = fg.sum(1) > 1
    bg = ~n & _N18
    face = bg & _N6
    ok &= face.any(1)
    one_object = (_spread(_first(fg), fg, _A26) == fg).all(1)
    reach = _spread(_first(face), bg, _A6)
    return ok & one_object & (reach[:, _N6] == face[:, _N6]).all(1)


def _pass(direction):
    step = direction[0] * DZ + direction[1] * DY + direction[2] * DX
    offs = np.array([a * DZ + b * DY + c * DX for a, b, c in OFFSETS_27])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vid")
        v, own = pdf["vid"].to_numpy(), pdf["own"].to_numpy()
        live = np.ones(len(v), bool)

        def find(w):
            j = np.searchsorted(v, w)
            j[j == len(v)] = 0
            return np.where(v[j] == w, j, -1)

        def around(i):
            j = find((v[i][:, None] + offs[None, :]).ravel()).reshape(len(i), 27)
            return np.where(j >= 0, live[j], False)

        cand = np.nonzero(find(v + step) < 0)[0]
        cand = cand[removable(around(cand))] if len(cand) else cand
        par = ((v[cand] >> 42) & 1) * 4 + ((v[cand] >> 21) & 1) * 2 + (v[cand] & 1)
        for c in range(8):
            i = cand[par == c]
            if len(i):
                live[i[removable(around(i))]] = False
        return pd.DataFrame({"vid": v[live & own]})

    return run


def skeletonize(mask: DataFrame, tile: int = TILE, max_rounds: int = 10_000) -> DataFrame:
    """vid, z, y, x of the thinned mask. Passes in six directions in turn, until six in a row remove nothing."""
    cur = materialize(mask.select("vid").distinct())
    n, still = cur.count(), 0
    for k in range(max_rounds * len(DIRECTIONS)):
        t = cur.select("vid", *zyx("vid"))
        t = halo(t.withColumn("home", tile_of(tile)), tile, HALO).select("tile", "vid", (F.col("home") == F.col("tile")).alias("own"))
        past, cur = cur, materialize(t.groupBy("tile").applyInPandas(_pass(DIRECTIONS[k % len(DIRECTIONS)]), "vid long"))
        release(past)
        m = cur.count()
        n, still = m, still + 1 if m == n else 0
        if still == len(DIRECTIONS):
            return cur.select("vid", *zyx("vid"))
    raise RuntimeError("thinning did not finish")
