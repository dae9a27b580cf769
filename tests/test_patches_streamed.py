"""Patches are streamed, and routes are searched within a bound: what that must not change."""

import numpy as np
import pandas as pd

from strandlake.operators import patches, routing


def test_a_bound_does_not_change_the_way():
    rng = np.random.default_rng(4)
    for k in range(40):
        f = np.round(rng.random((7, 9, 8)) * 2) if k % 2 else np.ones((7, 9, 8))   # many ties
        cost = np.floor(np.where(f > 0, 1.0 / (f * f + 0.1), 8.0) * routing.UNIT + 0.5).astype(np.int64)
        a, b = (tuple(int(v) for v in rng.integers(0, 7, 3)) for _ in "ab")
        if a != b:
            assert np.array_equal(routing.cheapest_way(cost, a, b), routing.cheapest_way(cost, a, b, f > 0))


def test_groups_are_whole_across_batches():
    ids = np.repeat([3, 5, 9], [4, 1, 6])
    frames = [pd.DataFrame({"patch": ids[i:j], "v": np.arange(i, j)}) for i, j in ((0, 0), (0, 2), (2, 5), (5, 7), (7, 11))]
    got = [(g["patch"].tolist(), g["v"].tolist()) for g in patches.whole_groups(iter(frames), "patch")]
    assert got == [([3] * 4, [0, 1, 2, 3]), ([5], [4]), ([9] * 6, [5, 6, 7, 8, 9, 10])]


def test_patches_cost_no_group_call_each(spark, capsys):
    df = spark.range(400).select((patches.F.col("id") % 50).alias("patch"), *[(patches.F.col("id") % k).cast("int").alias(c) for c, k in zip("zyx", (5, 7, 3))])
    out = patches.edt(df, 8)
    capsys.readouterr()
    out.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out
    assert out.count() == 400
