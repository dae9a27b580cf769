import random

from strandlake.operators import morph


def sequential(stamps, existing, tries, least):
    """One stamp after the other: the first try that keeps clear of all centre lines so far."""
    lines = {p: list(v) for p, v in existing.items()}
    out = []
    for s in sorted(tries):
        patch = tries[s][0]
        for t, o in enumerate(tries[s][1]):
            at = [tuple(a + b for a, b in zip(p, o)) for p in stamps[s]]
            if all(sum((a - b) ** 2 for a, b in zip(p, q)) >= least ** 2 for p in at for q in lines.get(patch, [])):
                lines.setdefault(patch, []).extend(at)
                out.append((s, patch, t, *o))
                break
    return sorted(out)


def test_stamps_are_placed_as_one_after_the_other(spark):
    rnd = random.Random(6)
    existing = {p: [(rnd.randrange(40), rnd.randrange(40), rnd.randrange(40)) for _ in range(4)] for p in (1, 2, 3)}
    stamps = {s: [(z, 0, z // 2) for z in range(6)] for s in range(40)}
    tries = {s: (rnd.choice([1, 2, 3, 4]), [(rnd.randrange(18), rnd.randrange(18), rnd.randrange(18)) for _ in range(4)]) for s in stamps}
    st = spark.createDataFrame([(s, *p, 1.0, 0.0, 1.0, 0.0) for s, v in stamps.items() for p in v], "stamp long, z int, y int, x int, intensity double, oz double, oy double, ox double")
    ex = spark.createDataFrame([(p, *q, 1.0, 1.0, 0.0, 0.0) for p, v in existing.items() for q in v], "patch long, z int, y int, x int, intensity double, oz double, oy double, ox double")
    tr = spark.createDataFrame([(s, p, t, *o) for s, (p, v) in tries.items() for t, o in enumerate(v)], "stamp long, patch long, try int, z0 int, y0 int, x0 int")
    want = sequential(stamps, existing, tries, 6.0)
    got = morph.separable_offsets(st, ex, tr)
    assert sorted((r.stamp, r.patch, r["try"], r.z0, r.y0, r.x0) for r in got.collect()) == want
    assert 15 < len(want) < 40 and any(w[2] > 0 for w in want)
    few = sorted(w for w in want if w[1] == 1)[:3]
    some = tr.filter("patch = 1 and stamp <= %d" % few[-1][0])
    merged = morph.place_stamps(ex, st, some)
    voxels = {(1, *(a + b for a, b in zip(p, w[3:]))) for w in few for p in stamps[w[0]]} | {(p, *q) for p, v in existing.items() for q in v}
    assert {(r.patch, r.z, r.y, r.x) for r in merged.collect()} == voxels
    assert morph.separable_offsets(st.limit(0), ex, tr.limit(0)).collect() == []
