import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import exact, periodic


def lowered(text):
    return (text or "").encode().lower()


def plain_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lowered(text)].append(i)
    out = []
    for t, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        kept = ids.index(best)
        out += [(i, best, len(ids), n == kept, hashlib.sha256(t).hexdigest()) for n, i in enumerate(ids)]
    return out


def order(rows):
    return sorted(rows, key=repr)


def groups_of(docs, counters):
    return order((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in exact.exact_groups(docs, counters=counters).collect())


@pytest.mark.parametrize("counters", [2, exact.COUNTERS])
def test_exact_groups(make, corpus, counters):
    rows = corpus + [(200 + i, "Hot  Text É" if i % 2 else "hot  text É", "a") for i in range(90)] + [(50, "hot  text é", "a"), (289, "HOT  TEXT É", "b")]
    assert groups_of(make(rows).repartition(7), counters) == order(plain_groups([(i, t) for i, t, _ in rows]))


def test_exact_empty_table(make):
    assert exact.exact_groups(make([])).collect() == []
    assert exact.distinct_documents(make([])).collect() == []


def test_distinct_documents(make, corpus):
    rows = corpus + [(300, "hot", "a")] * 60 + [(i, "HOT", "b") for i in range(240, 290)] + [(None, "x", "a"), (None, "X", "a")]
    docs = make(rows)
    for counters in (3, exact.COUNTERS):
        got = exact.distinct_documents(docs.repartition(5), counters=counters)
        assert got.columns == docs.columns
        want = order((keep, digest) for i, keep, n, kept, digest in plain_groups([(i, t) for i, t, _ in rows]) if kept)
        assert order((r["doc_id"], hashlib.sha256(lowered(r["text"])).hexdigest()) for r in got.collect()) == want


def test_frequent_digests_are_never_missed():
    rnd = random.Random(5)
    for _ in range(60):
        size, counters = rnd.randint(1, 400), rnd.randint(1, 12)
        values = [b"%032d" % min(int(rnd.expovariate(rnd.choice([0.1, 1]))), 60) for _ in range(size)]
        keys, counts = np.empty(0, "V32"), np.empty(0, np.int64)
        for at in range(0, size, 37):   # parts are merged like summaries
            part, n = exact.reduced(exact.as_keys(pa.array(values[at:at + 37], pa.binary())), np.ones(len(values[at:at + 37]), np.int64), counters)
            keys, counts = exact.reduced(np.concatenate([keys, part]), np.concatenate([counts, n]), counters)
        assert len(keys) <= counters
        held = {k.tobytes() for k in keys}
        assert all(v in held for v, n in Counter(values).items() if n > size / (counters + 1))


def plain_runs(w, least, times):
    """Every period on its own: stretches in which words one period apart agree."""
    n, out, seen = len(w), [], set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and (i, j + q) not in seen:   # smaller periods came first
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_are_all_found():
    rnd, found = random.Random(1), 0
    for _ in range(1200):
        k = rnd.randint(1, 4)
        w = [rnd.randrange(k) for _ in range(rnd.randint(0, 150))]
        for _ in range(rnd.randint(0, 3)):
            unit, size, at = [rnd.randrange(k + 2) for _ in range(rnd.randint(1, 30))], rnd.randint(1, 120), rnd.randint(0, len(w))
            w[at:at] = (unit * (size // len(unit) + 1))[:size]
        least, times = rnd.choice([(24, 3), (6, 2), (8, 3), (10, 4), (5, 2)])
        got = periodic.runs_of_texts([[b"%d" % x for x in w]], least, times)[0]
        assert got == plain_runs(w, least, times)
        found += len(got)
    assert found > 2000


def test_very_long_texts_with_runs():
    begin = time.time()
    assert periodic.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert periodic.find_runs(np.arange(200_000) % 11) == [(0, 200_000, 11)]
    assert periodic.find_runs(np.array([i if i % 20 == 0 else -(i % 20) for i in range(100_000)])) == []   # one passage, 5,000 left words
    assert time.time() - begin < 60


def plain_row(i, text):
    words = lowered("").join([(text or "").encode()]).split()
    n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(words, 24, 3)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-r[1] * 10 ** 12 // r[2], r[0], r[2])) if runs else (None,) * 3
    return (i, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())


def test_periodic_rows(spark, make, corpus, tmp_path):
    rows = corpus + [(1000 + i, ("lo la " * 30 if i % 3 else "a b c\n" * 9) + "end %d" % i, "a") for i in range(60)]
    make(rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = order(tuple(r) for r in periodic.op12_periodic(spark, str(tmp_path)).collect())
    assert got == order(plain_row(i, t) for i, t, _ in rows)
    assert sum(r[1] > 0 for r in got) > 40


def test_periodic_runs_and_text(make):
    docs = make([(1, "x " + "a b " * 12 + "c", "a"), (2, None, "a"), (3, "", "a"), (None, "é " * 24, "a"), (None, "é " * 24, "a"), (4, "é " * 23, "a")])
    got = {(r["doc_id"], r["text"], tuple(tuple(x) for x in r["runs"])) for r in periodic.periodic_runs(docs).collect()}
    assert got == {(1, "x a b c", ((1, 24, 2),)), (2, "", ()), (3, "", ()), (None, "é", ((0, 24, 1),)), (4, " ".join("é" * 23), ())}
    assert periodic.periodic_runs(docs.limit(0)).collect() == []
