"""Neighbours, archives and the pipeline."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import neighbours, warc


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist(), 1) for i in range(3000)]
    x += [(3000 + i, x[5][1], 1) for i in range(60)]                       # copies: ties
    bad = [(4000, None, 1), (4001, [0.0] * 16, 1), (4002, [float("nan")] * 16, 1), (4003, [None] * 16, 1), (4004, [1.0] * 3, 1), (None, [1.0] * 16, 1), (4005, [], 1)]
    df = spark.createDataFrame(x + bad, "vec_id long, embedding array<double>, part int")
    rows = neighbours.search(df, F.col("vec_id") % 20 == 0).collect()
    ids, m = np.array([r[0] for r in x]), np.array([r[1] for r in x])
    got: dict = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = m @ m[q]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(v != q and abs(s[v] - e) < 1e-9 for _, v, e in mine)
        assert [(-e, v) for _, v, e in mine] == sorted((-e, v) for _, v, e in mine)
        s[q] = -np.inf
        hit += len({v for _, v, _ in mine} & set(np.lexsort((ids, -np.round(s, 9)))[:20]))
    assert hit / (20 * len(got)) >= 0.9
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    once = lambda t: sorted(tuple(r) for r in t.filter("query_id in (40, 60)").collect())
    few = df.filter("vec_id < 400")
    again = few.union(few.filter("vec_id in (40, 60)"))   # repeated query rows ask once
    found = once(neighbours.search(again, F.col("vec_id") % 20 == 0, nearest=30))
    assert [r[1] for r in found] == 2 * list(range(1, 31)) and len({(r[0], r[2]) for r in found}) >= 58
    two = neighbours.search(df.filter("vec_id in (0, 1)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in two] == [(0, 1, 1)]


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(800, 8))
    part = neighbours.balanced_parts(x, neighbours.neighbour_graph(x, 10), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(800 / 8 * 1.05)


PAGES = [(1, "<p>a</p>"), (2, "<p>a</p>"), (3, "b WARC/1.1\r\nx"), (4, None), (5, ""), (6, "é" * 5000), (2, "<p>a</p>"), (None, "<p>a</p>"), (None, "only null")]


def test_archive_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, h, "u", 1) for i, h in PAGES], "page_id long, html string, digest string, size int")
    folder = f"file://{tmp_path}/warc"
    warc.write_archives(df, folder)
    rows = warc.read_archives(spark, folder).collect()
    assert all(r["reason"] is None for r in rows)
    best: dict = {}
    for i, h in PAGES:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want, seen = Counter(), set()
    for i, h in sorted(PAGES, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (h or "").encode()
        top = (-1 if i is None else i) == best[h or ""] and (i, h or "") not in seen
        seen.add((i, h or ""))
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if top else "revisit", None if top else best[h or ""] if best[h or ""] >= 0 else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["kind"], r["refers_to"]) for r in rows) == want
    assert {bytes(r["payload"]) for r in rows if r["kind"] == "response"} == {(h or "").encode() for _, h in PAGES}
    warc.write_archives(df.limit(0), f"{folder}-empty")
    assert warc.read_archives(spark, f"{folder}-empty").count() == 0


def one(i, body, packed):
    data = warc.record("response", i, warc.sha1_base32(body), len(body), body, None)
    return warc.member(data) if packed else data


def test_salvage_recovers_what_follows_damage():
    rnd = random.Random(8)
    for packed in (True, False):
        parts = [one(i, rnd.randbytes(200) + b"WARC/1.1\r\n" + bytes([i]), packed) for i in range(12)]
        clean, gaps = warc.salvage(b"\0".join(parts) if packed else b"".join(parts))
        assert [r["fields"]["warc-record-id"] for r in clean] == [f"<urn:page:{i}>" for i in range(12)] and gaps == []
        for hurt in (0, 5, 11):
            bad = list(parts)
            half = len(bad[hurt]) // 2
            bad[hurt] = bad[hurt][:half] + bytes([bad[hurt][half] ^ 255]) + bad[hurt][half + 1:]
            found, gaps = warc.salvage(b"".join(bad))
            assert [r["fields"]["warc-record-id"] for r in found] == [f"<urn:page:{i}>" for i in range(12) if i != hurt]
            at = sum(map(len, bad[:hurt]))
            assert gaps and gaps[0][0] == at and gaps[-1][1] == at + len(bad[hurt])
        cut, gaps = warc.salvage(b"junk" + b"".join(parts)[:-30])
        assert len(cut) == 11 and gaps[0][:2] == (0, 4)
    assert warc.salvage(b"") == ([], [])
    both = warc.member(warc.record("response", 1, warc.sha1_base32(b"x"), 1, b"x", None) + b"WARC/1.1\r\nbroken" + warc.record("response", 2, warc.sha1_base32(b"y"), 1, b"y", None))
    found, gaps = warc.salvage(both)
    assert [r["block"] for r in found] == [b"x", b"y"] and len(gaps) == 1


def test_pipeline(spark, make, corpus, tmp_path):
    import corpus_pipeline as pipe
    from tests.llm.test_documents import plain_lines

    rows = [(i, t, s) for i, t, s in corpus] + [(200, "you idiot, you stupid worthless moron", "a")]
    folder = str(tmp_path)
    make(rows).select(*pipe.COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for k, (name, stage) in enumerate(pipe.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out[name] = docs.collect()
        if k < 4:
            assert docs.columns == pipe.COLUMNS
    assert Counter((r["doc_id"], r["text"]) for r in out["toxicity"]) == Counter((i, t) for i, t, _ in corpus)
    assert Counter((r["doc_id"], r["text"]) for r in out["line dedup"]) == plain_lines(corpus)
    assert len(out["near duplicates"]) < len(out["line dedup"])
    assert {r["doc_id"] for r in out["mixing"]} <= {r["doc_id"] for r in out["near duplicates"]}
    starts = Counter(r["doc_id"] for r in out["packing"] if r["start"] == 0)
    assert starts == Counter(r["doc_id"] for r in out["mixing"])
    assert Counter(map(tuple, pipe.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())) == Counter(
        (r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in out["packing"])
