import hashlib
import random
import re
import time

from strandlake.llm import pii, toxicity

# the patterns as the contract states them
PLAIN = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "email"), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "ip"),
         (r"[0-9]([\x20-]?[0-9])+", "card"), (r"\+[0-9][\x20().0-9-]+[0-9]", "phone"))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, (pattern, kind) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rnd, found = random.Random(8), 0
    pieces = ["a@b.c", "%d@e.f", "1.2.3.4", ".5", "@", "..", "4111 1111 1111 1111", "+49 (30) 123-4567", "+", "-", " ", "x", "9", "256", "é", "\n", "0001.1.1.1", "a.b-c", "4111111111111111"]
    for _ in range(6000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
        found += len(pii.base_spans(text))
    assert found > 3000


def test_rows_of_personal_data(spark, make, corpus, tmp_path):
    """Counts and digest of the query's own rows."""
    extra = ["mail a.b@c.de or %x@y.z.com, call +1 (555) 123-4567", "card 4111 1111 1111 1111 from 10.0.0.1 and 300.1.1.1", "10.1.2.3" * 40]
    rows = corpus + [(500 + i, t, "a") for i, t in enumerate(extra)]
    make(rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((repr(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.op5_pii(spark, str(tmp_path)).collect())
    want = []
    for i, t, _ in rows:
        spans = plain_spans(t or "")
        listed = ",".join(f"{PLAIN[k][1]}:{a}:{b}" for a, k, b in spans)
        want.append((repr(i), *(sum(k == n for _, k, _ in spans) for n in range(4)), hashlib.sha256(listed.encode()).hexdigest()))
    assert got == sorted(want)


def test_very_long_runs_are_read_once():
    begin = time.time()
    for text in ("7" * 1_000_000, "a" * 1_000_000 + " x@y.z", "a@" * 200_000, "1." * 300_000, "+1" * 200_000, "10.1.2.3 " * 20_000 + "1111-1111-1111-1111 " * 5_000):
        pii.marked(text)
    assert time.time() - begin < 30


def test_labels_that_disagree(spark):
    labels = spark.createDataFrame([(0, 1), (0, 1), (0, 0), (2, 1), (2, 0), (3, 1), (5, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(0, "a"), (0, "a"), (2, "b"), (3, "c"), (5, "c"), (9, "d")], "doc_id long, text string")
    used = {i for i in (0, 2, 3, 5) if __import__("zlib").crc32(str(i).encode()) % 3 != 1}
    want = {t: n for i, t, n in ((0, "a", 1), (2, "b", 0)) if i in used}
    both = [n for i, n in ((3, 1), (5, 0)) if i in used]
    if both:
        want["c"] = int(sum(both) * 2 > len(both))
    assert {r["text"]: r["toxic"] for r in toxicity.training_rows(docs, labels, 100).collect()} == want
