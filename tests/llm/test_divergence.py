import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandlake.llm import divergence
from strandlake.llm.transducer import Transducer

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_transducer_holds_its_terms_and_is_minimal():
    rnd = random.Random(2)
    for size in (0, 1, 2, 40, 600):
        terms = sorted({bytes(rnd.choice(b"abc\xc3\xa9") for _ in range(rnd.randint(0, 7))) for _ in range(size)})
        made = Transducer.load(Transducer.build(terms).dump())
        assert made.ordinals(terms).tolist() == list(range(len(terms)))
        assert [made.term(i) for i in range(len(terms))] == terms
        others = [t for t in (bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(0, 9))) for _ in range(300)) if t not in terms]
        assert set(made.ordinals(others).tolist()) <= {-1}
        futures = {t[i:] for t in terms for i in range(len(t) + 1)}
        classes = {frozenset(f[len(p):] for f in terms if f.startswith(p)) for p in {t[:i] for t in terms for i in range(len(t) + 1)}}
        assert len(made.final) == max(1, len(classes)) and (not futures or len(made.final) <= len(futures) + 1)


def test_shares_are_exact():
    rnd = random.Random(3)
    total = np.array([rnd.randint(1, 10 ** 14) for _ in range(500)])
    count = np.array([rnd.randint(0, int(t)) for t in total])
    assert divergence.shares(count, total).tolist() == [1 + 10 ** 9 * (c + 1) // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]


def plain(rows, least=3, top=200):
    """(text, lang, source) by the definition."""
    rows = [tuple(x or "" for x in r) for r in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in held:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        sources = sorted(s for x, s in counts if x == lang)
        share = {}
        for s in [*sources, None]:
            c = counts[lang, s] if s is not None else sum((counts[lang, x] for x in sources), Counter())
            total = sum(c[t] for t in kept)
            share[s] = {t: 1 + 10 ** 9 * (c[t] + 1) // (total + len(kept)) for t in kept}
        distance = lambda a, b, t: (share[a][t] - share[b][t]) ** 2 // share[b][t]
        for a in sources:
            pairs = [(b, sum(distance(a, b, t) for t in kept)) for b in sources if b != a]
            terms = [(t, distance(a, None, t)) for t in kept if counts[lang, a][t] and share[a][t] > share[None][t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, a, part, item, f, i + 1) for i, (item, f) in enumerate(items[:most])}
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefgEFGéßあ") for _ in range(rnd.randint(1, 4))) for _ in range(700)]
    out = []
    for i in range(150):
        lang = rnd.choice(["en", "en", "de", None])
        some = rnd.sample(words, 200)
        text = "".join(rnd.choice(some) + rnd.choice(" ,.\n0@[") for _ in range(rnd.randint(0, 300)))
        out.append((text, lang, rnd.choice(["s1", "s2", "é", None])))
    out += [("Hot " * 400, "en", "s1")] * 40 + [(None, "en", "empty"), ("", "fr", "a"), (None, "fr", "b"), ("x y", "fr", None), ("12 34", "it", "only")]
    return out + [("z" * 3000, "en", "s2")] * 3


def result(docs, **kw):
    got = [tuple(r) for r in divergence.source_divergence(docs, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("way", [{}, {"limit": 0, "bits": 5}, {"bits": 4, "top": 20}, {"tile": 2, "cells": 64}])
def test_divergence(spark, rows, way):
    docs = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "text string, lang string, source string, idx int, term string, ordinal int")
    assert result(docs.repartition(6), **way) == plain(rows, top=way.get("top", 200))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(docs).collect() == []
    assert divergence.source_divergence(docs, limit=-1).collect() == []
