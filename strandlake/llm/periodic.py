"""Periodic runs of words: maximal pairs from a bottom-up LCP-interval tree with left-word classes.

A run is a stretch of words with smallest period q that no neighbouring word extends; it counts from ``least`` words
and ``times`` periods on. Its first word x and x + q start a maximal pair: equal for length - q words, with different
words on their left (or none). So every run shows up as a maximal pair, and a maximal pair (x, x + d) of l words with
l + d >= least and l + d >= times * d is a run as it stands. Pairs at multiples of q name the same stretch; the smallest wins.

A null or empty text has no words and no runs. Texts are taken whole; work is n log n in the words of a text. A null id
leaves its text as it is in the query. Repeated rows give repeated results, other columns are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import table, text_or_empty

LEAST = 24      # words of a run
TIMES = 3       # periods of a run
CHUNK = 1 << 19   # words that are screened at once; a longer text is a chunk of its own

Run = tuple[int, int, int]   # start, length, period


def shared_least(least: int, times: int) -> int:
    """Fewest words that the two ends of a run's pair share: l >= (times - 1) * d and l + d >= least."""
    return -(-least * (times - 1) // times)


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling."""
    n = len(ranks)
    rank, step = np.unique(ranks, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, step = fresh, 2 * step
        if rank[order[-1]] == n - 1 or step >= n:
            return order


def common_prefixes(words: list[int], order: list[int]) -> list[int]:
    """lcp[i]: words that the suffixes order[i - 1] and order[i] share."""
    n = len(words)
    rank, lcp, h = [0] * n, [0] * n, 0
    for i, at in enumerate(order):
        rank[at] = i
    for at in range(n):
        if rank[at] == 0:
            h = 0
            continue
        other = order[rank[at] - 1]
        stop = n - max(at, other)
        while h < stop and words[at + h] == words[other + h]:
            h += 1
        lcp[rank[at]] = h
        h = max(h - 1, 0)
    return lcp


def find_runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of a sequence of word numbers, by start and period.

    The tree is walked bottom-up with a stack. A node of l shared words lists its positions in order; the left word of
    a position is its class. Joining a child compares each of its positions with the nearest one on either side:
    occurrences of a node's words that lie at most l / (times - 1) apart form a progression, in which all but the first
    have one class, so a pair of different classes at the smallest distance is a pair of neighbours.
    The smaller list moves into the larger one.
    """
    n, low = len(words), shared_least(least, times)
    if n < least:
        return []
    text, order = words.tolist(), suffix_array(words).tolist()
    lcp = common_prefixes(text, order)
    ends: dict[tuple[int, int], int] = {}

    def joined(a: list[int], b: list[int], shared: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            at = bisect_left(a, x)
            for y in a[max(0, at - 1):at + 1]:
                first, last = (x, y) if x < y else (y, x)
                d = last - first
                if d * (times - 1) <= shared and d + shared >= least and (first == 0 or text[first - 1] != text[last - 1]):
                    key = (first, last + shared)
                    if d < ends.get(key, n):
                        ends[key] = d
        if len(b) * 8 < len(a):
            for x in b:
                insort(a, x)
            return a
        return sorted(a + b)

    stack: list[list] = []   # shared words, positions; shared words rise
    for i in range(1, n + 1):
        shared = lcp[i] if i < n else 0
        done = [order[i - 1]]
        while stack and stack[-1][0] > shared:
            node = stack.pop()
            done = joined(node[1], done, node[0])
        if shared >= low:
            if stack and stack[-1][0] == shared:
                stack[-1][1] = joined(stack[-1][1], done, shared)
            else:
                stack.append([shared, done])
    return sorted((start, end - start, d) for (start, end), d in ends.items())


def numbered(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def repeats_any(numbers: list[np.ndarray], width: int) -> np.ndarray:
    """For each text whether some ``width`` words may occur twice in it (equal hashes; never misses). Where none do, no pair is long enough."""
    sizes = np.array([len(x) for x in numbers], dtype=np.int64)
    h = np.concatenate([*numbers, np.empty(0, np.int64)]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    size, base = len(h), 0xD6E8FEB86659FD93
    power, wide = base, 1
    for bit in bin(width)[3:]:   # h of 1 word, then doubled and extended along the bits of the width
        one = h[:size - wide + 1]
        if len(one) <= wide:
            return np.zeros(len(sizes), dtype=bool)
        h = one[:-wide] * np.uint64(power) + one[wide:]
        wide, power = 2 * wide, power * power % (1 << 64)
        if bit == "1":
            first = np.concatenate(numbers).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
            h = h[:-1] * np.uint64(base) + first[wide:]
            wide, power = wide + 1, power * base % (1 << 64)
    nth = np.repeat(np.arange(len(sizes)), sizes)
    inside = nth[:len(h)] == nth[wide - 1:]
    text, h = nth[:len(h)][inside], h[inside]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    twice = (text[1:] == text[:-1]) & (h[1:] == h[:-1])
    return np.bincount(text[1:][twice], minlength=len(sizes)).astype(bool)


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """The runs of each sequence of words."""
    known: dict[bytes, int] = {}
    numbers = [numbered(words, known) for words in texts]
    maybe = repeats_any(numbers, shared_least(least, times)) if numbers else []
    return [find_runs(x, least, times) if some else [] for x, some in zip(numbers, maybe, strict=True)]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]


def with_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: one text in ten, by its id, repeats itself from some word on."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def chunks(batch: pa.RecordBatch) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    held, size = [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        words = text.as_py().split()   # bytes: white space is 20 and 09 to 0D
        if held and size + len(words) > CHUNK:
            yield held
            held, size = [], 0
        held.append((doc_id, words))
        size += len(words)
    if held:
        yield held


def id_and_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (start, length, period) and the text without the repeats; each row is decided where it is read."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                runs = runs_of_texts([w for _, w in part], least, times)
                kept = [b" ".join(collapsed(w, r)).decode("utf-8", "replace") for (_, w), r in zip(part, runs, strict=True)]
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array(rows, kind), pa.array(kept, pa.string())],
                                                 names=["doc_id", "runs", "text"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(found, "doc_id long, runs array<struct<start long, length long, period long>>, text string")


def most_periodic(runs: list[Run]) -> Run:
    """Greatest exact length / period; ties by smallest start, then period."""
    best = runs[0]
    for r in runs[1:]:   # runs come by start and period
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def digest_row(doc_id: int | None, words: list[bytes], runs: list[Run]) -> tuple:
    top = most_periodic(runs) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6 + [pa.string()] * 2
        for batch in batches:
            for part in chunks(batch):
                part = [(i, with_run(i, w)) for i, w in part]
                runs = runs_of_texts([w for _, w in part])
                out = zip(*(digest_row(i, w, r) for (i, w), r in zip(part, runs, strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    return id_and_bytes(table(spark, sf_dir, "documents"), "doc_id", "text").mapInArrow(rows, RESULT)
