"""Packing by cutting stock: a linear program over patterns of piece lengths, priced by a knapsack, rounded, assigned by rank.

Each text becomes its token ids and an end id; it is cut at multiples of the sequence length, so that at
most one piece a document is shorter. Null texts count as empty (one piece with the end id). Null ids and
repeated rows are packed like others. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import stored, table, text_or_empty
from strandlake.operators.ranks import sequence_in_group

LENGTH = 2048
GRAIN = 16         # piece lengths are planned in steps of so many tokens
END_ID = 1
CACHE = 400_000    # words whose ids a worker keeps
GAP = 2e-3         # the plan may need so much more stock than the linear program's bound
BUCKET_ROWS = 8192

Added = tuple[tuple[str, int], ...]   # literal and id

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def plain(word: str) -> bool:
    return bool(word) and word.strip() == word


class Encoder:
    """Byte-level BPE ids as little-endian bytes, by words.

    A single space between two other characters always begins a token of its own word, so a text that has
    no other white space next to a space, nor at its ends, is the sequence of its words with the space
    before them. Unknown words of a text are encoded in one call and told apart by their leading space; ids
    of known ones are kept. Words that are empty or have white space at an end never become known: their
    texts are encoded whole. Added tokens (such as <|endoftext|>) have one id each wherever they stand; the
    parts between them are encoded on their own.
    """

    def __init__(self, ranks_path: str, pattern: str, added: Added = ()) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.spaced[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.known: dict[str, bytes] = {}
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in added}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def learn(self, new: set[str]) -> None:
        words = list(new)
        ids = np.array(self.bpe.encode_ordinary("".join([" " + w for w in words])), dtype="<u4")
        cuts = np.flatnonzero(self.spaced[ids])
        for word, part in zip(words, np.split(ids, cuts[1:]), strict=True):
            self.known[word] = part.tobytes()

    def encode(self, text: str) -> bytes:
        if self.at_added and self.at_added.search(text):
            return b"".join([self.added[t] if i % 2 else self.between(t) for i, t in enumerate(self.at_added.split(text)) if t])
        return self.between(text)

    def between(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not plain(first):
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(list(map(self.known.__getitem__, rest)))
        except KeyError:
            new = {w for w in rest if w not in self.known}
            if len(rest) > CACHE or not all(map(plain, new)):
                return self.whole(text)
            if len(self.known) + len(new) > CACHE:
                self.known, new = {}, set(rest)
            self.learn(new)
            return self.whole(first) + b"".join(list(map(self.known.__getitem__, rest)))


_ENCODERS: dict[tuple[str, str, Added], Encoder] = {}


def encoder(ranks_path: str, pattern: str, added: Added) -> Encoder:
    """One for each worker process; it outlives the task."""
    if (ranks_path, pattern, added) not in _ENCODERS:
        _ENCODERS[ranks_path, pattern, added] = Encoder(ranks_path, pattern, added)
    return _ENCODERS[ranks_path, pattern, added]


def cut_batches(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, added: Added, length: int, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(ranks_path, pattern, added)
    tail = np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = enc.encode(text.as_py()) + tail
            n = len(ids) // 4
            out += [(doc_id, s, min(length, n - s), zlib.crc32(ids[4 * s:4 * (s + length)]), n) for s in range(0, n, length)]
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def pieces(docs: DataFrame, ranks_path: str, pattern: str, added: Added = (), length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(lambda it: cut_batches(it, ranks_path, pattern, added, length, end_id), PIECES)


def best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes within the room."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    useful = np.flatnonzero(value > 0)
    sizes_up, value_up = sizes[useful], value[useful]
    upto = np.searchsorted(sizes_up, np.arange(room + 1), side="right").tolist()
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if upto[c]:
            gains = best[c - sizes_up[:upto[c]]]
            gains += value_up[:upto[c]]
            k = gains.argmax()
            if gains[k] > best[c] + 1e-12:
                best[c], last[c] = gains[k], useful[k]
    taken, c = np.zeros(len(sizes), dtype=np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            taken[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[room]), taken


def cutting_plan(demand: dict[int, int], room: int, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) with pattern {size: pieces}: together they hold every piece of the histogram once.

    Column generation: the basis starts with one pattern a size, the knapsack prices new patterns with the
    duals, and a pattern enters while the bound says that over ``gap`` can still be saved. Patterns are used
    as often as the solution's whole part says; the few pieces that rounding leaves are packed first-fit by
    falling size. All of it is bounded by the number of sizes, whatever the number of pieces.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], dtype=np.float64)
    columns = np.diag(room // sizes)
    inverse = np.diag(1.0 / np.diag(columns))
    amount = inverse @ need
    for _ in range(50 * len(sizes)):
        duals = inverse.sum(axis=0)
        value, entering = best_pattern(duals, sizes, room)
        if value <= 1 + gap:
            break
        way = inverse @ entering
        steps = np.where(way > 1e-9, amount / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(steps))
        amount = np.maximum(amount - steps[out] * way, 0)
        amount[out] = steps[out]
        columns[:, out] = entering
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
    left = need.astype(np.int64)
    plan: list[tuple[dict[int, int], int]] = []
    for j in np.argsort(-amount):
        used = columns[:, j] > 0
        times = min(int(amount[j] + 1e-6), int((left[used] // columns[used, j]).min()))
        if times > 0:
            left -= times * columns[:, j]
            plan.append(({int(s): int(k) for s, k in zip(sizes[used], columns[used, j], strict=True)}, times))
    open_bins: list[list] = []
    for i in range(len(sizes) - 1, -1, -1):
        size, n = int(sizes[i]), int(left[i])
        for b in open_bins:
            k = min(n, b[0] // size)
            if k:
                b[0] -= k * size
                b[1][size] = b[1].get(size, 0) + k
                n -= k
        while n > 0:
            k = min(n, room // size)
            open_bins.append([room - k * size, {size: k}])
            n -= k
    return plan + [(b[1], 1) for b in open_bins]


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: upper rank limits, pieces a sequence, first sequence id of the patterns that hold it."""
    ends: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for pattern, times in plan:
        for size, k in pattern.items():
            had = ends.setdefault(size, [])
            had.append(((had[-1][0] if had else 0) + k * times, k, first))
        first += times
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for s, rows in ends.items()}


def pack(cut: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """Adds sequence_id and offset to pieces; the histogram of lengths (at most length / grain rows) is planned on the driver."""
    room = length // grain
    sized = cut.withColumn("size", F.ceil(F.col("length") / grain).cast("int"))
    counts = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = slots(cutting_plan(counts, room))
    spread = max(1, sum(counts.values()) // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(spread))
    ranked = sequence_in_group(sized, ["size"], ["doc_id", "start", "ids_crc32"], bucket, "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("size", "rank"))
            seq = np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                ends, k, first = where[int(s)]
                p = np.searchsorted(ends, rank[at], side="right")
                begins = np.where(p > 0, ends[p - 1], 0)
                seq[at] = first[p] + (rank[at] - begins) // k[p]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(seq)], names=[*kept, "sequence_id"])

    kept = [*cut.columns, "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", rank long, sequence_id long"
    placed = ranked.select(*kept, "size").mapInArrow(place, schema)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("rank")


def tokenizer_files() -> tuple[str, str, Added]:
    """The ranks of the vocabulary byte_bpe_50k, its word pattern and its added tokens."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("an added token that takes its surroundings into account")
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tuple((t["content"], t["id"]) for t in added)


def pack_documents(docs: DataFrame, length: int = LENGTH, files: tuple[str, str, Added] | None = None) -> DataFrame:
    return pack(stored(pieces(docs, *(files or tokenizer_files()), length)), length)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
