"""Quartile bucket digests of byte triplets, and the likeness of two of them.

A null text counts as empty. Rows are ordered by falling id, nulls last, rows of one id by their text;
repeated rows follow each other. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import shuffle_partitions, table, text_or_empty

BUCKETS = 256
MIX = np.uint32(0x9E3779B1)
LENGTH_BASE = 1.1
FAR = 400            # body difference from which two digests have nothing in common; independent ones differ by 416 on average
STEPS = (0, 1, 2, 6)   # cost of two codes that differ by so many quartiles


def triplet_counts(data: bytes) -> np.ndarray:
    if len(data) < 3:
        return np.zeros(BUCKETS, dtype=np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return np.bincount((key * MIX) >> np.uint32(24), minlength=BUCKETS)


def digest(data: bytes) -> str:
    """Hex: one byte of log length, one of quartile ratios, 64 of two-bit bucket codes.

    Where fewer triplets than buckets exist, quartiles are zero and a code says only whether its bucket was hit.
    """
    counts = triplet_counts(data)
    q1, q2, q3 = np.partition(counts, (63, 127, 191))[[63, 127, 191]].tolist()
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8).reshape(-1, 4)
    body = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    length = min(255, round(math.log(len(data) + 1) / math.log(LENGTH_BASE)))
    ratios = (16 * q1 // (q3 + 1)) << 4 | (16 * q2 // (q3 + 1))
    return (bytes([length, ratios]) + body.tobytes()).hex()


_COST = np.zeros((256, 256), dtype=np.uint8)
for _k in range(0, 8, 2):
    _a = (np.arange(256) >> _k) & 3
    _COST += np.array(STEPS, dtype=np.uint8)[np.abs(_a[:, None] - _a[None, :])]


def difference(x: str, y: str) -> int:
    """Bounded score: bucket codes, length steps beyond the first and ratio steps beyond the first; at most FAR."""
    a, b = np.frombuffer(bytes.fromhex(x), np.uint8), np.frombuffer(bytes.fromhex(y), np.uint8)
    score = int(_COST[a[2:], b[2:]].sum(dtype=np.int64))
    score += 2 * max(0, abs(int(a[0]) - int(b[0])) - 1)
    for shift in (4, 0):
        score += 2 * max(0, abs((int(a[1]) >> shift & 15) - (int(b[1]) >> shift & 15)) - 1)
    return min(FAR, score)


def likeness(x: str, y: str) -> float:
    return 1.0 - difference(x, y) / FAR


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as many first characters of the following text."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double")


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, extra, doc_id, text) in order; each row that is not extra is compared with the row after it in its block."""
    held: tuple | None = None   # block, doc_id, text, digest
    for batch in batches:
        out = []
        cols = [batch.column(i) for i in range(4)]
        for block, extra, doc_id, text in zip(*(c.to_pylist() for c in cols[:3]), cols[3], strict=True):
            text = text.as_py()
            own = digest(text.encode("utf-8", "surrogatepass"))
            if held is not None and held[0] == block:
                data = edited(held[2], text).encode("utf-8", "surrogatepass")
                fp = digest(data)
                out.append((held[1], len(held[2]), hashlib.sha256(data).hexdigest(), held[3], fp, likeness(held[3], fp), likeness(held[3], own)))
            held = None if extra else (block, doc_id, text, own)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        values = list(zip(*out, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, extra, doc_id, text): ranges of falling ids, each with the first row of the range after it as an extra row.

    Range limits are approximate quantiles of the ids; they and the largest id of each range (one number a
    block) are all that reaches the driver. The texts move once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    limits = sorted(set(rows.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.2 / blocks))) if blocks > 1 else []
    limits = [int(x) for x in limits]

    def block_of(ids: list[int | None]) -> list[int]:   # nulls come last: in the block of the lowest ids
        return [len(limits) if i is None else len(limits) - bisect_right(limits, i) for i in ids]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(block_of(b.column(0).to_pylist()), pa.int32())], names=["doc_id", "block"])

    tops = dict(tuple(r) for r in rows.select("doc_id").mapInArrow(number, "doc_id long, block int").groupBy("block").agg(F.max("doc_id")).collect())
    order = sorted(tops)
    before = {order[i]: order[i - 1] for i in range(len(order))}   # the first block follows the last

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            own = block_of(ids)
            first = [i for i, (x, k) in enumerate(zip(ids, own, strict=True)) if x == tops[k]]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([0] * len(own), pa.int32()), b.column(0), b.column(1)], names=names)
            if first:
                at = pa.array(first)
                yield pa.RecordBatch.from_arrays([pa.array([before[own[i]] for i in first], pa.int32()), pa.array([1] * len(first), pa.int32()),
                                                  b.column(0).take(at), b.column(1).take(at)], names=names)

    names = ["block", "extra", "doc_id", "text"]
    return rows.mapInArrow(deal, "block int, extra int, doc_id long, text string")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: digests of the text and of its edited text, and their likeness."""
    dealt = in_blocks(docs, shuffle_partitions(docs.sparkSession))
    near = dealt.repartition("block").sortWithinPartitions("block", "extra", F.col("doc_id").desc_nulls_last(), "text")
    return near.mapInArrow(compare, RESULT)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
