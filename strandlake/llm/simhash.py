"""SimHash near duplicates: pigeonhole blocks, verified Hamming distance, components.

Nulls and empty texts have fingerprint zero and link like any other. Rows with a null id take part in
links; a component's id is the smallest id that is not null (null if there is none). Repeated rows get
equal rows. Columns other than the id and the text are ignored, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import majority, stored, table, text_or_empty
from strandlake.llm.graph import components

SEED = 42


def shingle_hashes(text: str, width: int) -> bytes:
    """XXH64 (big-endian, joined) of each run of ``width`` words; a shorter sequence is one shingle, no word gives none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()   # bytes: only A-Z and ASCII white space count
    if not words:
        return b""
    if len(words) < width:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    runs = zip(*(words[i:] for i in range(width)), strict=False)
    return b"".join(map(xxhash.xxh64_digest, map(b" ".join, runs), repeat(SEED)))


def fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [shingle_hashes(t, width) for t in batch.column(1).to_pylist()]
        counts = np.fromiter((len(d) // 8 for d in digests), np.int64, len(digests))
        fps = majority(np.frombuffer(b"".join(digests), ">u8").astype(np.uint64), counts)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def named_prints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(id, hash, text) to (doc_id, k, fp)."""
    for batch in batches:
        got = next(fingerprint_batches(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["doc_id", "text"])]), width))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), got.column(1)], names=["doc_id", "k", "fp"])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; no shuffle, whole texts, one text at a time in memory as words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(lambda it: fingerprint_batches(it, width), "doc_id long, fp long")


def block_keys(blocks: int, agree: int) -> list[int]:
    """Bit masks: one for each choice of ``agree`` of the ``blocks`` near-equal blocks of a 64-bit word."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(blocks)]
    return [sum(c) for c in combinations(masks, agree)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(prints: DataFrame, max_bits: int, blocks: int | None = None, crowd: int = 24) -> DataFrame:
    """Links (a, b), a < b, that connect every pair of distinct values of ``prints.fp`` at ``max_bits`` or fewer differing bits.

    ``max_bits`` flipped bits spoil at most as many blocks, so of ``max_bits + 2`` blocks a close pair agrees
    in two: values join on each pair of blocks, and the Hamming distance is verified. A block key of more
    than ``crowd`` values would pair them quadratically. Its values go another, equally exact way: two
    values at distance d or less meet in a value that is at most d/2 (rounded up) flips from each. Every
    crowded value lists its ball of that radius, and those that meet in one value hang on the smallest
    of them whose distance is verified; all others of that meeting are at most d away for even d.
    """
    if max_bits % 2:
        raise ValueError("an even distance, so that all values of one ball are close")
    blocks = blocks or max_bits + 2
    masks = block_keys(blocks, blocks - max_bits)
    prints = prints.select("fp").distinct()
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("slot", "block"))
    crowds = keyed.groupBy("slot", "block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(keyed.join(crowds, ["slot", "block"]))
    few = shared.filter(F.col("n") <= crowd)
    pairs = few.alias("x").join(few.alias("y"), ["slot", "block"]).filter("x.fp < y.fp").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    balls = shared.filter(F.col("n") > crowd).select("fp").distinct()
    flips = [0]
    for _ in range(max_bits // 2):
        flips = sorted({f ^ (1 << i) for f in flips for i in range(64)} | set(flips))
    met = balls.select("fp", F.explode(F.transform(F.array(*[F.lit(signed(f)) for f in flips]), lambda f: f.bitwiseXOR(F.col("fp")))).alias("z"))
    # at most as many values meet in z as a ball has members
    stars = met.groupBy("z").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    return pairs.union(stars.select("a", F.explode("all").alias("b")).filter("a < b")).distinct()


def near_groups(prints: DataFrame, max_bits: int = 2, blocks: int | None = None) -> DataFrame:
    """(fp, root, component_id) for every fingerprint: the smallest fingerprint and doc_id of all rows linked with it through any chain."""
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(near_links(reps, max_bits, blocks), "a", "b").withColumnRenamed("node", "fp")
    linked = roots.join(reps, "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "root").select("fp", "root", "least")
    return reps.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp and component_id."""
    prints = stored(fingerprints(docs, width, id_col, text_col))
    return prints.join(near_groups(prints, max_bits), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, max_bits: int = 4, blocks: int = 7) -> DataFrame:
    """The documents without near duplicates: of each component the row with the smallest id stays (nulls last, then by text hash).

    Rows that are equal in id and text are copies: one of them stays. Only ids, hashes and fingerprints
    take part in the search; texts move once, by their own id and hash.
    """
    named = [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_i"), F.xxhash64(text_or_empty()).alias("_k")]
    prints = stored(docs.select(*named, text_or_empty().alias("text")).mapInArrow(lambda it: named_prints(it, width), "doc_id long, k long, fp long"))
    keep = prints.join(near_groups(prints, max_bits, blocks), "fp").groupBy("root").agg(F.min(F.struct("doc_id", "k")).alias("x"))
    keep = keep.select(F.col("x.doc_id").alias("_i"), F.col("x.k").alias("_k"))
    return docs.select("*", *named).join(keep, ["_i", "_k"], "left_semi").dropDuplicates(["_i", "_k"]).select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
