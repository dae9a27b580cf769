"""Exact dedup by a heavy-hitter split: Misra-Gries finds frequent digests, the others are shuffled.

Two texts are equal when their bytes agree after lower-casing A-Z. A digest is the SHA-256 of those bytes.
A null text counts as empty. Of equal texts the row with the largest id stays; a null id is smaller than all
others. Rows that agree in id and text are copies of each other: exactly one of them stays. Other columns are
ignored by ``exact_groups`` and passed through by ``distinct_documents``, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import stored, table, text_or_empty

COUNTERS = 4096    # of a summary: every digest in more than one of so many rows is found
FAN = 64           # summaries that one task merges


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text as bytes) to (doc_id, digest)."""
    for batch in batches:
        found = [hashlib.sha256(t.as_py().lower()).digest() for t in batch.column(1)]   # bytes.lower: A-Z only
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "digest"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(digest_batches, "doc_id long, digest binary")


def reduced(keys: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries step on summed counters: subtract the largest count that has no room, so at most ``counters`` stay."""
    keys, inverse = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(keys), dtype=np.int64)
    np.add.at(sums, inverse, counts)
    if len(keys) > counters:
        sums = sums - np.partition(sums, len(sums) - counters - 1)[len(sums) - counters - 1]
        keys, sums = keys[sums > 0], sums[sums > 0]
    return keys, sums


def as_keys(column: pa.Array) -> np.ndarray:
    """Digests as 32-byte values (order means nothing)."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="V32")


def summary_batch(group: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([group] * len(keys), pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()),
                                       pa.array(counts, pa.int64())], names=["part", "digest", "n"])


def frequent(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest) candidates, at most ``counters``: all that occur in more than one of ``counters`` + 1 rows are among them.

    Each partition keeps a summary of fixed size; summaries merge in a tree of fan FAN, which keeps the bound
    (counters add up, then one step subtracts). No task sees more than FAN summaries.
    """
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, part = np.empty(0, "V32"), np.empty(0, np.int64), 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(1)[0].as_py()
                keys, counts = reduced(np.concatenate([keys, as_keys(batch.column(0))]), np.concatenate([counts, np.ones(batch.num_rows, np.int64)]), counters)
        yield summary_batch(part, keys, counts)

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        keys, counts = reduced(as_keys(rows.column("digest")), rows.column("n").to_numpy(), counters)
        return pa.Table.from_batches([summary_batch(rows.column("part")[0].as_py(), keys, counts)])

    shape = "part long, digest binary, n long"
    found = rows.select("digest", F.spark_partition_id().cast("long").alias("part")).mapInArrow(summarise, shape)
    left = rows.rdd.getNumPartitions()
    while left > 1:
        found = found.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(merge, shape)
        left = -(-left // FAN)
    return found.select("digest")


def heavy_winners(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of the digests in more than one of ``counters`` + 1 rows, counted exactly: at most ``counters`` rows."""
    limit = F.lit(rows.count() // (counters + 1))
    best = F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "row")).alias("w")
    held = rows.join(F.broadcast(stored(frequent(rows, counters))), "digest", "left_semi")   # at most ``counters`` digests of 32 bytes
    held = held.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best).filter((F.col("group_size") > 1) & (F.col("group_size") > limit))
    return stored(held.select("digest", F.col("w.doc_id").alias("keep_id"), F.col("w.row").alias("keep_row"), "group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row: doc_id, digest, keep_id, group_size and kept.

    Rows of frequent digests are answered where they are read, by their verified winners; all others are shuffled
    by digest, and none of those groups holds more than one of ``counters`` + 1 rows. Texts are not moved.
    """
    rows = stored(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    met = rows.join(F.broadcast(heavy_winners(rows, counters)), "digest", "left")   # at most ``counters`` rows
    heavy = met.filter("group_size is not null").select("doc_id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    group = Window.partitionBy("digest")
    order = group.orderBy(F.col("doc_id").desc_nulls_last(), F.col("row").desc())
    light = met.filter("group_size is null").select(
        "doc_id", "digest", F.first("doc_id").over(order).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"))
    return heavy.union(light)


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with all their columns. Copies of frequent texts are dropped where they are read; the others move once.

    The last step combines before it shuffles, so even one row repeated without end is no hot key.
    """
    rows = stored(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    winners = F.broadcast(heavy_winners(rows, counters))   # at most ``counters`` rows
    digest = F.udf(lambda t: hashlib.sha256(bytes(t).lower()).digest(), "binary", useArrow=True)
    number = F.col(id_col).cast("long")
    named = docs.select(F.struct("*").alias("doc"), number.alias("id"), digest(text_or_empty(text_col).cast("binary")).alias("digest"))
    named = named.join(winners, "digest", "left").filter(F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    stay = named.groupBy("digest").agg(F.max_by("doc", F.struct(F.col("id").isNotNull(), "id")).alias("doc"))
    return stay.select("doc.*")


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(max(doc_id) OVER (PARTITION BY t) AS BIGINT) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
