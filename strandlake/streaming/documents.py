"""Incremental preparation: documents that arrive in a folder are parsed once, and never again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.gad import parse_points


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """Streaming (doc, text), one row per new file."""
    return spark.readStream.schema("value string").option("wholetext", True).format("text").load(path).select(
        F.input_file_name().alias("doc"), F.col("value").alias("text"))


def prepare_new(spark: SparkSession, path: str, out: str, checkpoint: str):
    """Parse all documents that have not been seen yet and stop; the checkpoint remembers them."""

    def write(batch: DataFrame, epoch: int) -> None:
        # a retried batch overwrites its own folder
        parse_points(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = stream_documents(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
