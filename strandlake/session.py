"""Session helper and the lineage barrier used by iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "strandlake", master: str | None = None, shuffle_partitions: int | None = None,
              driver_memory: str = "12g") -> SparkSession:
    """A session with AQE, skew-join handling and UTC time.

    On a cluster, pass nothing: master, memory and shuffle partitions come from spark-submit.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", driver_memory).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the warehouse folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.getCheckpointDir() is not None:
        folder = spark.sparkContext.getCheckpointDir()
    return folder if folder is not None else spark.conf.get("spark.sql.warehouse.dir")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Cut the lineage: write the rows as a Parquet table in the shared folder and read it back.

    Like a reliable checkpoint it survives the loss of executors. Unlike one, it keeps column pruning,
    and its known size lets the planner broadcast what is small and shuffle what is not. Once it is written
    nothing reads the shuffles behind it, so their files go; ``options`` are those of the Parquet writer.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/strandlake/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    past = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(CLEANUP, past)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._barrier = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove barrier tables that nothing reads any more: what earlier rounds of a loop wrote."""
    for df in tables:
        if not hasattr(df, "_barrier"):
            continue
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._barrier)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
