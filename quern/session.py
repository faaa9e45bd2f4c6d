"""A session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "quern", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """AQE, Arrow and UTC; the number of shuffle partitions is left to the cluster unless given (AQE merges small ones)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: that of checkpoints, which a session on a cluster must name.  A local session gets one of its own."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quern-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for results that several jobs read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
