"""Session settings the operators rely on."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(name: str = "swipesight", master: str | None = None, **extra: str) -> SparkSession:
    """Session for jobs and tests; `extra` keys use `__` for dots (`spark__driver__memory="8g"`)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: that of the context, else `spark.checkpoint.dir`, else one under the warehouse.

    The warehouse of a cluster lies on its shared file system. A local warehouse is refused unless the master is local too:
    executors could not see each other's files.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        local = "://" not in warehouse and not warehouse.startswith("hdfs:")
        if local and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = f"{warehouse.rstrip('/')}/_checkpoints"
    context.setCheckpointDir(current)
    return current


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of frames that nothing refers to any more.

    It removes them when the driver collects garbage, which may otherwise come only after the next large shuffle.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Have Spark cut the Arrow batches of Python tasks by bytes too, not only by 10,000 rows: memory then does not grow with the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage by a checkpoint in the shared folder.

    Spark removes the files with the frame if `spark.cleaner.referenceTracking.cleanCheckpoints` is on, as
    `build_session` sets it.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
