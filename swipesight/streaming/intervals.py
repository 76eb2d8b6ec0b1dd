"""The tumbling-interval report on a stream of transactions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swipesight.functions.semantics import ratio
from swipesight.session import checkpoint_dir
from swipesight.sources.schemas import TRANSACTIONS


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Transactions arriving as Parquet files in a folder."""
    return spark.readStream.schema(TRANSACTIONS).parquet(path)


def interval_stream(df: DataFrame, width: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    """Transactions, fraud and fraud rate per interval, emitted once rows can no longer arrive for it."""
    return (
        df.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", width).alias("_w"))
        .agg(F.count("transaction_id").alias("transactions"), F.count_if("is_fraud").alias("fraud"))
        .select(
            F.col("_w.start").alias("interval_start"), "transactions", "fraud",
            ratio(F.col("fraud"), F.col("transactions")).alias("fraud_rate"),
        )
    )


def drain_intervals(spark: SparkSession, tx: DataFrame, slices: int = 4, folder: str | None = None) -> DataFrame:
    """The interval report of a stream over `tx`, arriving as files in `slices` consecutive time ranges.

    After each range the stream runs until it has read it (`availableNow`), a restart from its checkpoint each time. The
    sink is written in complete mode, so the last windows are there too, although the watermark never passes them.
    """
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/intervals-{uuid.uuid4().hex}"
    tx = tx.select(*[f.name for f in TRANSACTIONS.fields if f.name in tx.columns])
    for inside in time_slices(tx, slices):
        tx.where(inside).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(tx.schema).parquet(f"{folder}/in")

        def save(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        query = (
            interval_stream(source).writeStream.foreachBatch(save).outputMode("complete")
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def time_slices(tx: DataFrame, slices: int) -> list[str]:
    """Conditions of `slices` consecutive, equally long time ranges covering all rows; null times go with the first."""
    low, high = tx.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    low, high = low or 0, (high or 0) + 1
    cuts = [low + (high - low) * k // slices for k in range(slices + 1)]
    out = [f"unix_micros(timestamp) >= {cuts[k]} AND unix_micros(timestamp) < {cuts[k + 1]}" for k in range(slices)]
    out[0] = f"timestamp IS NULL OR ({out[0]})"
    return out
