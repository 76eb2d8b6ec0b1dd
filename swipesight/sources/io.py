"""Readers for the two input tables and writers for metrics, reports and models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipesight.functions.semantics import require_columns
from swipesight.sources.schemas import TRANSACTIONS


def normalise(df: DataFrame) -> DataFrame:
    """Zone-less timestamps become UTC timestamps, NaN becomes NULL."""
    changes = {}
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampNTZType):
            changes[field.name] = column.cast("timestamp")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            changes[field.name] = F.when(~F.isnan(column), column)
    return df.withColumns(changes) if changes else df


def read_transactions(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Transactions from Parquet, checked against the declared columns.

    Columns absent from the files are left out; wrong types are cast to the declared ones.
    """
    raw = spark.read.parquet(*([path] if isinstance(path, str) else path))
    names = [f.name for f in TRANSACTIONS.fields if f.name in raw.columns]
    if columns is not None:
        require_columns(raw, columns)
        names = [n for n in names if n in columns]
    declared = {f.name: f.dataType for f in TRANSACTIONS.fields}
    return normalise(raw.select(*[F.col(n).cast(declared[n]).alias(n) for n in names]))


def read_exchange_rates(spark: SparkSession, path: str) -> DataFrame:
    """One row per date, one column per currency."""
    raw = spark.read.parquet(path)
    require_columns(raw, ["date"])
    return normalise(raw.withColumn("date", F.to_date("date")))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A metrics table has a row per model, so one CSV file is enough."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """Report figures as JSON lines, one row per model."""
    report.coalesce(1).write.mode("overwrite").json(path)


def save_models(models: Mapping[str, object], path: str) -> None:
    """Each fitted pipeline in a directory of its own."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path.rstrip('/')}/{name}")


def load_model(path: str, name: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path.rstrip('/')}/{name}")
