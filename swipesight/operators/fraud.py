"""Label shares and fraud rates by one or two keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swipesight.functions.ranks import quantiles
from swipesight.functions.semantics import flag, literal_rows

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
CATEGORICAL = [
    "vendor_category", "vendor_type", "currency", "country", "city_size", "card_type",
    "channel", "is_high_risk_vendor", "is_outside_home_country", "is_weekend",
]
CROSSTABS = [
    ("is_outside_home_country", "is_high_risk_vendor"),
    ("is_weekend", "is_high_risk_vendor"),
    ("is_card_present", "channel"),
]


def label_distribution(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    counted = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def amount_by_label(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    rows = df.filter(F.col(label).isNotNull()).select(label, "amount")
    means = rows.groupBy(label).agg(F.avg("amount").alias("mean_amount"))
    middle = quantiles(rows, "amount", [0.5], [label]).select(label, F.col("q").alias("median_amount"))
    return means.join(F.broadcast(middle), label, "left")


def top_values(df: DataFrame, columns: Sequence[str] = CATEGORICAL, n: int = 10) -> DataFrame:
    """Most frequent values of each column with the column's number of distinct values."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    counted = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    distinct = counted.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return top.join(F.broadcast(distinct), "column")


def fraud_rate_by(df: DataFrame, key: str, top: int | None = None, label: str = "is_fraud") -> DataFrame:
    """Fraud percentage and rows per value, highest first."""
    out = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg((F.avg(flag(label)) * 100).alias("fraud_rate"), F.count(label).alias("n"))
        .orderBy(F.desc_nulls_last("fraud_rate"), key)
    )
    return out.limit(top) if top else out


def fraud_by_hour(df: DataFrame) -> DataFrame:
    return df.groupBy(F.hour("timestamp").alias("hour")).agg(
        (F.avg(flag("is_fraud")) * 100).alias("fraud_rate"), F.count("is_fraud").alias("n")
    ).filter(F.col("hour").isNotNull())


def fraud_by_weekday(df: DataFrame) -> DataFrame:
    """All seven days in calendar order, Monday first; a day without rows has no rate."""
    by_day = df.groupBy(F.weekday("timestamp").alias("weekday")).agg(
        (F.avg(flag("is_fraud")) * 100).alias("fraud_rate"), F.count("is_fraud").alias("n")
    )
    spine = literal_rows(df.sparkSession, list(enumerate(WEEKDAYS)), ["weekday", "day_name"])
    return spine.join(F.broadcast(by_day), "weekday", "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    ).orderBy("weekday")


def fraud_crosstab(
    df: DataFrame, rows: str, columns: str, column_values: Sequence | None = None
) -> DataFrame:
    """Fraud percentage by a pair of keys, rounded to two digits, one column per value of the second.

    With `column_values` given the table is made in one pass; otherwise Spark looks them up first.
    """
    keyed = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull()).select(
        rows, F.col(columns).cast("string").alias(columns), flag("is_fraud").alias("_fraud")
    )
    grouped = keyed.groupBy(rows).pivot(columns, [str(v) for v in column_values] if column_values else None)
    table = grouped.agg(F.avg("_fraud") * 100)
    return table.select(rows, *[F.round(F.col(f"`{c}`"), 2).alias(c) for c in table.columns if c != rows])


def compare_groups(df: DataFrame, member: str, metrics: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Mean of each metric inside and outside a group, in one pass: rows (metric, inside, outside)."""
    inside = F.coalesce(F.col(member), F.lit(False))
    wide = df.agg(
        *[F.avg(F.when(inside, F.col(m))).alias(f"{m}_in") for m in metrics],
        *[F.avg(F.when(~inside, F.col(m))).alias(f"{m}_out") for m in metrics],
    )
    cells = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"{m}_in").cast("double").alias(names[0]),
            F.col(f"{m}_out").cast("double").alias(names[1]),
        )
        for m in metrics
    ]
    return wide.select(F.inline(F.array(*cells)))
