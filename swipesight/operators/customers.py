"""Customer tables: value, history, days, risky spending and travel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipesight.functions.ranks import quantile_columns
from swipesight.functions.semantics import (
    cut, cut_at, flag, literal_rows, rate, ratio, with_row,
)

# Labels and bucket edges of the segment columns.
VALUE_LABELS = ["Очень низкая", "Низкая", "Средняя", "Высокая", "Очень высокая"]
RISK_LABELS = ["Низкий риск", "Средний риск", "Высокий риск", "Очень высокий риск"]
RISK_EDGES = [-0.01, 0.001, 0.01, 0.1, 1]
USAGE_LABELS = ["Не используют", "Слабо используют", "Умеренно используют", "Активно используют"]
USAGE_EDGES = [-0.01, 0.01, 0.1, 0.3, 1]
TRAVEL_LABELS = ["Не путешествует", "Редко путешествует", "Умеренно путешествует", "Часто путешествует"]
TRAVEL_EDGES = [-1, 0, 1, 5, float("inf")]
RISKY_CATEGORIES = ["Путешествия", "Развлечения", "Рестораны"]

COMMISSION = 0.015
FRAUD_COST_FACTOR = 10


def quantile_cut(df: DataFrame, column: str, labels: Sequence[str], out: str) -> DataFrame:
    """Equal-count buckets from exact quantile edges; equal values always share a bucket.

    Repeated edges leave a bucket without room and raise when the query runs.
    """
    q = len(labels)
    edges = quantile_columns(df.select(column), {f"e{i}": (column, i / q) for i in range(q + 1)})
    repeated = F.lit(False)
    for i in range(q):
        repeated = repeated | (F.col(f"e{i}") >= F.col(f"e{i + 1}"))
    checked = edges.withColumn(
        "e0",
        F.when(repeated, F.raise_error(F.lit(f"bucket edges of {column} are not unique")).cast("double"))
        .otherwise(F.col("e0")),
    )
    bounds = [F.col(f"_edges.e{i}") for i in range(q + 1)]
    return with_row(df, checked, "_edges").withColumn(
        out, cut_at(F.col(column), bounds, labels)
    ).drop("_edges")


def segment_statistics(
    df: DataFrame, segment: str, labels: Sequence[str], metrics: dict[str, Column]
) -> DataFrame:
    """Row count and metrics per ordered segment; a segment without rows is kept with count 0."""
    spine = literal_rows(df.sparkSession, [(label, i) for i, label in enumerate(labels)], [segment, "ordinal"])
    found = df.filter(F.col(segment).isNotNull()).groupBy(segment).agg(
        F.count(F.lit(1)).alias("customers"), *[m.alias(name) for name, m in metrics.items()]
    )
    return (
        spine.join(F.broadcast(found), segment, "left")
        .withColumn("customers", F.coalesce("customers", F.lit(0)))
        .orderBy("ordinal")
    )


def customer_totals(df: DataFrame) -> DataFrame:
    """All per-customer sums the value table and the premium rules need, in one aggregation."""
    risky = F.when(F.col("is_high_risk_vendor"), F.col("amount"))
    days = F.timestamp_diff("DAY", F.min("timestamp"), F.max("timestamp")) + 1
    return df.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count("transaction_id").alias("total_transactions"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        F.max("amount").alias("max_amount"),
        F.count_if("is_fraud").alias("fraud_count"),
        F.count_if("is_outside_home_country").alias("outside_country_count"),
        F.count_if("is_high_risk_vendor").alias("high_risk_count"),
        F.min("timestamp").alias("first_transaction"),
        F.max("timestamp").alias("last_transaction"),
        days.cast("long").alias("activity_days"),
        rate("is_outside_home_country").alias("abroad_ratio"),
        F.coalesce(F.avg(risky), F.lit(0.0)).alias("avg_high_risk_amount"),
        F.coalesce(F.sum(risky), F.lit(0.0)).alias("total_high_risk_amount"),
    )


def customer_value(df: DataFrame) -> DataFrame:
    """Value table: activity, revenue at the commission rate, fraud cost, value and risk segment."""
    totals = customer_totals(df)
    fraud_rate = ratio(F.col("fraud_count"), F.col("total_transactions"))
    revenue = F.col("total_amount") * COMMISSION
    cost = F.col("fraud_count") * F.col("avg_amount") * FRAUD_COST_FACTOR
    table = totals.withColumns({
        "transactions_per_day": ratio(F.col("total_transactions"), F.col("activity_days")),
        "avg_amount_per_day": ratio(F.col("total_amount"), F.col("activity_days")),
        "fraud_rate": fraud_rate,
        "risk_segment": cut(fraud_rate, RISK_EDGES, RISK_LABELS),
        "estimated_revenue": revenue,
        "fraud_cost": cost,
        "net_value": revenue - cost,
    })
    return quantile_cut(table, "total_amount", VALUE_LABELS, "value_segment")


def customer_days(df: DataFrame) -> DataFrame:
    return df.filter(F.col("customer_id").isNotNull()).groupBy(
        "customer_id", F.to_date("timestamp").alias("date")
    ).agg(
        F.sum("amount").alias("daily_total"),
        F.count("amount").alias("daily_count"),
        F.max("amount").alias("daily_max"),
        F.count_if("is_fraud").alias("fraud_count"),
    )


def customer_history(df: DataFrame) -> DataFrame:
    return df.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.avg("amount").alias("avg_amount"),
        F.stddev_samp("amount").alias("std_amount"),
        F.max("amount").alias("max_amount"),
        F.count_distinct(F.to_date("timestamp")).alias("active_days"),
    )


def risky_spending(df: DataFrame, categories: Sequence[str] = RISKY_CATEGORIES) -> DataFrame:
    """Share of each customer's volume and transactions in the risky categories."""
    risky = F.col("vendor_category").isin(*categories)
    amount = F.when(risky, F.col("amount"))
    table = df.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.sum("amount").alias("total_amount"),
        F.count("transaction_id").alias("total_count"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("risky_total"),
        F.count(amount).alias("risky_count"),
        F.avg(amount).alias("risky_avg"),
    )
    share = ratio(F.col("risky_total"), F.col("total_amount"))
    return table.withColumns({
        "risky_ratio": share,
        "risky_tx_ratio": ratio(F.col("risky_count"), F.col("total_count")),
        "risk_category_usage": cut(share, USAGE_EDGES, USAGE_LABELS),
    })


def travel_table(df: DataFrame) -> DataFrame:
    """Spending abroad per customer with the traveller segment."""
    abroad = flag("is_outside_home_country")
    table = df.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.coalesce(F.sum(abroad), F.lit(0)).alias("abroad_count"),
        F.avg(abroad).alias("abroad_ratio"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        F.count("amount").alias("tx_count"),
        F.count_distinct("country").alias("unique_countries"),
    )
    return table.withColumn("traveler_segment", cut(F.col("abroad_count"), TRAVEL_EDGES, TRAVEL_LABELS))
