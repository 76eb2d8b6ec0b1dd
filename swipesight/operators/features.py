"""Engineered features of a transaction: time, last hour, customer, vendor, device, recent rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipesight.functions.semantics import booleans_to_int
from swipesight.functions.skew import HOT_KEY_ROWS, ordered_windows
from swipesight.operators.profiling import unpack_last_hour

WINDOW_SIZES = (5, 10, 20)
UNUSUAL_DEVIATIONS = 3
SHARED_DEVICE_CUSTOMERS = 3
ASSUMED_DAYS = 30
BROADCAST_KEYS = 200_000


def time_features(df: DataFrame) -> DataFrame:
    """Date parts (Monday is 0), part of day, position in the day and cyclic encodings."""
    hour, dow = "hour(timestamp)", "weekday(timestamp)"
    return df.selectExpr(
        "*",
        "to_date(timestamp) AS transaction_date",
        f"{hour} AS transaction_hour",
        "day(timestamp) AS transaction_day",
        f"{dow} AS transaction_dow",
        "month(timestamp) AS transaction_month",
        "weekofyear(timestamp) AS transaction_week",
        f"CASE WHEN {hour} < 6 THEN 'night' WHEN {hour} < 12 THEN 'morning' "
        f"WHEN {hour} < 18 THEN 'afternoon' WHEN {hour} < 24 THEN 'evening' END AS time_of_day",
        f"{hour} * 3600 + minute(timestamp) * 60 + second(timestamp) AS seconds_from_midnight",
        f"CAST({dow} >= 5 AS INT) AS is_weekend_calc",
        f"sin(2 * pi() * {hour} / 24) AS hour_sin",
        f"cos(2 * pi() * {hour} / 24) AS hour_cos",
        f"sin(2 * pi() * {dow} / 7) AS dow_sin",
        f"cos(2 * pi() * {dow} / 7) AS dow_cos",
    )


def last_hour_features(df: DataFrame) -> DataFrame:
    """Last-hour members and their ratios: 0 without activity, NULL where no comparison is possible."""
    n, total, top = "last_hour_num_transactions", "last_hour_total_amount", "last_hour_max_single_amount"
    per = lambda name: f"CASE WHEN {n} > 0 THEN try_divide(CAST({name} AS DOUBLE), {n}) ELSE 0D END"
    return unpack_last_hour(df).selectExpr(
        "*",
        f"{per(total)} AS avg_amount_per_trans_last_hour",
        f"{per('last_hour_unique_merchants')} AS merchant_diversity_last_hour",
        f"{per('last_hour_unique_countries')} AS country_diversity_last_hour",
        f"CASE WHEN {n} > 0 AND {total} > 0 THEN amount / ({total} / {n}) END AS amount_vs_avg_last_hour",
        f"CASE WHEN {top} > 0 THEN amount / {top} END AS amount_vs_max_last_hour",
    )


def customer_statistics(df: DataFrame) -> DataFrame:
    return df.where("customer_id IS NOT NULL").groupBy("customer_id").agg(
        F.expr("count(transaction_id)").alias("customer_total_transactions"),
        F.expr("avg(amount)").alias("customer_avg_amount"),
        F.expr("coalesce(stddev_samp(amount), 0D)").alias("customer_std_amount"),
        F.expr("min(amount)").alias("customer_min_amount"),
        F.expr("max(amount)").alias("customer_max_amount"),
        F.expr("sum(amount)").alias("customer_total_amount"),
        F.expr(f"count(transaction_id) / {ASSUMED_DAYS}").alias("customer_avg_transaction_frequency"),
    )


def vendor_statistics(df: DataFrame) -> DataFrame:
    return df.where("vendor IS NOT NULL").groupBy("vendor").agg(
        F.expr("count(transaction_id)").alias("vendor_transaction_count"),
        F.expr("avg(amount)").alias("vendor_avg_amount"),
        F.expr("stddev_samp(amount)").alias("vendor_std_amount"),
    )


def device_statistics(df: DataFrame) -> DataFrame:
    return df.where("device_fingerprint IS NOT NULL").groupBy("device_fingerprint").agg(
        F.expr("count(transaction_id)").alias("device_usage_count"),
        F.expr("count(DISTINCT customer_id)").alias("unique_customers_per_device"),
    )


def key_counts(df: DataFrame, keys: Sequence[str]) -> dict[str, int]:
    """Approximate number of distinct values of each key, in one small aggregation."""
    row = df.agg(*[F.approx_count_distinct(k).alias(k) for k in keys]).first()
    return {k: row[k] for k in keys}


def attach(df: DataFrame, stats: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """Join per-key statistics to rows.

    With a known number of keys below the limit the statistics are broadcast and the rows stay where
    they are; otherwise both sides are shuffled and AQE splits the rows of a hot key.
    """
    small = size is not None and size <= BROADCAST_KEYS
    return df.join(F.broadcast(stats) if small else stats, key, "left")


def customer_features(df: DataFrame, stats: DataFrame | None = None, size: int | None = None) -> DataFrame:
    stats = stats if stats is not None else customer_statistics(df)
    deviation = (
        "try_divide(amount - customer_avg_amount, "
        "CASE WHEN customer_std_amount = 0 THEN 1D ELSE customer_std_amount END)"
    )
    return attach(df, stats, "customer_id", size).selectExpr(
        "*",
        f"{deviation} AS amount_deviation_from_customer_avg",
        f"CAST(coalesce(abs({deviation}) > {UNUSUAL_DEVIATIONS}, false) AS INT) AS is_unusual_amount_for_customer",
        "try_divide(amount, CASE WHEN customer_max_amount = 0 THEN 1D ELSE customer_max_amount END) "
        "AS amount_vs_customer_max",
    )


def vendor_features(df: DataFrame, stats: DataFrame | None = None, size: int | None = None) -> DataFrame:
    stats = stats if stats is not None else vendor_statistics(df)
    return attach(df, stats, "vendor", size).selectExpr(
        "*",
        "try_divide(amount - vendor_avg_amount, CASE WHEN vendor_std_amount = 0 THEN 1D "
        "ELSE vendor_std_amount END) AS amount_deviation_from_vendor_avg",
    )


def device_features(df: DataFrame, stats: DataFrame | None = None, size: int | None = None) -> DataFrame:
    stats = stats if stats is not None else device_statistics(df)
    return attach(df, stats, "device_fingerprint", size).selectExpr(
        "*",
        f"CAST(coalesce(unique_customers_per_device > {SHARED_DEVICE_CUSTOMERS}, false) AS INT) "
        "AS is_suspicious_device",
    )


def interaction_features(df: DataFrame) -> DataFrame:
    """Joined labels, joint flags and the amount at high-risk vendors."""
    text = lambda a, b: f"concat_ws('_', coalesce(CAST({a} AS STRING), 'missing'), coalesce(CAST({b} AS STRING), 'missing'))"  # noqa: E731,E501
    both = lambda a, b: f"CAST(coalesce({a} AND {b}, false) AS INT)"
    return df.selectExpr(
        "*",
        f"{text('channel', 'is_card_present')} AS channel_card_present_interaction",
        f"{text('country', 'card_type')} AS country_card_type_interaction",
        f"{text('time_of_day', 'vendor_category')} AS time_vendor_category_interaction",
        f"{both('is_high_risk_vendor', 'is_outside_home_country')} AS high_risk_outside_country",
        f"{both('is_high_risk_vendor', 'is_weekend')} AS high_risk_weekend",
        f"{both('is_outside_home_country', 'is_weekend')} AS outside_country_weekend",
        "amount * CAST(is_high_risk_vendor AS INT) AS amount_risk_interaction",
    )


def rolling_features(
    df: DataFrame, sizes: Sequence[int] = WINDOW_SIZES, hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Mean amount, rows and distinct vendors over each customer's last rows, this one included."""

    def build(window) -> dict[str, Column]:
        out = {}
        for size in sizes:
            recent = window.rowsBetween(-(size - 1), 0)
            out[f"customer_avg_amount_last_{size}"] = F.coalesce(F.avg("amount").over(recent), F.lit(0.0))
            out[f"customer_trans_count_last_{size}"] = F.count("transaction_id").over(recent)
            out[f"customer_unique_vendors_last_{size}"] = F.size(F.collect_set("vendor").over(recent))
        return out

    made = ordered_windows(
        df, "customer_id", ["timestamp", "transaction_id"], max(sizes) - 1, build, hot_rows
    )
    # rows without a customer belong to no group: 0, as for any other gap
    return made.fillna(0, [c for c in made.columns if c not in df.columns])


def all_features(
    df: DataFrame, fit_on: DataFrame | None = None, hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Every engineered feature.

    Customer, vendor and device statistics come from `fit_on` (the table itself by default, so that
    test rows take part in them; pass the training rows to avoid that).
    """
    source = fit_on if fit_on is not None else df
    sizes = key_counts(source, ["customer_id", "vendor", "device_fingerprint"])
    rows = rolling_features(df, hot_rows=hot_rows)
    rows = last_hour_features(time_features(rows))
    rows = customer_features(rows, customer_statistics(source), sizes["customer_id"])
    rows = vendor_features(rows, vendor_statistics(source), sizes["vendor"])
    rows = device_features(rows, device_statistics(source), sizes["device_fingerprint"])
    return interaction_features(rows)


def basic_features(df: DataFrame) -> DataFrame:
    """Hour, weekday, night flag, 0/1 copies of booleans and two risk interactions."""
    timed = df.selectExpr(
        "*", "hour(timestamp) AS hour", "weekday(timestamp) AS day_of_week",
        "CAST(hour(timestamp) BETWEEN 0 AND 5 AS INT) AS is_night",
    )
    return booleans_to_int(timed, "_int").selectExpr(
        "*",
        "amount * CAST(is_high_risk_vendor AS INT) AS amount_risk",
        "is_outside_home_country AND is_high_risk_vendor AS risk_outside",
    )
