"""Business rules tried on the customer base: premium, limits, alerts, cashback, insurance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipesight.functions.ranks import quantile_columns
from swipesight.functions.semantics import (
    flag, is_true, literal_rows, ratio, with_row, zero_as_one,
)
from swipesight.functions.skew import HOT_KEY_ROWS, ordered_windows
from swipesight.operators.customers import (
    COMMISSION, RISKY_CATEGORIES, TRAVEL_LABELS, USAGE_LABELS, VALUE_LABELS,
    customer_days, customer_history, customer_value, risky_spending, segment_statistics, travel_table,
)
from swipesight.operators.fraud import compare_groups

# Fixed values of the premium rule
PREMIUM_MONTHLY_FEE = 10
# Fixed values of the static limits
DAILY_LIMIT, SINGLE_LIMIT, COUNT_LIMIT = 1000, 500, 10
REDUCTION_GOAL = 30
# Fixed values of the alert rules
ZSCORE_LIMIT, NIGHT_HOURS, GAP_MINUTES, SUSPICIOUS_SCORE = 3, (0, 5), 10, 2
CONFIRMATION_RATE, NOTIFICATION_BOOST = 0.7, 0.4
# Fixed values of the cashback estimate
CASHBACK_RATE, GROWTH_RATE = 0.02, 0.25
# Fixed values of the insurance estimate
BASE_CONVERSION, INSURANCE_PRICE = 0.02, 100
CONVERSION_FACTORS = [0.1, 0.5, 1.5, 3.0]


# --- premium segmentation -------------------------------------------------------------------


def premium_segments(customers: DataFrame) -> DataFrame:
    """Customer value table with the premium candidate flag."""
    thresholds = quantile_columns(customers, {
        "outside": ("outside_country_count", 0.5),
        "high_risk": ("avg_high_risk_amount", 0.5),
        "amount": ("total_amount", 0.75),
    })
    candidate = (
        is_true(F.col("outside_country_count") > F.col("_limit.outside"))
        | is_true(F.col("avg_high_risk_amount") > F.col("_limit.high_risk") * 2)
        | is_true(F.col("total_amount") > F.col("_limit.amount"))
    )
    return with_row(customers, thresholds, "_limit").withColumn(
        "premium_candidate", candidate
    ).drop("_limit")


def premium_summary(segments: DataFrame) -> DataFrame:
    found = F.count_if("premium_candidate")
    return segments.agg(
        F.count(F.lit(1)).alias("customers"),
        found.alias("candidates"),
        (found * 100.0 / F.count(F.lit(1))).alias("candidate_percent"),
        (found * PREMIUM_MONTHLY_FEE * 12).alias("yearly_revenue"),
    )


def premium_comparison(segments: DataFrame) -> DataFrame:
    metrics = ["total_amount", "avg_amount", "outside_country_count", "high_risk_count"]
    return compare_groups(segments, "premium_candidate", metrics, ("candidates", "regular"))


def premium_by_value_segment(segments: DataFrame) -> DataFrame:
    share = F.avg(flag("premium_candidate")) * 100
    return segment_statistics(segments, "value_segment", VALUE_LABELS, {"premium_percent": share})


# --- dynamic limits ---------------------------------------------------------------------------


def dynamic_limits(df: DataFrame) -> DataFrame:
    """Per-customer limits from the whole history: 3 means + 3 deviations a day, 1.5 maxima at once."""
    return customer_history(df).withColumns({
        "dynamic_daily_limit": F.col("avg_amount") * 3 + F.col("std_amount") * 3,
        "dynamic_single_limit": F.col("max_amount") * 1.5,
    })


def limit_days(df: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Customer days with the blocking decision of static and dynamic limits."""
    limits = limits if limits is not None else dynamic_limits(df)
    needed = limits.select("customer_id", "dynamic_daily_limit", "dynamic_single_limit")
    return customer_days(df).join(needed, "customer_id", "left").withColumns({
        "static_block": is_true(F.col("daily_total") > DAILY_LIMIT)
        | is_true(F.col("daily_max") > SINGLE_LIMIT)
        | is_true(F.col("daily_count") > COUNT_LIMIT),
        "dynamic_block": is_true(F.col("daily_total") > F.col("dynamic_daily_limit"))
        | is_true(F.col("daily_max") > F.col("dynamic_single_limit")),
        "legitimate": F.col("fraud_count") == 0,
    })


def limit_summary(days: DataFrame) -> DataFrame:
    """False blocks on days without fraud and missed fraud days, for both kinds of limit."""
    clean, static, dynamic = F.col("legitimate"), F.col("static_block"), F.col("dynamic_block")
    counts = days.agg(
        F.count_if(clean).alias("legitimate_days"),
        F.count_if(clean & static).alias("false_blocks_static"),
        F.count_if(clean & dynamic).alias("false_blocks_dynamic"),
        F.count_if(~clean).alias("fraud_days"),
        F.count_if(~clean & ~static).alias("missed_static"),
        F.count_if(~clean & ~dynamic).alias("missed_dynamic"),
    )
    rates = counts.withColumns({
        "false_rate_static": ratio(F.col("false_blocks_static"), F.col("legitimate_days")) * 100,
        "false_rate_dynamic": ratio(F.col("false_blocks_dynamic"), F.col("legitimate_days")) * 100,
        "miss_rate_static": ratio(F.col("missed_static"), F.col("fraud_days")) * 100,
        "miss_rate_dynamic": ratio(F.col("missed_dynamic"), F.col("fraud_days")) * 100,
    })
    drop = F.col("false_rate_static") - F.col("false_rate_dynamic")
    reduced = rates.withColumn("reduction_percent", ratio(drop, F.col("false_rate_static")) * 100)
    return reduced.withColumn("goal_met", is_true(F.col("reduction_percent") >= REDUCTION_GOAL))


def top_customer_limits(days: DataFrame, limits: DataFrame, n: int = 10) -> DataFrame:
    """Limits of the customers with the highest mean daily volume."""
    top = (
        days.groupBy("customer_id")
        .agg(F.avg("daily_total").alias("_mean"))
        .orderBy(F.desc_nulls_last("_mean"), "customer_id")
        .limit(n)
    )
    return limits.join(F.broadcast(top.select("customer_id")), "customer_id", "left_semi")


# --- alerts on suspicious transactions -----------------------------------------------------------


def previous_gap(df: DataFrame, out: str = "gap_seconds", hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Seconds since the customer's previous transaction (ties in time ordered by id)."""
    micros = F.unix_micros("timestamp")
    def build(w):
        return {out: (micros - F.lag(micros).over(w)) / 1e6}
    return ordered_windows(df, "customer_id", ["timestamp", "transaction_id"], 1, build, hot_rows)


def suspicion_scores(df: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Each transaction with its four rules, the score and the verdict."""
    stats = df.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.avg("amount").alias("avg_amount"), F.stddev_samp("amount").alias("std_amount")
    )
    # gaps first: their windows spread a hot customer, the join's left side is split by AQE
    rows = previous_gap(df, hot_rows=hot_rows).join(stats, "customer_id", "left")
    zscore = F.try_divide(F.col("amount") - F.col("avg_amount"), zero_as_one(F.col("std_amount")))
    rules = rows.withColumns({
        "amount_zscore": zscore,
        "rule_amount": is_true(F.abs(zscore) > ZSCORE_LIMIT),
        "rule_risky_abroad": is_true(F.col("is_high_risk_vendor") & F.col("is_outside_home_country")),
        "rule_night": is_true(F.hour("timestamp").between(*NIGHT_HOURS)),
        "rule_frequent": is_true(F.col("gap_seconds") < GAP_MINUTES * 60),
    })
    names = ["rule_amount", "rule_risky_abroad", "rule_night", "rule_frequent"]
    score = sum((flag(n) for n in names[1:]), flag(names[0]))
    return rules.withColumn("suspicious_score", score).withColumn(
        "is_suspicious", F.col("suspicious_score") >= SUSPICIOUS_SCORE
    )


def suspicion_summary(scored: DataFrame) -> DataFrame:
    """Precision and recall of the verdict and the estimated effect of notifying customers."""
    odd, fraud = F.col("is_suspicious"), is_true(F.col("is_fraud"))
    counts = scored.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_if(odd).alias("suspicious"),
        F.count_if(odd & fraud).alias("suspicious_fraud"),
        F.count_if(odd & ~fraud).alias("suspicious_legitimate"),
        F.count_if(fraud).alias("fraud"),
        F.avg(F.when(odd & ~fraud, F.col("amount"))).alias("avg_legitimate_amount"),
    )
    boosted = min(1.0, CONFIRMATION_RATE * (1 + NOTIFICATION_BOOST))
    legit = F.col("suspicious_legitimate")
    extra = legit * F.lit(boosted) - legit * F.lit(CONFIRMATION_RATE)
    volume = extra * F.col("avg_legitimate_amount")
    return counts.withColumns({
        "suspicious_percent": ratio(F.col("suspicious"), F.col("transactions")) * 100,
        "precision": ratio(F.col("suspicious_fraud"), F.col("suspicious")),
        "recall": ratio(F.col("suspicious_fraud"), F.col("fraud")),
        "confirmed_before": legit * F.lit(CONFIRMATION_RATE),
        "confirmed_after": legit * F.lit(boosted),
        "additional_confirmed": extra,
        "additional_volume": volume,
        "additional_revenue": volume * COMMISSION,
    })


def score_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("suspicious_score").agg(F.count(F.lit(1)).alias("n")).orderBy("suspicious_score")


def rule_hits(scored: DataFrame) -> DataFrame:
    names = ["rule_amount", "rule_risky_abroad", "rule_night", "rule_frequent"]
    wide = scored.agg(*[F.count_if(n).alias(n) for n in names])
    return wide.unpivot([], names, "rule", "hits")


# --- cashback -----------------------------------------------------------------------------------


def cashback_segments(spending: DataFrame) -> DataFrame:
    return segment_statistics(spending, "risk_category_usage", USAGE_LABELS, {
        "avg_total": F.avg("total_amount"),
        "avg_risky_total": F.avg("risky_total"),
        "avg_transactions": F.avg("total_count"),
    })


def active_users(spending: DataFrame) -> DataFrame:
    """Customers above the 75th percentile of the risky share."""
    limit = quantile_columns(spending, {"limit": ("risky_ratio", 0.75)})
    return with_row(spending, limit, "_at").filter(F.col("risky_ratio") > F.col("_at.limit")).drop("_at")


def cashback_effect(spending: DataFrame) -> DataFrame:
    volume = active_users(spending).agg(
        F.count(F.lit(1)).alias("active_users"),
        F.coalesce(F.sum("risky_total"), F.lit(0.0)).alias("current_volume"),
    )
    predicted = F.col("current_volume") * (1 + GROWTH_RATE)
    steps = volume.withColumn("predicted_volume", predicted).withColumns({
        "cashback_cost": F.col("predicted_volume") * CASHBACK_RATE,
        "additional_volume": F.col("predicted_volume") - F.col("current_volume"),
    }).withColumn("additional_revenue", F.col("additional_volume") * COMMISSION)
    net = F.col("additional_revenue") - F.col("cashback_cost")
    cost = F.col("cashback_cost")
    return steps.withColumn("net_effect", net).withColumn(
        "roi_percent", F.when(cost > 0, F.try_divide(net, cost) * 100).otherwise(F.lit(0.0))
    )


# --- travel insurance ---------------------------------------------------------------------------


def insurance_segments(travel: DataFrame) -> DataFrame:
    return segment_statistics(travel, "traveler_segment", TRAVEL_LABELS, {
        "avg_abroad_count": F.avg("abroad_count"),
        "avg_total": F.avg("total_amount"),
        "avg_transactions": F.avg("tx_count"),
        "avg_countries": F.avg("unique_countries"),
    })


def insurance_potential(travel: DataFrame) -> DataFrame:
    """Expected sales and revenue per traveller segment."""
    rates = literal_rows(
        travel.sparkSession,
        [(s, BASE_CONVERSION * f) for s, f in zip(TRAVEL_LABELS, CONVERSION_FACTORS)],
        ["traveler_segment", "_rate"],
    )
    sized = insurance_segments(travel).select("traveler_segment", "ordinal", "customers")
    sales = F.col("customers") * F.col("_rate")
    return sized.join(F.broadcast(rates), "traveler_segment").select(
        "traveler_segment", "ordinal", "customers",
        (F.col("_rate") * 100).alias("conversion_percent"),
        sales.alias("expected_sales"),
        (sales * INSURANCE_PRICE).alias("expected_revenue"),
    )


def insurance_split(potential: DataFrame) -> DataFrame:
    frequent = F.col("traveler_segment") == TRAVEL_LABELS[-1]
    return potential.agg(
        F.sum("expected_revenue").alias("total_revenue"),
        F.sum(F.when(frequent, F.col("expected_revenue"))).alias("frequent_revenue"),
    ).withColumn("other_revenue", F.col("total_revenue") - F.col("frequent_revenue"))


def traveler_comparison(travel: DataFrame) -> DataFrame:
    flagged = travel.withColumn("_frequent", F.col("traveler_segment") == TRAVEL_LABELS[-1])
    metrics = ["total_amount", "avg_amount", "tx_count", "unique_countries"]
    return compare_groups(flagged, "_frequent", metrics, ("frequent", "other"))


# --- all of them ---------------------------------------------------------------------------------


def product_hypotheses(
    df: DataFrame, categories: Sequence[str] = RISKY_CATEGORIES
) -> dict[str, DataFrame]:
    """Every table of the five hypotheses, lazily."""
    segments = premium_segments(customer_value(df))
    limits = dynamic_limits(df)
    days = limit_days(df, limits)
    scored = suspicion_scores(df)
    spending = risky_spending(df, categories)
    travel = travel_table(df)
    potential = insurance_potential(travel)
    return {
        "premium_segments": segments,
        "premium_summary": premium_summary(segments),
        "premium_comparison": premium_comparison(segments),
        "premium_by_value_segment": premium_by_value_segment(segments),
        "limit_days": days,
        "customer_limits": limits,
        "limit_summary": limit_summary(days),
        "top_customer_limits": top_customer_limits(days, limits),
        "suspicion_scores": scored,
        "suspicion_summary": suspicion_summary(scored),
        "score_distribution": score_distribution(scored),
        "rule_hits": rule_hits(scored),
        "risky_spending": spending,
        "cashback_segments": cashback_segments(spending),
        "active_users": active_users(spending),
        "cashback_effect": cashback_effect(spending),
        "travel_table": travel,
        "insurance_segments": insurance_segments(travel),
        "insurance_potential": potential,
        "insurance_split": insurance_split(potential),
        "traveler_comparison": traveler_comparison(travel),
    }
