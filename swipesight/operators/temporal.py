"""Fraud over time and the gaps between a customer's transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swipesight.functions.ranks import quantile_columns
from swipesight.functions.semantics import is_true, ratio, with_row
from swipesight.functions.skew import HOT_KEY_ROWS
from swipesight.operators.customers import quantile_cut, segment_statistics
from swipesight.operators.hypotheses import previous_gap

# Labels of the speed quarters and the limits of the bot rules
SPEED_LABELS = ["Очень быстро", "Быстро", "Медленно", "Очень медленно"]
GAP_RANGE = (1, 86400)
LOW_VARIABILITY, LOW_VARIABILITY_ROWS = 0.1, 3
FAST_SECONDS, FAST_ROWS = 60, 5
TIMING_COLUMNS = [
    "avg_time_diff", "std_time_diff", "transaction_count", "log_avg_time", "log_std_time", "log_count",
]


def interval_counts(df: DataFrame, width: str = "15 minutes") -> DataFrame:
    """Transactions, fraud and fraud rate per tumbling interval."""
    return (
        df.groupBy(F.window("timestamp", width).alias("_w"))
        .agg(F.count("transaction_id").alias("transactions"), F.count_if("is_fraud").alias("fraud"))
        .select(
            F.col("_w.start").alias("interval_start"), "transactions", "fraud",
            ratio(F.col("fraud"), F.col("transactions")).alias("fraud_rate"),
        )
    )


def hourly_series(df: DataFrame) -> DataFrame:
    """Fraud rate per hour from the first to the last, 0 where an hour has no transactions."""
    hourly = df.where("timestamp IS NOT NULL").groupBy(
        F.date_trunc("hour", "timestamp").alias("hour_start")
    ).agg(F.expr("avg(CAST(is_fraud AS INT))").alias("_rate"))
    span = df.agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    spine = span.selectExpr(
        "explode(sequence(date_trunc('hour', _first), date_trunc('hour', _last), INTERVAL 1 HOUR)) AS hour_start",
        "date_trunc('hour', _first) AS _start",
    )
    return spine.join(hourly, "hour_start", "left").selectExpr(
        "hour_start", "coalesce(_rate, 0D) AS fraud_rate",
        "(unix_seconds(hour_start) - unix_seconds(_start)) div 3600 AS t",
    )


def autocorrelation(series: DataFrame, value: str = "fraud_rate", lags: int = 24) -> DataFrame:
    """Autocorrelation of an evenly spaced series indexed by `t`, lags 0 to `lags`."""
    base = series.selectExpr("t", f"CAST({value} AS DOUBLE) AS x")
    level = base.agg(F.avg("x").alias("mean"), F.count("x").alias("n"))
    centred = with_row(base, level, "_l").selectExpr("t", "x - _l.mean AS x", "_l.n AS n")
    spread = centred.agg(F.sum(F.col("x") * F.col("x")).alias("total"))
    ahead = centred.selectExpr(f"explode(sequence(0, {lags})) AS lag", "t", "x", "n").selectExpr(
        "lag", "t + lag AS t", "x AS x0", "n"
    )
    products = ahead.join(centred.select("t", "x"), "t").groupBy("lag").agg(
        F.sum(F.col("x0") * F.col("x")).alias("_p"), F.first("n").alias("n")
    )
    return with_row(products, spread, "_s").selectExpr(
        "lag", "try_divide(_p, _s.total) AS acf",
        "coalesce(abs(try_divide(_p, _s.total)) > 1.96D / sqrt(n), false) AS significant",
    )


def valid_gaps(df: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Transactions whose gap to the customer's previous one is between a second and a day."""
    return previous_gap(df, "gap_seconds", hot_rows).where(
        f"gap_seconds BETWEEN {GAP_RANGE[0]} AND {GAP_RANGE[1]}"
    )


def arrival_patterns(df: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Gap statistics and fraud rate per customer with the bot rules."""
    stats = valid_gaps(df, hot_rows).groupBy("customer_id").agg(
        F.expr("avg(gap_seconds)").alias("avg_time_diff"),
        F.expr("stddev_samp(gap_seconds)").alias("std_time_diff"),
        F.expr("min(gap_seconds)").alias("min_time_diff"),
        F.expr("max(gap_seconds)").alias("max_time_diff"),
        F.expr("count(gap_seconds)").alias("transaction_count"),
        F.expr("avg(CAST(is_fraud AS INT))").alias("fraud_rate"),
    )
    steady = is_true(F.col("std_time_diff") < F.col("avg_time_diff") * LOW_VARIABILITY) & (
        F.col("transaction_count") > LOW_VARIABILITY_ROWS
    )
    fast = is_true(F.col("avg_time_diff") < FAST_SECONDS) & (F.col("transaction_count") > FAST_ROWS)
    return stats.withColumns({"low_variability": steady, "high_frequency": fast, "bot_like": steady | fast})


def group_fraud_rates(patterns: DataFrame, member: str = "bot_like") -> DataFrame:
    """Customers and mean fraud rate inside and outside a group, with their ratio."""
    inside = is_true(F.col(member))
    counts = patterns.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(inside).alias("members"),
        F.avg(F.when(inside, F.col("fraud_rate"))).alias("member_fraud_rate"),
        F.avg(F.when(~inside, F.col("fraud_rate"))).alias("other_fraud_rate"),
    )
    return counts.withColumns({
        "member_percent": ratio(F.col("members"), F.col("customers")) * 100,
        "rate_ratio": ratio(F.col("member_fraud_rate"), F.col("other_fraud_rate")),
    })


def speed_segments(patterns: DataFrame) -> DataFrame:
    """Fraud rate by quarter of the mean gap."""
    cut = quantile_cut(patterns.select("avg_time_diff", "fraud_rate"), "avg_time_diff", SPEED_LABELS, "time_segment")
    return segment_statistics(cut, "time_segment", SPEED_LABELS, {"fraud_rate": F.avg("fraud_rate")})


def timing_features(patterns: DataFrame) -> DataFrame:
    """Gap features with logs; gaps in them are filled by the column medians."""
    logged = patterns.selectExpr(
        "customer_id", "fraud_rate", "avg_time_diff", "std_time_diff",
        "CAST(transaction_count AS DOUBLE) AS transaction_count",
        "log1p(avg_time_diff) AS log_avg_time", "log1p(std_time_diff) AS log_std_time",
        "log1p(transaction_count) AS log_count",
    )
    middle = quantile_columns(logged, {c: (c, 0.5) for c in TIMING_COLUMNS})
    return with_row(logged, middle, "_m").selectExpr(
        "customer_id", "fraud_rate", *[f"coalesce({c}, _m.{c}) AS {c}" for c in TIMING_COLUMNS]
    )


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns centred and divided by the population deviation; a constant column becomes 0."""
    level = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    )
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    return with_row(df, level, "_l").selectExpr(
        *kept,
        *[f"({c} - _l.m_{c}) / CASE WHEN _l.s_{c} = 0 THEN 1D ELSE _l.s_{c} END AS {c}" for c in columns],
    )


# --- density clusters of fraud in (minute of day, weekday) ------------------------------------


def time_cells(df: DataFrame) -> DataFrame:
    """Fraud per (minute of day, weekday): at most 1440 x 7 cells whatever the size of the table."""
    return df.where("is_fraud").groupBy(
        F.expr("hour(timestamp) * 60 + minute(timestamp)").alias("minute"),
        F.expr("weekday(timestamp)").alias("weekday"),
    ).agg(F.count(F.lit(1)).alias("weight"))


def time_clusters(df: DataFrame, eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """Density clusters of the cells: (minute, weekday, weight, core, cluster), -1 for noise.

    A cell is as many points as its weight. Distances are in units of the population deviation.
    Neighbours within `eps` weighing `min_points` make a core cell; core cells within `eps` of each
    other form a cluster, and a border cell joins the lowest-numbered cluster in reach.
    """
    cells = time_cells(df)
    moments = cells.selectExpr("CAST(weight AS DOUBLE) AS w", "minute", "weekday").agg(
        F.expr("sqrt(sum(w * minute * minute) / sum(w) - power(sum(w * minute) / sum(w), 2))").alias("sm"),
        F.expr("sqrt(sum(w * weekday * weekday) / sum(w) - power(sum(w * weekday) / sum(w), 2))").alias("sd"),
    )
    placed = with_row(cells, moments, "_s").selectExpr(
        "minute", "weekday", "weight", "weekday * 1440 + minute AS cell",
        "minute / CASE WHEN _s.sm = 0 THEN 1D ELSE _s.sm END AS x",
        "weekday / CASE WHEN _s.sd = 0 THEN 1D ELSE _s.sd END AS y",
    )
    # neighbours share a strip of width eps in x, or sit in adjacent strips
    strips = placed.selectExpr("*", f"CAST(floor(x / {eps}D) AS INT) AS strip")
    other = strips.selectExpr("cell AS cell2", "weight AS weight2", "x AS x2", "y AS y2", "strip")
    around = strips.selectExpr("cell", "x", "y", "explode(array(strip - 1, strip, strip + 1)) AS strip")
    near = around.join(other, "strip").where(
        f"(x - x2) * (x - x2) + (y - y2) * (y - y2) <= {eps * eps}D"
    )
    core = near.groupBy("cell").agg(F.sum("weight2").alias("_reach")).where(f"_reach >= {min_points}")
    core_ids = core.select("cell")
    pairs = near.select("cell", "cell2").join(F.broadcast(core_ids), "cell")
    links = pairs.join(F.broadcast(core_ids.withColumnRenamed("cell", "cell2")), "cell2").where("cell < cell2")

    from swipesight.operators.graph import components_of_pairs

    groups = components_of_pairs(core_ids, links, "cell", "cell2")
    order = Window.orderBy("component")  # over at most 10,080 cells
    numbered = groups.withColumn("cluster", F.dense_rank().over(order) - 1).select("cell", "cluster")
    border = pairs.join(F.broadcast(numbered), "cell").groupBy("cell2").agg(F.min("cluster").alias("_border"))
    return (
        placed.join(F.broadcast(numbered), "cell", "left")
        .join(F.broadcast(border.withColumnRenamed("cell2", "cell")), "cell", "left")
        .selectExpr(
            "minute", "weekday", "weight", "cluster IS NOT NULL AS core",
            "coalesce(cluster, _border, -1) AS cluster",
        )
    )


def cluster_statistics(clusters: DataFrame) -> DataFrame:
    """Per cluster: transactions, mean and deviation of the minute, most frequent weekday."""
    cells = clusters.where("cluster <> -1").selectExpr(
        "cluster", "weekday", "CAST(weight AS DOUBLE) AS w", "CAST(minute AS DOUBLE) AS m", "weight"
    )
    days = cells.groupBy("cluster", "weekday").agg(F.sum("weight").alias("_n"))
    common = days.groupBy("cluster").agg(F.expr("min_by(weekday, struct(-_n, weekday))").alias("usual_weekday"))
    means = cells.groupBy("cluster").agg(
        F.sum("weight").alias("transactions"),
        F.expr("sum(w * m) / sum(w)").alias("mean_minute"),
        F.expr("sqrt(try_divide(greatest(sum(w * m * m) - power(sum(w * m), 2) / sum(w), 0D), sum(w) - 1))").alias("std_minute"),
    )
    return means.join(F.broadcast(common), "cluster")


def cluster_summary(clusters: DataFrame) -> DataFrame:
    inside = F.col("cluster") != -1
    return clusters.agg(
        F.count_distinct(F.when(inside, F.col("cluster"))).alias("clusters"),
        F.coalesce(F.sum(F.when(inside, F.col("weight"))), F.lit(0)).alias("clustered"),
        F.coalesce(F.sum(F.when(~inside, F.col("weight"))), F.lit(0)).alias("noise"),
    )
