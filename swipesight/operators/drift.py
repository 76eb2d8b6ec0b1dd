"""Drift of transactions over time: population stability of the amount, fraud rate, and change points.

Periods are days (UTC) from the first to the last transaction; days without transactions are kept with 0 transactions
and NULL rates. The base is the first `base_days` days. Its amount deciles (exact, linear interpolation, dealt out by
range) are frozen as the edges of `bins` bins; a bin holds the amounts above its lower and up to its upper edge, the
outer bins are open. Repeated edges give empty bins, which count like any other. Rows with a null amount count as
transactions but fall in no bin; rows with a null time are left out.

Shares are smoothed, `(count + 0.5) / (total + 0.5 * bins)`, so that empty bins have a finite logarithm. The population
stability index of a day is `sum over bins of (share - base share) * ln(share / base share)`; NULL for a day without a
binned amount. Levels: below 0.1 `stable`, below 0.25 `moderate`, else `major`.

Change points of the fraud rate: z is the day's rate less the base rate, over the binomial spread of the base rate for
that day's count (0 for an empty day or a base rate of 0 or 1). A two-sided CUSUM adds z less `slack` to the upper sum
and subtracts z plus `slack` from the lower, neither below 0; a day where one exceeds `limit` is a change point, and both
start from 0 the next day. The sums are a fold over the table of days, which has a row per day: it is the only part in
one task, and its size is bounded by the time span, not by the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipesight.functions.ranks import quantiles
from swipesight.functions.semantics import with_row

BASE_DAYS, BINS, SLACK, LIMIT = 7, 10, 0.5, 5.0


def drift(tx: DataFrame, base_days: int = BASE_DAYS, bins: int = BINS, slack: float = SLACK, limit: float = LIMIT) -> DataFrame:
    """One row per day: period_start, transactions, fraud, fraud_rate, psi, psi_level, cusum_up, cusum_down, change_point."""
    rows = tx.where("timestamp IS NOT NULL").selectExpr(
        "CAST(date_trunc('DAY', timestamp) AS TIMESTAMP) AS period_start", "CAST(amount AS DOUBLE) AS amount",
        "coalesce(CAST(is_fraud AS INT), 0) AS fraud", "is_fraud IS NOT NULL AS labelled",
    )
    span = rows.agg(F.min("period_start").alias("first"), F.max("period_start").alias("last"))
    dated = with_row(rows, span, "_span").withColumn(
        "base", F.expr(f"period_start < _span.first + make_interval(0, 0, 0, {base_days})")
    )
    probabilities = [k / bins for k in range(1, bins)]
    edges = quantiles(dated.where("base AND amount IS NOT NULL"), "amount", probabilities).agg(
        F.expr("transform(array_sort(collect_list(struct(p, q))), x -> x.q)").alias("edges")
    )
    binned = with_row(dated, edges, "_e").withColumn(
        "bin", F.expr("IF(amount IS NULL OR _e.edges IS NULL, NULL, size(filter(_e.edges, e -> amount > e)))")
    )
    days = span.selectExpr("explode(sequence(first, last, INTERVAL 1 DAY)) AS period_start")
    spine = days.selectExpr("period_start", f"explode(sequence(0, {bins - 1})) AS bin")
    counts = binned.where("bin IS NOT NULL").groupBy("period_start", "bin").agg(F.count(F.lit(1)).alias("c"))
    base_counts = binned.where("base AND bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("b"))
    cells = spine.join(counts, ["period_start", "bin"], "left").join(F.broadcast(base_counts), "bin", "left").selectExpr(
        "period_start", "bin", "coalesce(c, 0L) AS c", "coalesce(b, 0L) AS b",
    )
    totals = cells.selectExpr(
        "*", "sum(c) OVER (PARTITION BY period_start) AS n", "sum(b) OVER (PARTITION BY period_start) AS nb"
    ).selectExpr(
        "period_start", "n",
        f"(c + 0.5D) / (n + {0.5 * bins}D) AS a", f"(b + 0.5D) / (nb + {0.5 * bins}D) AS e",
    )
    psi = totals.groupBy("period_start").agg(
        F.expr("IF(max(n) > 0, sum((a - e) * ln(a / e)), NULL)").alias("psi")
    )
    per_day = rows.groupBy("period_start").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("fraud").alias("fraud"), F.sum(F.col("labelled").cast("int")).alias("labelled")
    )
    base_rate = dated.where("base AND labelled").agg(F.avg("fraud").alias("rate"))
    series = with_row(days.join(per_day, "period_start", "left").join(psi, "period_start", "left"), base_rate, "_b").selectExpr(
        "period_start", "coalesce(transactions, 0L) AS transactions", "coalesce(fraud, 0L) AS fraud",
        "try_divide(CAST(fraud AS DOUBLE), labelled) AS fraud_rate", "psi",
        "IF(psi IS NULL, NULL, IF(psi < 0.1, 'stable', IF(psi < 0.25, 'moderate', 'major'))) AS psi_level",
        "IF(coalesce(labelled, 0) > 0 AND _b.rate > 0 AND _b.rate < 1, "
        "(fraud / labelled - _b.rate) / sqrt(_b.rate * (1 - _b.rate) / labelled), 0D) AS z",
    )
    # A row per day, folded in order.
    ordered = series.agg(F.expr("array_sort(collect_list(struct(period_start, z)))").alias("days"))
    walked = ordered.selectExpr(
        "aggregate(days, CAST(array() AS ARRAY<STRUCT<period_start: TIMESTAMP, up: DOUBLE, down: DOUBLE, alarm: BOOLEAN>>), "
        "(acc, d) -> concat(acc, array(" + _next("acc", "d", slack, limit) + "))) AS steps"
    ).selectExpr("inline(steps)")
    return series.join(walked, "period_start").selectExpr(
        "period_start", "transactions", "fraud", "fraud_rate", "psi", "psi_level",
        "up AS cusum_up", "down AS cusum_down", "alarm AS change_point",
    )


def _next(acc: str, d: str, slack: float, limit: float) -> str:
    """The state after day d, from the last state in acc."""
    last = f"element_at({acc}, -1)"
    start = f"IF(size({acc}) = 0 OR {last}.alarm, 0D, {last}.{{side}})"
    up = f"greatest(0D, {start.format(side='up')} + {d}.z - {slack}D)"
    down = f"greatest(0D, {start.format(side='down')} - {d}.z - {slack}D)"
    return (
        f"named_struct('period_start', {d}.period_start, 'up', {up}, 'down', {down}, "
        f"'alarm', {up} > {limit}D OR {down} > {limit}D)"
    )
