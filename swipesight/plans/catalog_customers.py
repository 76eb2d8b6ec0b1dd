"""Registered queries: customer tables and the five business rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from swipesight.functions.semantics import rate
from swipesight.operators import customers as cu
from swipesight.operators import hypotheses as hy
from swipesight.operators import profiling
from swipesight.operators.fraud import compare_groups
from swipesight.plans.oracle import with_txn
from swipesight.plans.query import Query, form
from swipesight.sources import fixtures
from swipesight.streaming import scoring

CATEGORIES = ["PROMO", "ECONOMY"]


def _cut(value: str, edges, labels) -> str:
    parts = []
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        upper = "" if high == float("inf") else f" AND {value} <= {high}"
        parts.append(f"WHEN {value} > {low}{upper} THEN '{label}'")
    return f"CASE {' '.join(parts)} END"


def _qcut(table: str, value: str, labels) -> str:
    q = len(labels)
    edge = lambda i: f"(SELECT quantile_cont({value}, {i / q}) FROM {table})"
    parts = []
    for i, label in enumerate(labels):
        above = ">=" if i == 0 else ">"
        parts.append(f"WHEN {value} {above} {edge(i)} AND {value} <= {edge(i + 1)} THEN '{label}'")
    return f"CASE {' '.join(parts)} END"


def _spine(name: str, labels) -> str:
    values = ", ".join(f"('{label}', {i})" for i, label in enumerate(labels))
    return f"{name}(segment, ordinal) AS (VALUES {values})"


def _day(column: str) -> str:
    return f"CAST({column} AS DATE)"


CUSTOMERS = f""", ct AS (
  SELECT customer_id, count(*) AS total_transactions, sum(amount) AS total_amount, avg(amount) AS avg_amount,
    max(amount) AS max_amount, count(*) FILTER (WHERE is_fraud) AS fraud_count,
    count(*) FILTER (WHERE is_outside_home_country) AS outside_country_count,
    count(*) FILTER (WHERE is_high_risk_vendor) AS high_risk_count,
    min(timestamp) AS first_transaction, max(timestamp) AS last_transaction,
    (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 86400000000 + 1 AS activity_days,
    avg(CAST(is_outside_home_country AS INTEGER)) AS abroad_ratio,
    coalesce(avg(amount) FILTER (WHERE is_high_risk_vendor), 0) AS avg_high_risk_amount,
    coalesce(sum(amount) FILTER (WHERE is_high_risk_vendor), 0) AS total_high_risk_amount
  FROM txn GROUP BY customer_id),
cr AS (SELECT *, fraud_count / total_transactions AS fraud_rate,
    total_transactions / activity_days AS transactions_per_day, total_amount / activity_days AS avg_amount_per_day,
    total_amount * 0.015 AS estimated_revenue, fraud_count * avg_amount * 10 AS fraud_cost FROM ct),
cv AS (SELECT *, estimated_revenue - fraud_cost AS net_value,
    {_cut('fraud_rate', cu.RISK_EDGES, cu.RISK_LABELS)} AS risk_segment,
    {_qcut('cr', 'total_amount', cu.VALUE_LABELS)} AS value_segment,
    outside_country_count > (SELECT quantile_cont(outside_country_count, 0.5) FROM cr)
      OR avg_high_risk_amount > (SELECT quantile_cont(avg_high_risk_amount, 0.5) FROM cr) * 2
      OR total_amount > (SELECT quantile_cont(total_amount, 0.75) FROM cr) AS premium_candidate
  FROM cr)
"""
CUSTOMER_FORM = (
    "customer_id #total_transactions ~total_amount ~avg_amount ~max_amount #fraud_count #outside_country_count "
    "#high_risk_count @first_transaction @last_transaction #activity_days ~abroad_ratio ~avg_high_risk_amount "
    "~total_high_risk_amount ~transactions_per_day ~avg_amount_per_day ~fraud_rate risk_segment "
    "~estimated_revenue ~fraud_cost ~net_value value_segment"
)
CUSTOMER_NAMES = ", ".join(c.lstrip("~#@") for c in CUSTOMER_FORM.split())

DAYS = """, hist AS (
  SELECT customer_id, avg(amount) AS avg_amount, stddev_samp(amount) AS std_amount, max(amount) AS max_amount,
    count(DISTINCT CAST(timestamp AS DATE)) AS active_days FROM txn GROUP BY customer_id),
lim AS (SELECT *, avg_amount * 3 + std_amount * 3 AS dynamic_daily_limit, max_amount * 1.5 AS dynamic_single_limit FROM hist),
raw_days AS (SELECT customer_id, CAST(timestamp AS DATE) AS date, sum(amount) AS daily_total, count(amount) AS daily_count,
    max(amount) AS daily_max, count(*) FILTER (WHERE is_fraud) AS fraud_count FROM txn GROUP BY 1, 2),
days AS (SELECT d.*, dynamic_daily_limit, dynamic_single_limit,
    daily_total > 1000 OR daily_max > 500 OR daily_count > 10 AS static_block,
    coalesce(daily_total > dynamic_daily_limit, FALSE) OR coalesce(daily_max > dynamic_single_limit, FALSE) AS dynamic_block,
    fraud_count = 0 AS legitimate FROM raw_days d LEFT JOIN lim USING (customer_id))
"""

SCORES = """, gaps AS (SELECT *, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (
      PARTITION BY customer_id ORDER BY timestamp, transaction_id)) / 1e6 AS gap_seconds,
    avg(amount) OVER (PARTITION BY customer_id) AS avg_amount,
    stddev_samp(amount) OVER (PARTITION BY customer_id) AS std_amount FROM txn),
zs AS (SELECT *, (amount - avg_amount) / CASE WHEN std_amount = 0 THEN 1 ELSE std_amount END AS amount_zscore FROM gaps),
rules AS (SELECT *, coalesce(abs(amount_zscore) > 3, FALSE) AS rule_amount,
    is_high_risk_vendor AND is_outside_home_country AS rule_risky_abroad,
    hour(timestamp) BETWEEN 0 AND 5 AS rule_night, coalesce(gap_seconds < 600, FALSE) AS rule_frequent FROM zs),
sc AS (SELECT *, CAST(rule_amount AS INTEGER) + CAST(rule_risky_abroad AS INTEGER) + CAST(rule_night AS INTEGER)
    + CAST(rule_frequent AS INTEGER) AS suspicious_score FROM rules),
scored AS (SELECT *, suspicious_score >= 2 AS is_suspicious FROM sc)
"""
CAUSAL = """, prev AS (SELECT *, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (
      PARTITION BY customer_id ORDER BY timestamp, transaction_id)) / 1e6 AS gap_all,
    count(amount) OVER w AS n, avg(amount) OVER w AS mean_prev, stddev_samp(amount) OVER w AS std_prev FROM txn
    WINDOW w AS (PARTITION BY customer_id ORDER BY timestamp, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
zs AS (SELECT *, CASE WHEN customer_id IS NOT NULL THEN gap_all END AS gap_seconds,
    CASE WHEN customer_id IS NOT NULL AND n >= 2 AND amount IS NOT NULL
      THEN (amount - mean_prev) / CASE WHEN std_prev = 0 THEN 1 ELSE std_prev END END AS amount_zscore FROM prev),
rules AS (SELECT *, coalesce(abs(amount_zscore) > 3, FALSE) AS rule_amount,
    coalesce(is_high_risk_vendor AND is_outside_home_country, FALSE) AS rule_risky_abroad,
    coalesce(hour(timestamp) BETWEEN 0 AND 5, FALSE) AS rule_night, coalesce(gap_seconds < 600, FALSE) AS rule_frequent FROM zs),
sc AS (SELECT *, CAST(rule_amount AS INTEGER) + CAST(rule_risky_abroad AS INTEGER) + CAST(rule_night AS INTEGER)
    + CAST(rule_frequent AS INTEGER) AS suspicious_score FROM rules)
SELECT transaction_id, customer_id, timestamp, gap_seconds, amount_zscore, rule_amount, rule_risky_abroad, rule_night,
    rule_frequent, suspicious_score, suspicious_score >= 2 AS is_suspicious, FALSE AS late FROM sc
"""
CAUSAL_FORM = ("transaction_id customer_id @timestamp ~gap_seconds ~amount_zscore rule_amount rule_risky_abroad rule_night "
               "rule_frequent #suspicious_score is_suspicious late")
SCORE_COLUMNS = ["transaction_id", "customer_id", "timestamp", "amount", "is_high_risk_vendor",
                 "is_outside_home_country", "is_fraud"]

SPENDING = f""", sp0 AS (SELECT customer_id, sum(amount) AS total_amount, count(*) AS total_count,
    coalesce(sum(amount) FILTER (WHERE vendor_category IN ('PROMO', 'ECONOMY')), 0) AS risky_total,
    count(*) FILTER (WHERE vendor_category IN ('PROMO', 'ECONOMY')) AS risky_count,
    avg(amount) FILTER (WHERE vendor_category IN ('PROMO', 'ECONOMY')) AS risky_avg
  FROM txn GROUP BY customer_id),
sp1 AS (SELECT *, risky_total / total_amount AS risky_ratio, risky_count / total_count AS risky_tx_ratio FROM sp0),
sp AS (SELECT *, {_cut('risky_ratio', cu.USAGE_EDGES, cu.USAGE_LABELS)} AS risk_category_usage FROM sp1),
act AS (SELECT * FROM sp WHERE risky_ratio > (SELECT quantile_cont(risky_ratio, 0.75) FROM sp))
"""
SPENDING_FORM = "customer_id ~total_amount #total_count ~risky_total #risky_count ~risky_avg ~risky_ratio " \
    "~risky_tx_ratio risk_category_usage"

TRAVEL = f""", tr0 AS (SELECT customer_id, count(*) FILTER (WHERE is_outside_home_country) AS abroad_count,
    avg(CAST(is_outside_home_country AS INTEGER)) AS abroad_ratio, sum(amount) AS total_amount,
    avg(amount) AS avg_amount, count(amount) AS tx_count, count(DISTINCT country) AS unique_countries
  FROM txn GROUP BY customer_id),
tr AS (SELECT *, {_cut('abroad_count', cu.TRAVEL_EDGES, cu.TRAVEL_LABELS)} AS traveler_segment FROM tr0),
{_spine('ts', cu.TRAVEL_LABELS)},
pot AS (SELECT ts.segment AS traveler_segment, ordinal, count(customer_id) AS customers,
    0.02::DOUBLE * (CASE ordinal WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN 1.5 ELSE 3.0 END) AS conv
  FROM ts LEFT JOIN tr ON tr.traveler_segment = ts.segment GROUP BY 1, 2)
"""


def _compare(table: str, member: str, metrics, names) -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, avg({m}) FILTER (WHERE {member}) AS {names[0]}, "
        f"avg({m}) FILTER (WHERE NOT {member}) AS {names[1]} FROM {table}" for m in metrics)


def txn(*columns):
    return lambda spark, sf: fixtures.transactions(spark, sf, columns or None)


CUSTOMER_INPUT = ["transaction_id", "customer_id", "amount", "timestamp", "is_fraud",
                  "is_outside_home_country", "is_high_risk_vendor"]


def _customers(spark, sf):
    return cu.customer_value(fixtures.transactions(spark, sf, CUSTOMER_INPUT))


def _segments(spark, sf):
    return hy.premium_segments(_customers(spark, sf))


def _day_input(spark, sf):
    return fixtures.transactions(spark, sf, ["customer_id", "timestamp", "amount", "is_fraud"])


def _scored(spark, sf):
    return hy.suspicion_scores(fixtures.transactions(spark, sf, SCORE_COLUMNS))


def _spending(spark, sf):
    t = fixtures.transactions(spark, sf, ["transaction_id", "customer_id", "vendor_category", "amount"])
    return cu.risky_spending(t, CATEGORIES)


def _travel(spark, sf):
    return cu.travel_table(fixtures.transactions(
        spark, sf, ["customer_id", "country", "amount", "is_outside_home_country"]))


def on(load, operator):
    return lambda spark, sf: operator(load(spark, sf))


def entries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["customer_value"] = Query(
        _customers, form(with_txn(CUSTOMERS + f"SELECT {CUSTOMER_NAMES} FROM cv"), CUSTOMER_FORM))
    q["abroad_ratio"] = Query(
        lambda s, sf: fixtures.transactions(s, sf, ["customer_id", "is_outside_home_country"]).groupBy(
            "customer_id").agg(rate("is_outside_home_country").alias("abroad_ratio")),
        form(with_txn("SELECT customer_id, avg(CAST(is_outside_home_country AS INTEGER)) AS abroad_ratio "
                      "FROM txn GROUP BY 1"), "customer_id ~abroad_ratio"))
    q["premium_segmentation"] = Query(
        on(_segments, lambda t: t.select("customer_id", "total_amount", "outside_country_count",
                                         "avg_high_risk_amount", "value_segment", "premium_candidate")),
        form(with_txn(CUSTOMERS + """SELECT customer_id, total_amount, outside_country_count, avg_high_risk_amount,
          value_segment, premium_candidate FROM cv"""),
             "customer_id ~total_amount #outside_country_count ~avg_high_risk_amount value_segment premium_candidate"))
    q["premium_summary"] = Query(
        on(_segments, hy.premium_summary),
        form(with_txn(CUSTOMERS + """SELECT count(*) AS customers, count(*) FILTER (WHERE premium_candidate) AS candidates,
          count(*) FILTER (WHERE premium_candidate) * 100.0 / count(*) AS candidate_percent,
          count(*) FILTER (WHERE premium_candidate) * 120 AS yearly_revenue FROM cv"""),
             "#customers #candidates ~candidate_percent #yearly_revenue"))
    q["premium_comparison"] = Query(
        on(_segments, hy.premium_comparison),
        form(with_txn(CUSTOMERS + _compare("cv", "premium_candidate", [
            "total_amount", "avg_amount", "outside_country_count", "high_risk_count"], ("candidates", "regular"))),
             "metric ~candidates ~regular"))
    q["premium_by_value_segment"] = Query(
        on(_segments, hy.premium_by_value_segment),
        form(with_txn(CUSTOMERS + f""", {_spine('vs', cu.VALUE_LABELS)}
          SELECT vs.segment AS value_segment, ordinal, count(customer_id) AS customers,
            avg(CAST(premium_candidate AS INTEGER)) * 100 AS premium_percent
          FROM vs LEFT JOIN cv ON cv.value_segment = vs.segment GROUP BY 1, 2"""),
             "value_segment #ordinal #customers ~premium_percent"))
    q["premium_amount_histogram"] = Query(
        on(_segments, lambda t: profiling.histogram(t, "total_amount", 20, {
            "candidates": F.col("premium_candidate"), "regular": ~F.col("premium_candidate")})),
        form(with_txn(CUSTOMERS + """, b AS (SELECT min(total_amount) AS lo, max(total_amount) AS hi FROM cv),
          h AS (SELECT cv.*, least(floor(20 * (total_amount - lo) / (hi - lo)) + 1, 20) AS bin FROM cv, b)
          SELECT s.bin, lo + (s.bin - 1) * ((hi - lo) / 20) AS bin_low, lo + s.bin * ((hi - lo) / 20) AS bin_high,
            count(*) FILTER (WHERE premium_candidate) AS candidates,
            count(*) FILTER (WHERE NOT premium_candidate) AS regular
          FROM (SELECT unnest(generate_series(1, 20)) AS bin) s, b LEFT JOIN h ON h.bin = s.bin
          GROUP BY s.bin, lo, hi"""), "#bin ~bin_low ~bin_high #candidates #regular"))

    q["customer_days"] = Query(
        on(_day_input, cu.customer_days),
        form(with_txn(DAYS + "SELECT customer_id, date, daily_total, daily_count, daily_max, fraud_count FROM days"),
             "customer_id !date ~daily_total #daily_count ~daily_max #fraud_count"))
    q["customer_limits"] = Query(
        on(_day_input, hy.dynamic_limits),
        form(with_txn(DAYS + "SELECT * FROM lim"),
             "customer_id ~avg_amount ~std_amount ~max_amount #active_days ~dynamic_daily_limit ~dynamic_single_limit"))
    q["limit_days"] = Query(
        on(_day_input, hy.limit_days),
        form(with_txn(DAYS + "SELECT * FROM days"),
             "customer_id !date ~daily_total #daily_count ~daily_max #fraud_count ~dynamic_daily_limit "
             "~dynamic_single_limit static_block dynamic_block legitimate"))
    q["limit_summary"] = Query(
        on(_day_input, lambda t: hy.limit_summary(hy.limit_days(t))),
        form(with_txn(DAYS + """, c AS (SELECT count(*) FILTER (WHERE legitimate) AS legitimate_days,
            count(*) FILTER (WHERE legitimate AND static_block) AS false_blocks_static,
            count(*) FILTER (WHERE legitimate AND dynamic_block) AS false_blocks_dynamic,
            count(*) FILTER (WHERE NOT legitimate) AS fraud_days,
            count(*) FILTER (WHERE NOT legitimate AND NOT static_block) AS missed_static,
            count(*) FILTER (WHERE NOT legitimate AND NOT dynamic_block) AS missed_dynamic FROM days),
          r AS (SELECT *, false_blocks_static / legitimate_days * 100 AS false_rate_static,
            false_blocks_dynamic / legitimate_days * 100 AS false_rate_dynamic,
            missed_static / fraud_days * 100 AS miss_rate_static,
            missed_dynamic / fraud_days * 100 AS miss_rate_dynamic FROM c)
          SELECT *, (false_rate_static - false_rate_dynamic) / false_rate_static * 100 AS reduction_percent,
            (false_rate_static - false_rate_dynamic) / false_rate_static * 100 >= 30 AS goal_met FROM r"""),
             "#legitimate_days #false_blocks_static #false_blocks_dynamic #fraud_days #missed_static #missed_dynamic "
             "~false_rate_static ~false_rate_dynamic ~miss_rate_static ~miss_rate_dynamic ~reduction_percent goal_met"))

    def top_limits(t):
        limits = hy.dynamic_limits(t)
        return hy.top_customer_limits(hy.limit_days(t, limits), limits)

    q["top_customer_limits"] = Query(
        on(_day_input, top_limits),
        form(with_txn(DAYS + """SELECT * FROM lim WHERE customer_id IN (SELECT customer_id FROM days GROUP BY customer_id
          ORDER BY avg(daily_total) DESC, customer_id LIMIT 10)"""),
             "customer_id ~avg_amount ~std_amount ~max_amount #active_days ~dynamic_daily_limit ~dynamic_single_limit"))
    q["dynamic_limit_histogram"] = Query(
        on(_day_input, lambda t: profiling.histogram(hy.dynamic_limits(t), "dynamic_daily_limit", 50)),
        form(with_txn(DAYS + """, b AS (SELECT min(dynamic_daily_limit) AS lo, max(dynamic_daily_limit) AS hi FROM lim),
          h AS (SELECT least(floor(50 * (dynamic_daily_limit - lo) / (hi - lo)) + 1, 50) AS bin FROM lim, b
                WHERE dynamic_daily_limit IS NOT NULL)
          SELECT s.bin, lo + (s.bin - 1) * ((hi - lo) / 50) AS bin_low, lo + s.bin * ((hi - lo) / 50) AS bin_high,
            count(h.bin) AS n FROM (SELECT unnest(generate_series(1, 50)) AS bin) s, b
            LEFT JOIN h ON h.bin = s.bin GROUP BY s.bin, lo, hi"""), "#bin ~bin_low ~bin_high #n"))

    q["suspicion_scores"] = Query(
        on(_scored, lambda t: t.select("transaction_id", "gap_seconds", "amount_zscore", "rule_amount",
                                       "rule_risky_abroad", "rule_night", "rule_frequent", "suspicious_score",
                                       "is_suspicious")),
        form(with_txn(SCORES + "SELECT * FROM scored"),
             "transaction_id ~gap_seconds ~amount_zscore rule_amount rule_risky_abroad rule_night rule_frequent "
             "#suspicious_score is_suspicious"))
    q["causal_suspicion_scores"] = Query(
        on(txn(*scoring.COLUMNS), scoring.causal_scores), form(with_txn(CAUSAL), CAUSAL_FORM))
    q["suspicion_stream"] = Query(
        lambda spark, sf: scoring.drain(spark, fixtures.transactions(spark, sf, scoring.COLUMNS)), form(with_txn(CAUSAL), CAUSAL_FORM))
    q["suspicion_summary"] = Query(
        on(_scored, hy.suspicion_summary),
        form(with_txn(SCORES + """, c AS (SELECT count(*) AS transactions, count(*) FILTER (WHERE is_suspicious) AS suspicious,
            count(*) FILTER (WHERE is_suspicious AND is_fraud) AS suspicious_fraud,
            count(*) FILTER (WHERE is_suspicious AND NOT is_fraud) AS suspicious_legitimate,
            count(*) FILTER (WHERE is_fraud) AS fraud,
            avg(amount) FILTER (WHERE is_suspicious AND NOT is_fraud) AS avg_legitimate_amount FROM scored),
          e AS (SELECT *, suspicious_legitimate * (0.7::DOUBLE * 1.4::DOUBLE) AS confirmed_after,
            suspicious_legitimate * 0.7::DOUBLE AS confirmed_before FROM c)
          SELECT *, suspicious / transactions * 100 AS suspicious_percent, suspicious_fraud / suspicious AS precision,
            suspicious_fraud / fraud AS recall, confirmed_after - confirmed_before AS additional_confirmed,
            (confirmed_after - confirmed_before) * avg_legitimate_amount AS additional_volume,
            (confirmed_after - confirmed_before) * avg_legitimate_amount * 0.015 AS additional_revenue FROM e"""),
             "#transactions #suspicious #suspicious_fraud #suspicious_legitimate #fraud ~avg_legitimate_amount "
             "~suspicious_percent ~precision ~recall ~confirmed_before ~confirmed_after ~additional_confirmed "
             "~additional_volume ~additional_revenue"))
    q["score_distribution"] = Query(
        on(_scored, hy.score_distribution),
        form(with_txn(SCORES + "SELECT suspicious_score, count(*) AS n FROM scored GROUP BY 1"), "#suspicious_score #n"))
    hits = " UNION ALL ".join(
        f"SELECT '{r}' AS rule, count(*) FILTER (WHERE {r}) AS hits FROM scored"
        for r in ["rule_amount", "rule_risky_abroad", "rule_night", "rule_frequent"])
    q["rule_hits"] = Query(on(_scored, hy.rule_hits), form(with_txn(SCORES + hits), "rule #hits"))

    q["risky_spending"] = Query(
        _spending, form(with_txn(SPENDING + "SELECT * FROM sp"), SPENDING_FORM))
    q["cashback_segments"] = Query(
        on(_spending, hy.cashback_segments),
        form(with_txn(SPENDING + f""", {_spine('us', cu.USAGE_LABELS)}
          SELECT us.segment AS risk_category_usage, ordinal, count(customer_id) AS customers,
            avg(total_amount) AS avg_total, avg(risky_total) AS avg_risky_total, avg(total_count) AS avg_transactions
          FROM us LEFT JOIN sp ON sp.risk_category_usage = us.segment GROUP BY 1, 2"""),
             "risk_category_usage #ordinal #customers ~avg_total ~avg_risky_total ~avg_transactions"))
    q["active_risky_users"] = Query(
        on(_spending, hy.active_users), form(with_txn(SPENDING + "SELECT * FROM act"), SPENDING_FORM))
    q["cashback_effect"] = Query(
        on(_spending, hy.cashback_effect),
        form(with_txn(SPENDING + """, v AS (SELECT count(*) AS active_users, coalesce(sum(risky_total), 0) AS current_volume FROM act),
          w AS (SELECT *, current_volume * 1.25 AS predicted_volume FROM v),
          x AS (SELECT *, predicted_volume * 0.02 AS cashback_cost, predicted_volume - current_volume AS additional_volume,
            (predicted_volume - current_volume) * 0.015 AS additional_revenue FROM w)
          SELECT *, additional_revenue - cashback_cost AS net_effect, CASE WHEN cashback_cost > 0
            THEN (additional_revenue - cashback_cost) / cashback_cost * 100 ELSE 0 END AS roi_percent FROM x"""),
             "#active_users ~current_volume ~predicted_volume ~cashback_cost ~additional_volume ~additional_revenue "
             "~net_effect ~roi_percent"))

    q["travel_table"] = Query(
        _travel, form(with_txn(TRAVEL + "SELECT * FROM tr"),
                      "customer_id #abroad_count ~abroad_ratio ~total_amount ~avg_amount #tx_count "
                      "#unique_countries traveler_segment"))
    q["insurance_segments"] = Query(
        on(_travel, hy.insurance_segments),
        form(with_txn(TRAVEL + """SELECT ts.segment AS traveler_segment, ordinal, count(customer_id) AS customers,
            avg(abroad_count) AS avg_abroad_count, avg(total_amount) AS avg_total, avg(tx_count) AS avg_transactions,
            avg(unique_countries) AS avg_countries
          FROM ts LEFT JOIN tr ON tr.traveler_segment = ts.segment GROUP BY 1, 2"""),
             "traveler_segment #ordinal #customers ~avg_abroad_count ~avg_total ~avg_transactions ~avg_countries"))
    q["insurance_potential"] = Query(
        on(_travel, hy.insurance_potential),
        form(with_txn(TRAVEL + """SELECT traveler_segment, ordinal, customers, conv * 100 AS conversion_percent,
            customers * conv AS expected_sales, customers * conv * 100 AS expected_revenue FROM pot"""),
             "traveler_segment #ordinal #customers ~conversion_percent ~expected_sales ~expected_revenue"))
    q["insurance_split"] = Query(
        on(_travel, lambda t: hy.insurance_split(hy.insurance_potential(t))),
        form(with_txn(TRAVEL + """SELECT sum(customers * conv * 100) AS total_revenue,
            sum(CASE WHEN ordinal = 3 THEN customers * conv * 100 END) AS frequent_revenue,
            sum(CASE WHEN ordinal <> 3 THEN customers * conv * 100 END) AS other_revenue FROM pot"""),
             "~total_revenue ~frequent_revenue ~other_revenue"))
    q["traveler_comparison"] = Query(
        on(_travel, hy.traveler_comparison),
        form(with_txn(TRAVEL + f""", tc AS (SELECT *, traveler_segment = '{cu.TRAVEL_LABELS[-1]}' AS fr FROM tr) """
                      + _compare("tc", "fr", ["total_amount", "avg_amount", "tx_count", "unique_countries"],
                                 ("frequent", "other"))), "metric ~frequent ~other"))
    q["abroad_comparison"] = Query(
        on(txn("amount", "is_fraud", "is_outside_home_country", "is_high_risk_vendor"),
           lambda t: compare_groups(
               t.select("amount", "is_outside_home_country", F.col("is_fraud").cast("int").alias("is_fraud"),
                        F.col("is_high_risk_vendor").cast("int").alias("is_high_risk_vendor")),
               "is_outside_home_country", ["amount", "is_fraud", "is_high_risk_vendor"], ("abroad", "home"))),
        form(with_txn(", x AS (SELECT amount, CAST(is_fraud AS INTEGER) AS is_fraud, is_outside_home_country, "
                      "CAST(is_high_risk_vendor AS INTEGER) AS is_high_risk_vendor FROM txn) "
                      + _compare("x", "is_outside_home_country", ["amount", "is_fraud", "is_high_risk_vendor"],
                                 ("abroad", "home"))), "metric ~abroad ~home"))
    return q
