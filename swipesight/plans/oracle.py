"""The fixture views written once more in DuckDB SQL, as common table expressions."""

from __future__ import annotations

TXN = """
ev AS (
  SELECT event_id, user_id, value, ts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE user_id % 3 WHEN 0 THEN FALSE WHEN 1 THEN event_id % 28 = 0
              ELSE event_id % 7 = 0 END AS abroad
  FROM events),
ej AS (
  SELECT ev.*, p_type, p_brand, s_name, c_mktsegment,
         CASE WHEN abroad THEN (c_nationkey + 1 + event_id % 5) % 25 ELSE c_nationkey END AS nk
  FROM ev LEFT JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part)
          LEFT JOIN supplier ON s_suppkey = event_id % (SELECT count(*) FROM supplier)
          JOIN customer ON c_custkey = user_id),
txn AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id,
         'C' || user_id AS customer_id,
         4000000000000000 + user_id * 10 + event_id % 2 AS card_number,
         ts AS timestamp,
         p_type AS vendor_category, p_brand AS vendor_type, s_name AS vendor,
         value * 5 AS amount,
         (['AUD','BRL','CAD','EUR','GBP','JPY','MXN','NGN','RUB','SGD','USD'])[nk % 11 + 1] AS currency,
         n_name AS country,
         CASE WHEN event_id % 97 <> 0 THEN n_name || '_' || (event_id % 4) END AS city,
         CASE WHEN event_id % 4 < 2 THEN 'medium' ELSE 'large' END AS city_size,
         c_mktsegment AS card_type,
         k % 3 = 2 AS is_card_present,
         CASE WHEN event_id % 50 <> 0 THEN
              CASE k % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'iOS App' ELSE 'Chip Reader' END END AS device,
         CASE k % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' ELSE 'pos' END AS channel,
         'fp' || ((user_id // 3) * 4 + k % 4) AS device_fingerprint,
         'ip' || ((user_id // 5) * 8 + k % 8) AS ip_address,
         abroad AS is_outside_home_country,
         p_type IN ('PROMO', 'ECONOMY') AS is_high_risk_vendor,
         isodow(ts) - 1 >= 5 AS is_weekend,
         (user_id // 15) % 5 <> 4 AND ((hour(ts) <= 5 AND k < 45) OR (abroad AND value > 25)
              OR (value > 110 AND k % 3 <> 2)) AS is_fraud,
         event_id, user_id
  FROM ej JOIN nation ON n_nationkey = nk)"""

ACTIVITY = TXN + """,
lh AS (
  SELECT *,
         event_id % 53 <> 0 AS has_activity,
         CASE WHEN event_id % 53 <> 0 THEN count(*) OVER h END AS last_hour_num_transactions,
         CASE WHEN event_id % 53 <> 0 THEN round(coalesce(sum(amount) OVER h, 0), 6) END AS last_hour_total_amount,
         CASE WHEN event_id % 53 <> 0 THEN count(DISTINCT vendor) OVER h END AS last_hour_unique_merchants,
         CASE WHEN event_id % 53 <> 0 THEN count(DISTINCT country) OVER h END AS last_hour_unique_countries,
         CASE WHEN event_id % 53 <> 0 THEN coalesce(max(amount) OVER h, 0) END AS last_hour_max_single_amount
  FROM txn
  WINDOW h AS (PARTITION BY user_id ORDER BY epoch_us(timestamp)
               RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING))"""

RATES = """
fx AS (
  SELECT CAST(ts AS DATE) AS date,
         avg(CASE WHEN event_type = 'click' THEN value END) AS click,
         avg(CASE WHEN event_type = 'error' THEN value END) AS error,
         avg(CASE WHEN event_type = 'purchase' THEN value END) AS purchase,
         avg(CASE WHEN event_type = 'signup' THEN value END) AS signup,
         avg(CASE WHEN event_type = 'view' THEN value END) AS view
  FROM events GROUP BY 1),
fxl AS (
  SELECT date, 'click' AS currency, click AS rate FROM fx UNION ALL
  SELECT date, 'error', error FROM fx UNION ALL SELECT date, 'purchase', purchase FROM fx UNION ALL
  SELECT date, 'signup', signup FROM fx UNION ALL SELECT date, 'view', view FROM fx)"""

PREDICTIONS = TXN + """,
pr AS (
  SELECT transaction_id AS id, CAST(is_fraud AS INTEGER) AS label,
         CASE WHEN sc >= 0.4 THEN 1 ELSE 0 END AS prediction, sc AS score
  FROM (SELECT *, round(CASE WHEN hour(timestamp) <= 5 THEN 0.4::DOUBLE ELSE 0.05::DOUBLE END
                 + CASE WHEN is_outside_home_country THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
                 + least(floor(amount / 50), 5) * 0.05::DOUBLE, 4) AS sc FROM txn))"""


def with_txn(body: str) -> str:
    return f"WITH {TXN}\n{body}"


def with_activity(body: str) -> str:
    return f"WITH {ACTIVITY}\n{body}"


def with_rates(body: str) -> str:
    return f"WITH {RATES}\n{body}"


def with_predictions(body: str) -> str:
    return f"WITH {PREDICTIONS}\n{body}"
