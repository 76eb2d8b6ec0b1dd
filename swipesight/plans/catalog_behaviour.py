"""Registered queries: features, temporal patterns, gaps and the customer graph."""

from __future__ import annotations

from swipesight.functions.ranks import quantiles
from swipesight.functions.stats import mann_whitney
from swipesight.operators import features as fe
from swipesight.operators.drift import drift
from swipesight.operators import graph as gr
from swipesight.operators import profiling
from swipesight.operators import temporal as tm
from swipesight.plans.catalog_customers import _qcut, _spine, on, txn
from swipesight.plans.oracle import with_activity, with_txn
from swipesight.plans.query import Query, form
from swipesight.sources import fixtures
from swipesight.streaming.intervals import drain_intervals

TIME_FORM = (
    "transaction_id !transaction_date #transaction_hour #transaction_day #transaction_dow #transaction_month "
    "#transaction_week time_of_day #seconds_from_midnight #is_weekend_calc ~hour_sin ~hour_cos ~dow_sin ~dow_cos"
)
TIME_SQL = """CAST(timestamp AS DATE) AS transaction_date, hour(timestamp) AS transaction_hour,
  day(timestamp) AS transaction_day, isodow(timestamp) - 1 AS transaction_dow, month(timestamp) AS transaction_month,
  weekofyear(timestamp) AS transaction_week,
  CASE WHEN hour(timestamp) < 6 THEN 'night' WHEN hour(timestamp) < 12 THEN 'morning'
       WHEN hour(timestamp) < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day,
  hour(timestamp) * 3600 + minute(timestamp) * 60 + second(timestamp) AS seconds_from_midnight,
  CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END AS is_weekend_calc,
  sin(2 * pi() * hour(timestamp) / 24) AS hour_sin, cos(2 * pi() * hour(timestamp) / 24) AS hour_cos,
  sin(2 * pi() * (isodow(timestamp) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(timestamp) - 1) / 7) AS dow_cos"""
N, T, M = "last_hour_num_transactions", "last_hour_total_amount", "last_hour_max_single_amount"
HOUR_SQL = f"""{N}, {T}, last_hour_unique_merchants, last_hour_unique_countries, {M},
  CASE WHEN {N} > 0 THEN {T} / {N} ELSE 0 END AS avg_amount_per_trans_last_hour,
  CASE WHEN {N} > 0 THEN last_hour_unique_merchants / {N} ELSE 0 END AS merchant_diversity_last_hour,
  CASE WHEN {N} > 0 THEN last_hour_unique_countries / {N} ELSE 0 END AS country_diversity_last_hour,
  CASE WHEN {N} > 0 AND {T} > 0 THEN amount / ({T} / {N}) END AS amount_vs_avg_last_hour,
  CASE WHEN {M} > 0 THEN amount / {M} END AS amount_vs_max_last_hour"""
HOUR_FORM = (
    f"#{N} ~{T} #last_hour_unique_merchants #last_hour_unique_countries ~{M} ~avg_amount_per_trans_last_hour "
    "~merchant_diversity_last_hour ~country_diversity_last_hour ~amount_vs_avg_last_hour ~amount_vs_max_last_hour"
)
CUSTOMER_SQL = """count(*) OVER c AS customer_total_transactions, avg(amount) OVER c AS customer_avg_amount,
  coalesce(stddev_samp(amount) OVER c, 0) AS customer_std_amount, min(amount) OVER c AS customer_min_amount,
  max(amount) OVER c AS customer_max_amount, sum(amount) OVER c AS customer_total_amount,
  count(*) OVER c / 30 AS customer_avg_transaction_frequency,
  (amount - avg(amount) OVER c) / CASE WHEN coalesce(stddev_samp(amount) OVER c, 0) = 0 THEN 1
     ELSE stddev_samp(amount) OVER c END AS amount_deviation_from_customer_avg,
  amount / CASE WHEN max(amount) OVER c = 0 THEN 1 ELSE max(amount) OVER c END AS amount_vs_customer_max"""
CUSTOMER_FORM = (
    "#customer_total_transactions ~customer_avg_amount ~customer_std_amount ~customer_min_amount "
    "~customer_max_amount ~customer_total_amount ~customer_avg_transaction_frequency "
    "~amount_deviation_from_customer_avg #is_unusual_amount_for_customer ~amount_vs_customer_max"
)
VENDOR_SQL = """count(*) OVER v AS vendor_transaction_count, avg(amount) OVER v AS vendor_avg_amount,
  stddev_samp(amount) OVER v AS vendor_std_amount,
  (amount - avg(amount) OVER v) / CASE WHEN stddev_samp(amount) OVER v = 0 THEN 1 ELSE stddev_samp(amount) OVER v END
    AS amount_deviation_from_vendor_avg"""
VENDOR_FORM = "#vendor_transaction_count ~vendor_avg_amount ~vendor_std_amount ~amount_deviation_from_vendor_avg"
DEVICE_SQL = """count(*) OVER d AS device_usage_count,
  count(DISTINCT customer_id) OVER d AS unique_customers_per_device"""
DEVICE_FORM = "#device_usage_count #unique_customers_per_device #is_suspicious_device"
CROSS_SQL = """channel || '_' || CAST(is_card_present AS VARCHAR) AS channel_card_present_interaction,
  country || '_' || card_type AS country_card_type_interaction,
  CASE WHEN hour(timestamp) < 6 THEN 'night' WHEN hour(timestamp) < 12 THEN 'morning'
    WHEN hour(timestamp) < 18 THEN 'afternoon' ELSE 'evening' END || '_' || vendor_category
    AS time_vendor_category_interaction,
  CAST(is_high_risk_vendor AND is_outside_home_country AS INTEGER) AS high_risk_outside_country,
  CAST(is_high_risk_vendor AND is_weekend AS INTEGER) AS high_risk_weekend,
  CAST(is_outside_home_country AND is_weekend AS INTEGER) AS outside_country_weekend,
  amount * CAST(is_high_risk_vendor AS INTEGER) AS amount_risk_interaction"""
CROSS_FORM = (
    "channel_card_present_interaction country_card_type_interaction time_vendor_category_interaction "
    "#high_risk_outside_country #high_risk_weekend #outside_country_weekend ~amount_risk_interaction"
)


def _rolling_sql() -> str:
    parts = []
    for w in fe.WINDOW_SIZES:
        frame = f"(PARTITION BY customer_id ORDER BY timestamp, transaction_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        parts += [
            f"avg(amount) OVER {frame} AS customer_avg_amount_last_{w}",
            f"count(transaction_id) OVER {frame} AS customer_trans_count_last_{w}",
            f"count(DISTINCT vendor) OVER {frame} AS customer_unique_vendors_last_{w}",
        ]
    return ", ".join(parts)


ROLLING_FORM = " ".join(
    f"~customer_avg_amount_last_{w} #customer_trans_count_last_{w} #customer_unique_vendors_last_{w}"
    for w in fe.WINDOW_SIZES
)
NAMED = """WINDOW c AS (PARTITION BY customer_id), v AS (PARTITION BY vendor), d AS (PARTITION BY device_fingerprint)"""


def names(text: str) -> list[str]:
    return [c.lstrip("~#@!") for c in text.split()]


PATTERNS = """, g AS (SELECT *, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY customer_id
    ORDER BY timestamp, transaction_id)) / 1e6 AS gap_seconds FROM txn),
vg AS (SELECT * FROM g WHERE gap_seconds BETWEEN 1 AND 86400),
pt AS (SELECT customer_id, avg(gap_seconds) AS avg_time_diff, stddev_samp(gap_seconds) AS std_time_diff,
    min(gap_seconds) AS min_time_diff, max(gap_seconds) AS max_time_diff, count(*) AS transaction_count,
    avg(CAST(is_fraud AS INTEGER)) AS fraud_rate FROM vg GROUP BY customer_id),
bots AS (SELECT *, coalesce(std_time_diff < avg_time_diff * 0.1, FALSE) AND transaction_count > 3 AS low_variability,
    avg_time_diff < 60 AND transaction_count > 5 AS high_frequency FROM pt)
"""
SERIES = """, h AS (SELECT date_trunc('hour', timestamp) AS hour_start, avg(CAST(is_fraud AS INTEGER)) AS r FROM txn GROUP BY 1),
sp AS (SELECT unnest(generate_series((SELECT min(hour_start) FROM h), (SELECT max(hour_start) FROM h), INTERVAL 1 HOUR)) AS hour_start),
se AS (SELECT hour_start, coalesce(r, 0) AS fraud_rate,
    (epoch_us(hour_start) - epoch_us((SELECT min(hour_start) FROM h))) // 3600000000 AS t
  FROM sp LEFT JOIN h USING (hour_start))
"""
GRAPH = """, inc AS (SELECT DISTINCT customer_id, 'device' AS kind, device_fingerprint AS key FROM txn
    UNION SELECT DISTINCT customer_id, 'ip', ip_address FROM txn),
ed AS (SELECT a.customer_id AS src, b.customer_id AS dst, count(*) AS weight,
    bool_or(a.kind = 'device') AS device_shared, bool_or(a.kind = 'ip') AS ip_shared
  FROM inc a JOIN inc b ON a.kind = b.kind AND a.key = b.key AND a.customer_id < b.customer_id GROUP BY 1, 2),
nb AS (SELECT src AS customer_id, dst AS other FROM ed UNION ALL SELECT dst, src FROM ed),
cf AS (SELECT customer_id, count(*) AS transactions, count(*) FILTER (WHERE is_fraud) AS fraud_count,
    avg(CAST(is_fraud AS INTEGER)) AS fraud_rate FROM txn GROUP BY 1),
dg AS (SELECT cf.customer_id, count(other) AS degree,
    count(other) / ((SELECT count(*) FROM cf) - 1) AS degree_centrality
  FROM cf LEFT JOIN nb ON nb.customer_id = cf.customer_id GROUP BY 1)
"""


def _component_sql(body: str) -> str:
    recursive = with_txn(GRAPH + """, walk(customer_id, seen) AS (
        SELECT customer_id, customer_id FROM cf UNION SELECT walk.customer_id, nb.other FROM walk JOIN nb ON nb.customer_id = walk.seen),
      comp AS (SELECT customer_id, min(seen) AS component FROM walk GROUP BY 1)
      """ + body)
    return recursive.replace("WITH", "WITH RECURSIVE", 1)


DRIFT = """, rw AS (SELECT date_trunc('day', timestamp) AS period_start, amount::DOUBLE AS amount,
    coalesce(is_fraud::INTEGER, 0) AS fraud, is_fraud IS NOT NULL AS labelled FROM txn WHERE timestamp IS NOT NULL),
  span AS (SELECT min(period_start) AS first, max(period_start) AS last FROM rw),
  dated AS (SELECT rw.*, rw.period_start < span.first + INTERVAL 7 DAY AS base FROM rw, span),
  edges AS (SELECT quantile_cont(amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM dated
    WHERE base AND amount IS NOT NULL),
  binned AS (SELECT d.*, CASE WHEN amount IS NULL OR edges IS NULL THEN NULL
    ELSE len(list_filter(edges, lambda e: amount > e)) END AS bin FROM dated d, edges),
  days AS (SELECT unnest(generate_series(first, last, INTERVAL 1 DAY)) AS period_start FROM span),
  spine AS (SELECT period_start, unnest(generate_series(0, 9)) AS bin FROM days),
  counts AS (SELECT period_start, bin, count(*) AS c FROM binned WHERE bin IS NOT NULL GROUP BY ALL),
  base_counts AS (SELECT bin, count(*) AS b FROM binned WHERE base AND bin IS NOT NULL GROUP BY ALL),
  cells AS (SELECT s.period_start, s.bin, coalesce(c, 0) AS c, coalesce(b, 0) AS b
    FROM spine s LEFT JOIN counts USING (period_start, bin) LEFT JOIN base_counts USING (bin)),
  tot AS (SELECT period_start, c, b, sum(c) OVER (PARTITION BY period_start) AS n, sum(b) OVER (PARTITION BY period_start) AS nb
    FROM cells),
  sh AS (SELECT period_start, n, (c + 0.5) / (n + 5.0) AS a, (b + 0.5) / (nb + 5.0) AS e FROM tot),
  ps AS (SELECT period_start, CASE WHEN max(n) > 0 THEN sum((a - e) * ln(a / e)) END AS psi FROM sh GROUP BY 1),
  per_day AS (SELECT period_start, count(*) AS transactions, sum(fraud) AS fraud, sum(labelled::INTEGER) AS labelled FROM rw GROUP BY 1),
  br AS (SELECT avg(fraud) AS rate FROM dated WHERE base AND labelled),
  series AS (SELECT d.period_start, coalesce(transactions, 0) AS transactions, coalesce(fraud, 0) AS fraud,
    CASE WHEN labelled > 0 THEN fraud::DOUBLE / labelled END AS fraud_rate, psi,
    CASE WHEN psi IS NULL THEN NULL WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END AS psi_level,
    CASE WHEN coalesce(labelled, 0) > 0 AND br.rate > 0 AND br.rate < 1
      THEN (fraud / labelled - br.rate) / sqrt(br.rate * (1 - br.rate) / labelled) ELSE 0 END AS z,
    row_number() OVER (ORDER BY d.period_start) AS i
    FROM days d LEFT JOIN per_day USING (period_start) LEFT JOIN ps USING (period_start), br),
  cs(i, up, down, alarm) AS (
    SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, false
    UNION ALL
    SELECT i, up, down, up > 5 OR down > 5 FROM (
      SELECT s.i, greatest(0, CASE WHEN cs.alarm THEN 0 ELSE cs.up END + s.z - 0.5) AS up,
        greatest(0, CASE WHEN cs.alarm THEN 0 ELSE cs.down END - s.z - 0.5) AS down
      FROM cs JOIN series s ON s.i = cs.i + 1))
SELECT period_start, transactions, fraud, fraud_rate, psi, psi_level, up AS cusum_up, down AS cusum_down, alarm AS change_point
FROM series JOIN cs USING (i)"""


def _pagerank_sql(rounds: int) -> str:
    """Weighted PageRank over `rounds` rounds, from the memberships of shared keys, as a recursive query."""
    body = f""", cf AS (SELECT DISTINCT customer_id FROM txn WHERE customer_id IS NOT NULL),
      inc AS (SELECT DISTINCT customer_id, 'device' AS kind, device_fingerprint AS key FROM txn
          WHERE customer_id IS NOT NULL AND device_fingerprint IS NOT NULL
        UNION SELECT DISTINCT customer_id, 'ip', ip_address FROM txn WHERE customer_id IS NOT NULL AND ip_address IS NOT NULL),
      sized AS (SELECT *, count(*) OVER (PARTITION BY kind, key) AS users FROM inc),
      mem AS (SELECT customer_id, kind, key, users FROM sized WHERE users > 1),
      node AS (SELECT cf.customer_id, coalesce(sum(users - 1), 0)::DOUBLE AS w, count(mem.key) AS keys
        FROM cf LEFT JOIN mem USING (customer_id) GROUP BY 1),
      total AS (SELECT count(*)::DOUBLE AS n FROM node),
      pr(it, customer_id, w, keys, r) AS (
        SELECT 0, customer_id, w, keys, 1 / (SELECT n FROM total) FROM node
        UNION ALL
        SELECT it + 1, customer_id, w, keys, 0.15 / (SELECT n FROM total)
            + 0.85 * (inflow + dangling / (SELECT n FROM total)) FROM (
          SELECT it, customer_id, w, keys, dangling, coalesce(sum(CASE WHEN key IS NOT NULL THEN s_k - x END), 0) AS inflow FROM (
            SELECT p.*, m.kind, m.key, CASE WHEN p.w > 0 THEN p.r / p.w END AS x,
              sum(CASE WHEN p.w > 0 THEN p.r / p.w END) OVER (PARTITION BY m.kind, m.key) AS s_k
            FROM (SELECT *, sum(CASE WHEN w = 0 THEN r ELSE 0 END) OVER () AS dangling FROM pr WHERE it < {rounds}) p
            LEFT JOIN mem m USING (customer_id)) q
          GROUP BY it, customer_id, w, keys, dangling))
      SELECT customer_id, r AS pagerank, r * (SELECT n FROM total) AS pagerank_scaled FROM pr WHERE it = {rounds}"""
    return with_txn(body).replace("WITH", "WITH RECURSIVE", 1)


GRAPH_INPUT = ["customer_id", "device_fingerprint", "ip_address", "is_fraud"]


def _graph(spark, sf):
    return gr.customer_graph(fixtures.transactions(spark, sf, GRAPH_INPUT))


def _members(spark, sf):
    t = fixtures.transactions(spark, sf, GRAPH_INPUT)
    customers = t.select("customer_id").distinct()
    return t, gr.shared_keys(gr.incidence(t)), customers


def _components(spark, sf):
    _, members, customers = _members(spark, sf)
    return gr.connected_components(members, customers)


def _communities(spark, sf):
    t, members, customers = _members(spark, sf)
    return t, members, gr.communities(members, customers)


def _patterns(spark, sf):
    return tm.arrival_patterns(fixtures.transactions(
        spark, sf, ["transaction_id", "customer_id", "timestamp", "is_fraud"]))


def _modularity(spark, sf):
    _, members, labels = _communities(spark, sf)
    return gr.modularity(members, labels)


def _community_table(pick):
    def run(spark, sf):
        t, _, labels = _communities(spark, sf)
        return pick(labels, gr.customer_fraud(t))
    return run


def _component_table(pick):
    def run(spark, sf):
        t = fixtures.transactions(spark, sf, GRAPH_INPUT)
        return pick(_components(spark, sf), gr.customer_fraud(t))
    return run


def _degree_table(pick):
    def run(spark, sf):
        t = fixtures.transactions(spark, sf, GRAPH_INPUT)
        return pick(gr.degrees(gr.customer_graph(t)), gr.customer_fraud(t))
    return run


def _betweenness_corr(spark, sf):
    t = fixtures.transactions(spark, sf, GRAPH_INPUT)
    return gr.centrality_fraud(gr.betweenness(gr.customer_graph(t)), gr.customer_fraud(t), ["betweenness"])


def _stats_columns(df, text, keep=("transaction_id",)):
    return df.select(*dict.fromkeys([*keep, *names(text)]))


def entries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["time_features"] = Query(
        lambda s, sf: _stats_columns(fe.time_features(fixtures.transactions(s, sf, ["transaction_id", "timestamp"])), TIME_FORM),
        form(with_txn(f"SELECT transaction_id, {TIME_SQL} FROM txn"), TIME_FORM))
    q["last_hour_features"] = Query(
        lambda s, sf: _stats_columns(fe.last_hour_features(fixtures.transactions(
            s, sf, ["transaction_id", "amount", "last_hour_activity"])), HOUR_FORM),
        form(with_activity(f"SELECT transaction_id, {HOUR_SQL} FROM lh"), f"transaction_id {HOUR_FORM}"))
    q["customer_statistics"] = Query(
        on(txn("transaction_id", "customer_id", "amount"), fe.customer_statistics),
        form(with_txn("""SELECT customer_id, count(*) AS customer_total_transactions, avg(amount) AS customer_avg_amount,
          coalesce(stddev_samp(amount), 0) AS customer_std_amount, min(amount) AS customer_min_amount,
          max(amount) AS customer_max_amount, sum(amount) AS customer_total_amount,
          count(*) / 30 AS customer_avg_transaction_frequency FROM txn GROUP BY 1"""),
             "customer_id " + " ".join(CUSTOMER_FORM.split()[:7])))
    q["customer_features"] = Query(
        lambda s, sf: _stats_columns(fe.customer_features(fixtures.transactions(
            s, sf, ["transaction_id", "customer_id", "amount"])), CUSTOMER_FORM),
        form(with_txn(f"""SELECT *, CASE WHEN abs(amount_deviation_from_customer_avg) > 3 THEN 1 ELSE 0 END
          AS is_unusual_amount_for_customer FROM (SELECT transaction_id, {CUSTOMER_SQL} FROM txn {NAMED})"""),
             f"transaction_id {CUSTOMER_FORM}"))
    q["vendor_features"] = Query(
        lambda s, sf: _stats_columns(fe.vendor_features(fixtures.transactions(
            s, sf, ["transaction_id", "vendor", "amount"])), VENDOR_FORM),
        form(with_txn(f"SELECT transaction_id, {VENDOR_SQL} FROM txn {NAMED}"), f"transaction_id {VENDOR_FORM}"))
    q["device_features"] = Query(
        lambda s, sf: _stats_columns(fe.device_features(fixtures.transactions(
            s, sf, ["transaction_id", "device_fingerprint", "customer_id"])), DEVICE_FORM),
        form(with_txn(f"""SELECT *, CASE WHEN unique_customers_per_device > 3 THEN 1 ELSE 0 END AS is_suspicious_device
          FROM (SELECT transaction_id, {DEVICE_SQL} FROM txn {NAMED})"""), f"transaction_id {DEVICE_FORM}"))
    q["interaction_features"] = Query(
        lambda s, sf: _stats_columns(fe.interaction_features(fe.time_features(fixtures.transactions(s, sf, [
            "transaction_id", "timestamp", "channel", "is_card_present", "country", "card_type", "vendor_category",
            "is_high_risk_vendor", "is_outside_home_country", "is_weekend", "amount"]))), CROSS_FORM),
        form(with_txn(f"SELECT transaction_id, {CROSS_SQL} FROM txn"), f"transaction_id {CROSS_FORM}"))
    q["rolling_features"] = Query(
        lambda s, sf: _stats_columns(fe.rolling_features(fixtures.transactions(
            s, sf, ["transaction_id", "customer_id", "timestamp", "amount", "vendor"])), ROLLING_FORM),
        form(with_txn(f"SELECT transaction_id, {_rolling_sql()} FROM txn"), f"transaction_id {ROLLING_FORM}"))
    everything = f"{TIME_FORM} {HOUR_FORM} {CUSTOMER_FORM} {VENDOR_FORM} {DEVICE_FORM} {CROSS_FORM} {ROLLING_FORM}"
    q["all_features"] = Query(
        lambda s, sf: _stats_columns(fe.all_features(fixtures.transactions(s, sf)), everything),
        form(with_activity(f"""SELECT *, CASE WHEN abs(amount_deviation_from_customer_avg) > 3 THEN 1 ELSE 0 END
          AS is_unusual_amount_for_customer, CASE WHEN unique_customers_per_device > 3 THEN 1 ELSE 0 END
          AS is_suspicious_device FROM (SELECT transaction_id, {TIME_SQL}, {HOUR_SQL}, {CUSTOMER_SQL}, {VENDOR_SQL},
          {DEVICE_SQL}, {CROSS_SQL}, {_rolling_sql()} FROM lh {NAMED})"""), everything))
    basic = "transaction_id #hour #day_of_week #is_night #is_card_present_int #is_outside_home_country_int " \
        "#is_high_risk_vendor_int #is_weekend_int #is_fraud_int ~amount_risk risk_outside"
    q["basic_features"] = Query(
        lambda s, sf: _stats_columns(fe.basic_features(fixtures.transactions(s, sf, [
            "transaction_id", "timestamp", "amount", "is_card_present", "is_outside_home_country",
            "is_high_risk_vendor", "is_weekend", "is_fraud"])), basic),
        form(with_txn("""SELECT transaction_id, hour(timestamp) AS hour, isodow(timestamp) - 1 AS day_of_week,
          CASE WHEN hour(timestamp) BETWEEN 0 AND 5 THEN 1 ELSE 0 END AS is_night,
          CAST(is_card_present AS INTEGER) AS is_card_present_int,
          CAST(is_outside_home_country AS INTEGER) AS is_outside_home_country_int,
          CAST(is_high_risk_vendor AS INTEGER) AS is_high_risk_vendor_int, CAST(is_weekend AS INTEGER) AS is_weekend_int,
          CAST(is_fraud AS INTEGER) AS is_fraud_int, amount * CAST(is_high_risk_vendor AS INTEGER) AS amount_risk,
          is_outside_home_country AND is_high_risk_vendor AS risk_outside FROM txn"""), basic))

    q["interval_counts"] = Query(
        on(txn("transaction_id", "timestamp", "is_fraud"), tm.interval_counts),
        form(with_txn("""SELECT time_bucket(INTERVAL 15 MINUTE, timestamp) AS interval_start, count(*) AS transactions,
          count(*) FILTER (WHERE is_fraud) AS fraud, avg(CAST(is_fraud AS INTEGER)) AS fraud_rate FROM txn GROUP BY 1"""),
             "@interval_start #transactions #fraud ~fraud_rate"))
    q["drift_monitor"] = Query(
        on(txn("timestamp", "amount", "is_fraud"), drift),
        form(with_txn(DRIFT).replace("WITH", "WITH RECURSIVE", 1),
             "@period_start #transactions #fraud ~fraud_rate ~psi psi_level ~cusum_up ~cusum_down change_point"))
    q["interval_stream_counts"] = Query(
        lambda spark, sf: drain_intervals(spark, fixtures.transactions(spark, sf, ["transaction_id", "timestamp", "is_fraud"])),
        form(with_txn("""SELECT time_bucket(INTERVAL 15 MINUTE, timestamp) AS interval_start, count(*) AS transactions,
          count(*) FILTER (WHERE is_fraud) AS fraud, avg(CAST(is_fraud AS INTEGER)) AS fraud_rate FROM txn GROUP BY 1"""),
             "@interval_start #transactions #fraud ~fraud_rate"))
    q["hourly_series"] = Query(
        on(txn("timestamp", "is_fraud"), tm.hourly_series),
        form(with_txn(SERIES + "SELECT * FROM se"), "@hour_start ~fraud_rate #t"))
    q["autocorrelation"] = Query(
        on(txn("timestamp", "is_fraud"), lambda t: tm.autocorrelation(tm.hourly_series(t))),
        form(with_txn(SERIES + """, ce AS (SELECT t, fraud_rate - (SELECT avg(fraud_rate) FROM se) AS x FROM se),
          ac AS (SELECT l.lag, sum(a.x * b.x) / (SELECT sum(x * x) FROM ce) AS acf
            FROM (SELECT unnest(generate_series(0, 24)) AS lag) l JOIN ce a ON TRUE JOIN ce b ON b.t = a.t + l.lag GROUP BY 1)
          SELECT lag, acf, abs(acf) > 1.96 / sqrt((SELECT count(*) FROM se)) AS significant FROM ac"""),
             "#lag ~acf significant"))
    q["arrival_patterns"] = Query(
        _patterns,
        form(with_txn(PATTERNS + "SELECT *, low_variability OR high_frequency AS bot_like FROM bots"),
             "customer_id ~avg_time_diff ~std_time_diff ~min_time_diff ~max_time_diff #transaction_count ~fraud_rate "
             "low_variability high_frequency bot_like"))
    q["bot_fraud_rates"] = Query(
        on(_patterns, tm.group_fraud_rates),
        form(with_txn(PATTERNS + """, b AS (SELECT *, low_variability OR high_frequency AS bot FROM bots),
          r AS (SELECT count(*) AS customers, count(*) FILTER (WHERE bot) AS members,
            avg(fraud_rate) FILTER (WHERE bot) AS member_fraud_rate, avg(fraud_rate) FILTER (WHERE NOT bot) AS other_fraud_rate FROM b)
          SELECT *, members / customers * 100 AS member_percent, member_fraud_rate / other_fraud_rate AS rate_ratio FROM r"""),
             "#customers #members ~member_fraud_rate ~other_fraud_rate ~member_percent ~rate_ratio"))
    q["mean_gap_histogram"] = Query(
        on(_patterns, lambda t: profiling.histogram(t, "avg_time_diff", 50)),
        form(with_txn(PATTERNS + """, b AS (SELECT min(avg_time_diff) AS lo, max(avg_time_diff) AS hi FROM pt),
          x AS (SELECT least(floor(50 * (avg_time_diff - lo) / (hi - lo)) + 1, 50) AS bin FROM pt, b)
          SELECT s.bin, lo + (s.bin - 1) * ((hi - lo) / 50) AS bin_low, lo + s.bin * ((hi - lo) / 50) AS bin_high,
            count(x.bin) AS n FROM (SELECT unnest(generate_series(1, 50)) AS bin) s, b
            LEFT JOIN x ON x.bin = s.bin GROUP BY s.bin, lo, hi"""), "#bin ~bin_low ~bin_high #n"))
    q["speed_segments"] = Query(
        on(_patterns, tm.speed_segments),
        form(with_txn(PATTERNS + f""", seg AS (SELECT *, {_qcut('pt', 'avg_time_diff', tm.SPEED_LABELS)} AS time_segment FROM pt),
          {_spine('sl', tm.SPEED_LABELS)}
          SELECT sl.segment AS time_segment, ordinal, count(customer_id) AS customers, avg(fraud_rate) AS fraud_rate
          FROM sl LEFT JOIN seg ON seg.time_segment = sl.segment GROUP BY 1, 2"""),
             "time_segment #ordinal #customers ~fraud_rate"))
    columns = tm.TIMING_COLUMNS
    scaled = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in columns)
    filled = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM lg)) AS {c}" for c in columns)
    q["timing_features"] = Query(
        on(_patterns, lambda t: tm.standardise(tm.timing_features(t), tm.TIMING_COLUMNS)),
        form(with_txn(PATTERNS + f""", lg AS (SELECT customer_id, fraud_rate, avg_time_diff, std_time_diff,
            CAST(transaction_count AS DOUBLE) AS transaction_count, ln(1 + avg_time_diff) AS log_avg_time,
            ln(1 + std_time_diff) AS log_std_time, ln(1 + transaction_count) AS log_count FROM pt),
          fl AS (SELECT customer_id, fraud_rate, {filled} FROM lg) SELECT customer_id, fraud_rate, {scaled} FROM fl"""),
             "customer_id ~fraud_rate " + " ".join(f"~{c}" for c in columns)))
    q["gap_rank_test"] = Query(
        on(_patterns, lambda t: mann_whitney(
            t.selectExpr("fraud_rate", "avg_time_diff < 28000 AS fast"), "fraud_rate", "fast").drop("p_value")),
        form(with_txn(PATTERNS + """, rk AS (SELECT avg_time_diff < 28000 AS fast, fraud_rate,
            rank() OVER (ORDER BY fraud_rate) + (count(*) OVER (PARTITION BY fraud_rate) - 1) / 2 AS r FROM pt),
          ti AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM pt GROUP BY fraud_rate)),
          s AS (SELECT count(*) FILTER (WHERE fast) AS n1, count(*) FILTER (WHERE NOT fast) AS n2,
            sum(r) FILTER (WHERE fast) AS r1 FROM rk),
          u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u FROM s)
          SELECT n1, n2, u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 -
            ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u, ti"""), "#n1 #n2 ~u ~z"))
    q["time_clusters"] = Query(on(txn("timestamp", "is_fraud"), tm.time_clusters))
    q["time_cluster_statistics"] = Query(
        on(txn("timestamp", "is_fraud"), lambda t: tm.cluster_statistics(tm.time_clusters(t))))
    q["time_cluster_summary"] = Query(
        on(txn("timestamp", "is_fraud"), lambda t: tm.cluster_summary(tm.time_clusters(t))))

    q["customer_links"] = Query(
        on(txn(*GRAPH_INPUT), gr.customer_links),
        form(with_txn(GRAPH + "SELECT src, dst, CAST(NULL AS VARCHAR) AS hub, weight, device_shared, ip_shared FROM ed"),
             "src dst hub #weight device_shared ip_shared"))
    q["connected_components"] = Query(
        _components, form(_component_sql("SELECT * FROM comp"), "customer_id component"))
    q["component_summary"] = Query(
        on(_components, gr.component_summary),
        form(_component_sql("""SELECT count(*) AS components, min(n) AS smallest, max(n) AS largest, avg(n) AS mean_size
          FROM (SELECT count(*) AS n FROM comp GROUP BY component)"""), "#components #smallest #largest ~mean_size"))
    q["component_fraud"] = Query(
        _component_table(lambda l, f: gr.group_statistics(l, f, "component")),
        form(_component_sql("""SELECT component, count(*) AS customers, sum(fraud_count) AS fraud_count,
          sum(transactions) AS transactions, sum(fraud_count) / sum(transactions) AS fraud_rate
          FROM comp JOIN cf USING (customer_id) GROUP BY 1"""),
             "component #customers #fraud_count #transactions ~fraud_rate"))
    q["riskiest_components"] = Query(
        _component_table(lambda l, f: gr.riskiest_groups(gr.group_statistics(l, f, "component"), "component")),
        form(_component_sql("""SELECT component, count(*) AS customers, sum(fraud_count) AS fraud_count,
          sum(transactions) AS transactions, sum(fraud_count) / sum(transactions) AS fraud_rate
          FROM comp JOIN cf USING (customer_id) GROUP BY 1 ORDER BY fraud_rate DESC, component LIMIT 5"""),
             "component #customers #fraud_count #transactions ~fraud_rate"))
    q["component_neighbourhood"] = Query(
        _component_table(lambda l, f: gr.fraud_neighbourhood(l, f, "component").drop("p_value")),
        form(_component_sql("""SELECT n1, n2, m1 AS mean1, m2 AS mean2, CASE WHEN m2 <> 0 THEN m1 / m2 END AS ratio,
            (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
            power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS freedom,
            coalesce(m1 >= m2 * 10, FALSE) AS goal_met
          FROM (SELECT count(*) FILTER (WHERE near) AS n1, count(*) FILTER (WHERE NOT near) AS n2,
            avg(fraud_rate) FILTER (WHERE near) AS m1, avg(fraud_rate) FILTER (WHERE NOT near) AS m2,
            var_samp(fraud_rate) FILTER (WHERE near) AS v1, var_samp(fraud_rate) FILTER (WHERE NOT near) AS v2
            FROM (SELECT fraud_rate, sum(fraud_count) OVER (PARTITION BY component) > 0 AS near
                  FROM comp JOIN cf USING (customer_id)))"""),
             "#n1 #n2 ~mean1 ~mean2 ~ratio ~t ~freedom goal_met"))
    q["communities"] = Query(_community_table(lambda l, f: l))
    q["community_modularity"] = Query(_modularity)
    q["community_fraud"] = Query(_community_table(lambda l, f: gr.group_statistics(l, f, "community")))
    q["riskiest_communities"] = Query(_community_table(
        lambda l, f: gr.riskiest_groups(gr.group_statistics(l, f, "community"), "community")))
    q["community_neighbourhood"] = Query(_community_table(lambda l, f: gr.fraud_neighbourhood(l, f, "community")))
    q["degree_centrality"] = Query(
        on(_graph, gr.degrees), form(with_txn(GRAPH + "SELECT * FROM dg"), "customer_id #degree ~degree_centrality"))
    q["degree_fraud_correlation"] = Query(
        _degree_table(lambda d, f: gr.centrality_fraud(d, f, ["degree_centrality"])),
        form(with_txn(GRAPH + """SELECT 'degree_centrality' AS measure, corr(degree_centrality, fraud_rate) AS corr
          FROM dg JOIN cf USING (customer_id)"""), "measure ~corr"))
    q["degree_fraud_trend"] = Query(
        _degree_table(lambda d, f: gr.fraud_trend(d, f)),
        form(with_txn(GRAPH + """SELECT regr_slope(fraud_rate, degree_centrality) AS slope,
          regr_intercept(fraud_rate, degree_centrality) AS intercept FROM dg JOIN cf USING (customer_id)"""),
             "~slope ~intercept"))
    q["pagerank"] = Query(
        lambda s, sf: (lambda t, m, c: gr.pagerank(m, c))(*_members(s, sf)).drop("rounds"),
        form(_pagerank_sql(200), "customer_id ~pagerank ~pagerank_scaled", digits=7), digits=7)
    q["louvain_communities"] = Query(lambda s, sf: (lambda t, m, c: gr.louvain(m, c))(*_members(s, sf)))
    q["betweenness"] = Query(on(_graph, gr.betweenness))
    q["betweenness_fraud_correlation"] = Query(_betweenness_corr)
    q["gap_quantiles"] = Query(
        lambda s, sf: quantiles(tm.valid_gaps(fixtures.transactions(
            s, sf, ["transaction_id", "customer_id", "timestamp", "is_fraud"])), "gap_seconds",
            [0.25, 0.5, 0.75], ["is_fraud"]),
        form(with_txn(PATTERNS + " UNION ALL ".join(
            f"SELECT is_fraud, {p}::DOUBLE AS p, quantile_cont(gap_seconds, {p}) AS q FROM vg GROUP BY 1"
            for p in (0.25, 0.5, 0.75))), "is_fraud ~p ~q"))
    return q

