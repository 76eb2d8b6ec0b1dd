"""Registered queries: sources, profiles, label shares and fraud rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from swipesight.operators import fraud, profiling
from swipesight.plans.oracle import with_activity, with_predictions, with_rates, with_txn
from swipesight.plans.query import Query, form
from swipesight.sources import fixtures
from swipesight.sources.schemas import TRANSACTIONS

TABLE_COLUMNS = [f.name for f in TRANSACTIONS.fields]
LAST_HOUR = [f"last_hour_{f}" for f in profiling.LAST_HOUR_FIELDS]


def txn(*columns):
    return lambda spark, sf: fixtures.transactions(spark, sf, columns or None)


def over(load, operator):
    return lambda spark, sf: operator(load(spark, sf))


def _quantile_list(table: str, name: str, value: str) -> str:
    return f"""SELECT '{name}' AS "column", count({value}) AS count, avg({value}) AS mean,
      stddev_samp({value}) AS std, min({value}) AS min, max({value}) AS max,
      quantile_cont({value}, 0.25) AS q25, quantile_cont({value}, 0.5) AS q50,
      quantile_cont({value}, 0.75) AS q75 FROM {table}"""


def _describe(table: str, names: list[str]) -> str:
    return " UNION ALL ".join(_quantile_list(table, n, f"CAST({n} AS DOUBLE)") for n in names)


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN isnan(corr({x}, {y})) THEN NULL ELSE corr({x}, {y}) END"


def _missing(columns: list[str]) -> str:
    checks = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS n FROM t"
        for c in columns
    )
    return f"SELECT \"column\", missing, missing * 100.0 / n AS percent FROM ({checks}) WHERE missing > 0"


def _histogram(table: str, value: str, bins: int, groups: dict[str, str]) -> str:
    counts = ", ".join(f"coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0) AS {g}" for g, c in groups.items())
    return f""", b AS (SELECT CAST(min({value}) AS DOUBLE) AS lo, CAST(max({value}) AS DOUBLE) AS hi FROM {table}),
    binned AS (SELECT {table}.*, CASE WHEN hi = lo THEN 1 ELSE
        least(floor({bins} * ({value} - lo) / (hi - lo)) + 1, {bins}) END AS bin FROM {table}, b
      WHERE {value} IS NOT NULL)
    SELECT s.bin, lo + (s.bin - 1) * ((hi - lo) / {bins}) AS bin_low, lo + s.bin * ((hi - lo) / {bins}) AS bin_high,
      {counts} FROM (SELECT unnest(generate_series(1, {bins})) AS bin) s, b
      LEFT JOIN binned ON binned.bin = s.bin GROUP BY s.bin, lo, hi"""


def _box(table: str, value: str, by: str) -> str:
    return f""", q AS (SELECT {by}, quantile_cont({value}, 0.25) AS q25, quantile_cont({value}, 0.5) AS q50,
      quantile_cont({value}, 0.75) AS q75 FROM {table} WHERE {value} IS NOT NULL GROUP BY {by}),
    r AS (SELECT {table}.{by}, {value} AS v, q25, q50, q75,
      {value} >= q25 - 1.5 * (q75 - q25) AND {value} <= q25 + 2.5 * (q75 - q25) AS inside
      FROM {table} JOIN q ON {table}.{by} = q.{by} WHERE {value} IS NOT NULL)
    SELECT {by}, min(q25) AS q25, min(q50) AS q50, min(q75) AS q75,
      min(CASE WHEN inside THEN v END) AS whisker_low, max(CASE WHEN inside THEN v END) AS whisker_high,
      count(*) FILTER (WHERE NOT inside) AS outliers FROM r GROUP BY {by}"""


def _rate_by(key: str, top: int | None = None) -> str:
    limit = f" ORDER BY fraud_rate DESC, {key} LIMIT {top}" if top else ""
    return with_txn(f"""SELECT {key}, avg(CAST(is_fraud AS INTEGER)) * 100 AS fraud_rate, count(*) AS n
      FROM txn WHERE {key} IS NOT NULL GROUP BY {key}{limit}""")


def _rate_query(key: str, top: int | None = None) -> Query:
    return Query(
        over(txn(key, "is_fraud"), lambda t: fraud.fraud_rate_by(t, key, top)),
        form(_rate_by(key, top), f"{key} ~fraud_rate #n"),
    )


def _crosstab(rows: str, columns: str, values: list[str]) -> Query:
    cells = ", ".join(
        f"round(avg(CAST(is_fraud AS INTEGER)) FILTER (WHERE CAST({columns} AS VARCHAR) = '{v}') * 100, 2) AS \"{v}\""
        for v in values
    )
    return Query(
        over(txn(rows, columns, "is_fraud"), lambda t: fraud.fraud_crosstab(t, rows, columns, values)),
        form(with_txn(f"SELECT {rows}, {cells} FROM txn GROUP BY {rows}"),
             f"{rows} " + " ".join(f"~{v}" for v in values)),
    )


def _table(spark, sf):
    t = fixtures.transactions(spark, sf)
    return profiling.unpack_last_hour(t).drop("last_hour_activity")


FLAT = [c for c in TABLE_COLUMNS if c != "last_hour_activity"]
MARKS = {"card_number": "#", "timestamp": "@", "amount": "~"}
FLAT_FORM = " ".join(MARKS.get(c, "") + c for c in FLAT)
ACTIVITY_FORM = "#last_hour_num_transactions ~last_hour_total_amount #last_hour_unique_merchants " \
    "#last_hour_unique_countries ~last_hour_max_single_amount"
NUMERIC_FEATURES = ["amount"] + LAST_HOUR
LABEL_FEATURES = ["amount", "is_card_present", "is_outside_home_country", "is_high_risk_vendor",
                  "is_weekend"] + LAST_HOUR


def _corr_table() -> str:
    flags = ["is_fraud", "is_card_present", "is_weekend", "is_outside_home_country", "is_high_risk_vendor"]
    ints = ", ".join(f"CAST({f} AS INTEGER) AS {f}" for f in flags)
    return with_activity(f", t AS (SELECT amount, {ints}, {', '.join(LAST_HOUR)} FROM lh)")


def _label_corr(features: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {_corr(f, 'is_fraud')} AS corr FROM t" for f in features)


def _wide(spark, sf):
    t = fixtures.transactions(spark, sf, [
        "amount", "is_card_present", "is_outside_home_country", "is_high_risk_vendor", "is_weekend",
        "last_hour_activity", "is_fraud"])
    return profiling.unpack_last_hour(t).drop("last_hour_activity")


def _matrix_sql(body: str, names: list[str], table: str) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {_corr(a, b)} AS corr FROM {table}" for a in names for b in names)
    return body + cells


def entries() -> dict[str, Query]:
    kinds = ["click", "error", "purchase", "signup", "view"]
    missing_columns = FLAT + ["last_hour_activity"]
    top_sql = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM txn "
        f"WHERE {c} IS NOT NULL GROUP BY 2" for c in fraud.CATEGORICAL)
    all_features = LABEL_FEATURES + ["is_fraud"]
    q: dict[str, Query] = {}
    q["transactions_table"] = Query(
        _table,
        form(with_activity(f"SELECT {', '.join(FLAT)}, {', '.join(LAST_HOUR)} FROM lh"), f"{FLAT_FORM} {ACTIVITY_FORM}"))
    q["exchange_rates_table"] = Query(
        fixtures.exchange_rates, form(with_rates("SELECT * FROM fx"), "!date " + " ".join(f"~{k}" for k in kinds)))
    q["prediction_table"] = Query(
        fixtures.prediction_table, form(with_predictions("SELECT * FROM pr"), "id #label #prediction ~score"))
    q["shape"] = Query(
        over(txn(), profiling.shape),
        form(with_txn(f"SELECT count(*) AS row_count, {len(TABLE_COLUMNS)} AS column_count FROM txn"),
             "#row_count #column_count"))
    q["first_rows"] = Query(
        lambda s, sf: profiling.first_rows(
            fixtures.transactions(s, sf, [c for c in FLAT]), ["timestamp", "transaction_id"]),
        form(with_txn(f"SELECT {', '.join(FLAT)} FROM txn ORDER BY timestamp, transaction_id LIMIT 5"), FLAT_FORM))
    q["describe_transactions"] = Query(
        lambda s, sf: profiling.describe_numeric(
            _wide(s, sf), NUMERIC_FEATURES),
        form(_corr_table() + _describe("t", NUMERIC_FEATURES), "column #count ~mean ~std ~min ~max ~q25 ~q50 ~q75"))
    q["rates_date_range"] = Query(
        over(fixtures.exchange_rates, profiling.date_range),
        form(with_rates("SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS row_count FROM fx"),
             "!first_date !last_date #row_count"))
    q["missing_values"] = Query(
        over(txn(), profiling.missing_values),
        form(with_activity(
            f", t AS (SELECT {', '.join(FLAT)}, CASE WHEN has_activity THEN 1 END AS last_hour_activity FROM lh) "
            + _missing(missing_columns)), "column #missing ~percent"))
    gaps = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in missing_columns)
    q["dataset_summary"] = Query(
        lambda s, sf: profiling.dataset_summary(fixtures.transactions(s, sf), fixtures.exchange_rates(s, sf)),
        form(with_activity(
            f""", t AS (SELECT {', '.join(FLAT)}, CASE WHEN has_activity THEN 1 END AS last_hour_activity FROM lh)
            SELECT count(*) AS transactions, count(*) FILTER (WHERE is_fraud) AS fraud_transactions,
              count(*) FILTER (WHERE is_fraud) * 100.0 / count(*) AS fraud_percent,
              min(CAST(timestamp AS DATE)) AS first_date, max(CAST(timestamp AS DATE)) AS last_date,
              date_diff('day', min(CAST(timestamp AS DATE)), max(CAST(timestamp AS DATE))) + 1 AS calendar_days,
              count(DISTINCT country) AS countries, count(DISTINCT city) AS cities,
              count(DISTINCT currency) AS currencies, count(DISTINCT customer_id) AS customers,
              count(DISTINCT card_number) AS cards, {gaps} AS missing_cells,
              ({gaps}) * 100.0 / (count(*) * {len(TABLE_COLUMNS)}) AS missing_percent, 5 AS rate_currencies FROM t"""),
            "#transactions #fraud_transactions ~fraud_percent !first_date !last_date #calendar_days #countries "
            "#cities #currencies #customers #cards #missing_cells ~missing_percent #rate_currencies"))
    q["currency_statistics"] = Query(
        over(fixtures.exchange_rates, profiling.currency_statistics),
        form(with_rates("""SELECT currency, avg(rate) AS mean, quantile_cont(rate, 0.5) AS median, min(rate) AS min,
          max(rate) AS max, stddev_samp(rate) AS std FROM fxl GROUP BY currency"""),
             "currency ~mean ~median ~min ~max ~std"))
    q["rate_series"] = Query(
        over(fixtures.exchange_rates, lambda r: profiling.rate_series(r, kinds[:4])),
        form(with_rates("SELECT * FROM fxl WHERE currency <> 'view'"), "!date currency ~rate"))
    q["currency_correlations"] = Query(
        over(fixtures.exchange_rates, lambda r: profiling.correlation_matrix(r, kinds)),
        form(_matrix_sql(with_rates(""), kinds, "fx"), "a b ~corr"))
    q["label_correlations"] = Query(
        over(_wide, lambda t: profiling.label_correlations(t, "is_fraud", LABEL_FEATURES)),
        form(_corr_table() + f"SELECT * FROM ({_label_corr(LABEL_FEATURES)}) WHERE abs(corr) > 0.01", "feature ~corr"))
    q["top_correlation_matrix"] = Query(
        over(_wide, lambda t: profiling.top_correlation_matrix(t, "is_fraud")),
        form(_matrix_sql(_corr_table(), all_features, "t"), "a b ~corr"))
    q["last_hour_correlations"] = Query(
        lambda s, sf: profiling.last_hour_correlations(
            fixtures.transactions(s, sf, ["last_hour_activity", "is_fraud"])),
        form(_corr_table() + _label_corr(LAST_HOUR), "feature ~corr"))
    q["amount_histogram"] = Query(
        over(txn("amount"), lambda t: profiling.histogram(t, "amount", 50)),
        form(with_txn(_histogram("txn", "amount", 50, {"n": "binned.bin IS NOT NULL"})), "#bin ~bin_low ~bin_high #n"))
    q["amount_histogram_by_label"] = Query(
        over(txn("amount", "is_fraud"), lambda t: profiling.histogram(
            t, "amount", 20, {"fraud": F.col("is_fraud"), "legitimate": ~F.col("is_fraud")})),
        form(with_txn(_histogram("txn", "amount", 20, {"fraud": "is_fraud", "legitimate": "NOT is_fraud"})),
             "#bin ~bin_low ~bin_high #fraud #legitimate"))
    q["amount_box_by_label"] = Query(
        over(txn("amount", "is_fraud"), lambda t: profiling.box_summary(t, "amount", "is_fraud")),
        form(with_txn(_box("txn", "amount", "is_fraud")),
             "is_fraud ~q25 ~q50 ~q75 ~whisker_low ~whisker_high #outliers"))
    q["last_hour_box_by_label"] = Query(
        over(txn("last_hour_activity", "is_fraud"), lambda t: profiling.box_summary(
            profiling.unpack_last_hour(t), "last_hour_total_amount", "is_fraud")),
        form(with_activity(_box("lh", "last_hour_total_amount", "is_fraud")),
             "is_fraud ~q25 ~q50 ~q75 ~whisker_low ~whisker_high #outliers"))
    q["last_hour_description"] = Query(
        lambda s, sf: profiling.describe_numeric(profiling.unpack_last_hour(
            fixtures.transactions(s, sf, ["last_hour_activity"])), LAST_HOUR),
        form(_corr_table() + _describe("t", LAST_HOUR), "column #count ~mean ~std ~min ~max ~q25 ~q50 ~q75"))
    q["unpacked_last_hour"] = Query(
        lambda s, sf: profiling.unpack_last_hour(fixtures.transactions(
            s, sf, ["transaction_id", "last_hour_activity"])).drop("last_hour_activity"),
        form(with_activity(f"SELECT transaction_id, {', '.join(LAST_HOUR)} FROM lh"), f"transaction_id {ACTIVITY_FORM}"))
    q["filled_gaps"] = Query(
        lambda s, sf: profiling.fill_gaps(
            profiling.unpack_last_hour(fixtures.transactions(
                s, sf, ["transaction_id", "city", "device", "last_hour_activity"])).drop("last_hour_activity"),
            {"city": "missing", "device": "missing", "last_hour_num_transactions": 0},
            ["last_hour_total_amount"],
        ).select("transaction_id", "city", "device", "last_hour_num_transactions", "last_hour_total_amount"),
        form(with_activity("""SELECT transaction_id, coalesce(city, 'missing') AS city,
          coalesce(device, 'missing') AS device, coalesce(last_hour_num_transactions, 0) AS last_hour_num_transactions,
          coalesce(last_hour_total_amount, (SELECT quantile_cont(last_hour_total_amount, 0.5) FROM lh))
            AS last_hour_total_amount FROM lh"""),
             "transaction_id city device #last_hour_num_transactions ~last_hour_total_amount"))

    q["label_distribution"] = Query(
        over(txn("is_fraud"), fraud.label_distribution),
        form(with_txn("""SELECT is_fraud, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS percent
          FROM txn GROUP BY is_fraud"""), "is_fraud #n ~percent"))
    q["amount_by_label"] = Query(
        over(txn("amount", "is_fraud"), fraud.amount_by_label),
        form(with_txn("""SELECT is_fraud, avg(amount) AS mean_amount, quantile_cont(amount, 0.5) AS median_amount
          FROM txn GROUP BY is_fraud"""), "is_fraud ~mean_amount ~median_amount"))
    q["top_values"] = Query(
        over(txn(*fraud.CATEGORICAL), fraud.top_values),
        form(with_txn(f"""SELECT * FROM (SELECT "column", value, n,
          row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank,
          count(*) OVER (PARTITION BY "column") AS distinct_values FROM ({top_sql})) WHERE rank <= 10"""),
             "column value #n #rank #distinct_values"))
    q["fraud_by_hour"] = Query(
        over(txn("timestamp", "is_fraud"), fraud.fraud_by_hour),
        form(with_txn("""SELECT hour(timestamp) AS hour, avg(CAST(is_fraud AS INTEGER)) * 100 AS fraud_rate,
          count(*) AS n FROM txn GROUP BY 1"""), "#hour ~fraud_rate #n"))
    days = ", ".join(f"({i}, '{d}')" for i, d in enumerate(fraud.WEEKDAYS))
    q["fraud_by_weekday"] = Query(
        over(txn("timestamp", "is_fraud"), fraud.fraud_by_weekday),
        form(with_txn(f""", d(weekday, day_name) AS (VALUES {days})
          SELECT weekday, day_name, avg(CAST(is_fraud AS INTEGER)) * 100 AS fraud_rate, count(is_fraud) AS n
          FROM d LEFT JOIN txn ON isodow(timestamp) - 1 = weekday GROUP BY 1, 2"""),
             "#weekday day_name ~fraud_rate #n"))
    q["fraud_by_vendor_category"] = _rate_query("vendor_category", 10)
    q["fraud_by_card_type"] = _rate_query("card_type")
    q["fraud_by_channel"] = _rate_query("channel")
    q["fraud_by_country_top10"] = _rate_query("country", 10)
    for rows, columns in fraud.CROSSTABS:
        values = ["mobile", "pos", "web"] if columns == "channel" else ["false", "true"]
        q[f"crosstab_{rows}_{columns}"] = _crosstab(rows, columns, values)
    return q
