"""Card transactions and rates derived from the given star-schema tables.

The test tables hold no card transactions; every event becomes one. Only the joins that the asked
columns need are made, and each dimension is filtered to the keys that can be met.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swipesight.sources.schemas import CURRENCIES, TRANSACTIONS

HOUR = 3_600_000_000
VENDOR_FIELDS = {"vendor"}
PART_FIELDS = {"vendor_category", "vendor_type", "is_high_risk_vendor"}
HOME_FIELDS = {"currency", "country", "city", "card_type"}
CURRENCY_LIST = ", ".join(f"'{c}'" for c in CURRENCIES)
FIELDS = {
    "transaction_id": "CAST(event_id AS STRING)",
    "customer_id": "concat('C', user_id)",
    "card_number": "4000000000000000 + user_id * 10 + event_id % 2",
    "timestamp": "timestamp",
    "vendor_category": "p_type",
    "vendor_type": "p_brand",
    "vendor": "s_name",
    "amount": "value * 5",
    "currency": f"element_at(array({CURRENCY_LIST}), CAST(nk % 11 + 1 AS INT))",
    "country": "n_name",
    "city": "CASE WHEN event_id % 97 <> 0 THEN concat(n_name, '_', event_id % 4) END",
    "city_size": "CASE WHEN event_id % 4 < 2 THEN 'medium' ELSE 'large' END",
    "card_type": "c_mktsegment",
    "is_card_present": "k % 3 = 2",
    "device": "CASE WHEN event_id % 50 <> 0 THEN "
    "CASE k % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'iOS App' ELSE 'Chip Reader' END END",
    "channel": "CASE k % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' ELSE 'pos' END",
    "device_fingerprint": "concat('fp', (user_id div 3) * 4 + k % 4)",
    "ip_address": "concat('ip', (user_id div 5) * 8 + k % 8)",
    "is_outside_home_country": "abroad",
    "is_high_risk_vendor": "p_type IN ('PROMO', 'ECONOMY')",
    "is_weekend": "weekday(timestamp) >= 5",
    "last_hour_activity": "last_hour_activity",
    "is_fraud": "(user_id div 15) % 5 <> 4 AND ((hour(timestamp) <= 5 AND k < 45) "
    "OR (abroad AND value > 25) OR (value > 110 AND k % 3 <> 2))",
}
ALL = [f.name for f in TRANSACTIONS.fields]


def transactions(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """The transactions view; `columns` limits it, and with it the joins made."""
    wanted = [c for c in ALL if columns is None or c in columns]
    needed = set(wanted)
    activity = "last_hour_activity" in needed
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    abroad = (
        "CASE user_id % 3 WHEN 0 THEN false WHEN 1 THEN event_id % 28 = 0 ELSE event_id % 7 = 0 END"
    )
    rows = read("events").selectExpr(
        "event_id", "user_id", "value", "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "CAST(ts AS TIMESTAMP) AS timestamp", f"{abroad} AS abroad",
    )
    if needed & PART_FIELDS:
        part = read("part").select("p_partkey", "p_type", "p_brand")
        rows = rows.withColumn("pk", F.col("event_id") % part.agg(F.count(F.lit(1))).scalar())
        rows = rows.join(part, F.expr("pk = p_partkey"), "left")
    if needed & VENDOR_FIELDS or activity:
        supplier = read("supplier").select("s_suppkey", "s_name")
        rows = rows.withColumn("sk", F.col("event_id") % supplier.agg(F.count(F.lit(1))).scalar())
        rows = rows.join(supplier, F.expr("sk = s_suppkey"), "left")
    if needed & HOME_FIELDS or activity:
        home = read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        rows = rows.join(home, F.expr("user_id = c_custkey")).selectExpr(
            "*",
            "CASE WHEN abroad THEN (c_nationkey + 1 + event_id % 5) % 25 ELSE c_nationkey END AS nk",
        )
        nation = read("nation").where("n_nationkey < 25").select("n_nationkey", "n_name")
        rows = rows.join(F.broadcast(nation), F.expr("nk = n_nationkey"))
    if activity:
        rows = _with_last_hour(rows)
    return rows.selectExpr(*[f"{FIELDS[c]} AS {c}" for c in wanted])


def _with_last_hour(rows: DataFrame) -> DataFrame:
    """Activity of the same user in the hour before each row.

    The hour before a row is the end of the previous clock hour and the beginning of its own. Each
    is a running aggregate over one (user, clock hour), forwards for the beginning and backwards
    for the end, so the work stays linear and a user with very many rows is spread over the hours.
    """
    timed = rows.withColumn("_us", F.unix_micros("timestamp"))
    # every row stands in its own hour, and asks the previous one what came after it less an hour
    stand = f"struct(floor(_us / {HOUR}) AS block, _us AS at, true AS real)"
    ask = f"struct(floor(_us / {HOUR}) - 1 AS block, _us - {HOUR} AS at, false AS real)"
    points = timed.selectExpr(
        "event_id", "user_id", "value * 5 AS amount", "s_name", "n_name", f"inline(array({stand}, {ask}))"
    )
    forward = Window.partitionBy("user_id", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy("user_id", "block").orderBy(F.desc("at")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )

    def seen(window):
        real = lambda name: F.expr(f"CASE WHEN real THEN {name} END")
        return F.struct(
            F.count(real("1")).over(window).alias("n"), F.sum(real("amount")).over(window).alias("total"),
            F.max(real("amount")).over(window).alias("top"),
            F.collect_set(real("s_name")).over(window).alias("vendors"),
            F.collect_set(real("n_name")).over(window).alias("countries"),
        )

    part = points.select("event_id", "real", seen(forward).alias("_own"), seen(backward).alias("_previous"))
    both = part.groupBy("event_id").agg(
        F.expr("max_by(_own, real)").alias("a"), F.expr("min_by(_previous, real)").alias("b")
    )
    activity = both.selectExpr(
        "event_id AS _event",
        "CASE WHEN event_id % 53 <> 0 THEN struct(a.n + b.n AS num_transactions, "
        "round(coalesce(a.total, 0D) + coalesce(b.total, 0D), 6) AS total_amount, "
        "CAST(size(array_union(a.vendors, b.vendors)) AS BIGINT) AS unique_merchants, "
        "CAST(size(array_union(a.countries, b.countries)) AS BIGINT) AS unique_countries, "
        "coalesce(greatest(a.top, b.top), 0D) AS max_single_amount) END AS last_hour_activity",
    )
    return timed.join(activity, F.expr("event_id = _event"))


def exchange_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average event value per day and type, in the shape of the exchange-rate table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = ["click", "error", "purchase", "signup", "view"]
    means = [F.avg(F.when(F.col("event_type") == kind, F.col("value"))).alias(kind) for kind in kinds]
    return events.groupBy(F.to_date("ts").alias("date")).agg(*means)


def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic classifier output (id, label, prediction, score) with many tied scores."""
    rows = transactions(
        spark, sf_dir, ["transaction_id", "timestamp", "amount", "is_outside_home_country", "is_fraud"]
    )
    score = (
        F.when(F.hour("timestamp") <= 5, 0.4).otherwise(0.05)
        + F.when(F.col("is_outside_home_country"), 0.3).otherwise(0.0)
        + F.least(F.floor(F.col("amount") / 50), F.lit(5)) * 0.05
    )
    scored = rows.select(
        F.col("transaction_id").alias("id"),
        F.col("is_fraud").cast("int").alias("label"),
        F.round(score, 4).alias("score"),
    )
    return scored.select("id", "label", (F.col("score") >= 0.4).cast("int").alias("prediction"), "score")
