"""Input schemas of the card-transaction and exchange-rate tables."""

from __future__ import annotations

from pyspark.sql import types as T

LAST_HOUR = T.StructType(
    [
        T.StructField("num_transactions", T.LongType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("unique_merchants", T.LongType()),
        T.StructField("unique_countries", T.LongType()),
        T.StructField("max_single_amount", T.DoubleType()),
    ]
)

_TRANSACTION_TYPES = {
    "transaction_id": T.StringType(),
    "customer_id": T.StringType(),
    "card_number": T.LongType(),
    "timestamp": T.TimestampType(),
    "vendor_category": T.StringType(),
    "vendor_type": T.StringType(),
    "vendor": T.StringType(),
    "amount": T.DoubleType(),
    "currency": T.StringType(),
    "country": T.StringType(),
    "city": T.StringType(),
    "city_size": T.StringType(),
    "card_type": T.StringType(),
    "is_card_present": T.BooleanType(),
    "device": T.StringType(),
    "channel": T.StringType(),
    "device_fingerprint": T.StringType(),
    "ip_address": T.StringType(),
    "is_outside_home_country": T.BooleanType(),
    "is_high_risk_vendor": T.BooleanType(),
    "is_weekend": T.BooleanType(),
    "last_hour_activity": LAST_HOUR,
    "is_fraud": T.BooleanType(),
}
TRANSACTIONS = T.StructType([T.StructField(n, t) for n, t in _TRANSACTION_TYPES.items()])

CURRENCIES = ["AUD", "BRL", "CAD", "EUR", "GBP", "JPY", "MXN", "NGN", "RUB", "SGD", "USD"]
EXCHANGE_RATES = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(c, T.LongType() if c == "USD" else T.DoubleType()) for c in CURRENCIES]
)
