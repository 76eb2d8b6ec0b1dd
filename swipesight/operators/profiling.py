"""Profiles of a table: types, gaps, distributions and correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipesight.functions.ranks import quantile_columns, quantiles, stack
from swipesight.functions.semantics import (
    booleans_to_int,
    numeric_columns,
    pair_corr,
    rows_of,
    with_row,
)

LAST_HOUR_FIELDS = [
    "num_transactions",
    "total_amount",
    "unique_merchants",
    "unique_countries",
    "max_single_amount",
]


def unpack_last_hour(df: DataFrame, fields: Sequence[str] = LAST_HOUR_FIELDS) -> DataFrame:
    """Struct members as `last_hour_*` columns; a missing struct gives missing members."""
    return df.selectExpr("*", *[f"last_hour_activity.{f} AS last_hour_{f}" for f in fields])


def first_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns)).cast("long")
    )


def column_types(df: DataFrame) -> DataFrame:
    """Name and type of every column, in order; made from the schema without reading data."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def currency_names(rates: DataFrame) -> list[str]:
    return [c for c in rates.columns if c != "date"]


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, one row per numeric column."""
    columns = list(columns or numeric_columns(df))
    long = stack(df, columns)
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quarter = quartiles(long, ["column"])
    return basic.join(F.broadcast(quarter), "column", "left")


def quartiles(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    found = quantiles(long, value, [0.25, 0.5, 0.75], by)
    return found.groupBy(*by).agg(
        *[F.expr(f"max(CASE WHEN p = 0.{d}D THEN q END)").alias(f"q{d}") for d in (25, 50, 75)]
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with missing cells: count and percentage of rows."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    cells = rows_of({c: [F.col(c)] for c in df.columns}, ["column", "missing"])
    return (
        counted.select("_rows", cells)
        .filter(F.col("missing") > 0)
        .select("column", "missing", (F.col("missing") * 100.0 / F.col("_rows")).alias("percent"))
    )


def mostly_missing(df: DataFrame, limit: float = 0.5) -> list[str]:
    """Names of columns whose missing share is above `limit` (a few names reach the driver)."""
    gaps = missing_values(df).filter(F.col("percent") > limit * 100).select("column")
    return [r["column"] for r in gaps.collect()]


def date_range(rates: DataFrame) -> DataFrame:
    return rates.agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("row_count"),
    )


def dataset_summary(df: DataFrame, rates: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Row, label, time, place, currency, customer and missing-cell totals in one row.

    `exact=False` counts distinct values with sketches, for a quick look at very large tables.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    gaps = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    fraud = F.count_if(F.col("is_fraud"))
    day = F.to_date("timestamp")
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("transactions"),
        fraud.alias("fraud_transactions"),
        (fraud * 100.0 / rows).alias("fraud_percent"),
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
        (F.datediff(F.max(day), F.min(day)) + 1).cast("long").alias("calendar_days"),
        distinct("country").alias("countries"),
        distinct("city").alias("cities"),
        distinct("currency").alias("currencies"),
        distinct("customer_id").alias("customers"),
        distinct("card_number").alias("cards"),
        gaps.alias("missing_cells"),
        (gaps * 100.0 / (rows * len(df.columns))).alias("missing_percent"),
    ).withColumn(
        "rate_currencies", F.lit(len(rates.columns) - 1 if rates is not None else None).cast("long")
    )


def currency_statistics(rates: DataFrame) -> DataFrame:
    long = stack(rates, currency_names(rates)).withColumnRenamed("column", "currency")
    basic = long.groupBy("currency").agg(
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.stddev_samp("value").alias("std"),
    )
    middle = quantiles(long, "value", [0.5], ["currency"]).select("currency", F.col("q").alias("median"))
    return basic.join(F.broadcast(middle), "currency", "left")


def rate_series(rates: DataFrame, currencies: Sequence[str]) -> DataFrame:
    """Chosen currencies by date in long form."""
    return stack(rates, list(currencies), ["date"]).select(
        "date", F.col("column").alias("currency"), F.col("value").alias("rate")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations of all column pairs, in one pass: rows (a, b, corr)."""
    columns = list(columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    found = df.agg(*[
        pair_corr(F.col(columns[i]), F.col(columns[j])).alias(f"c_{i}_{j}") for i, j in pairs
    ])
    cells = [
        F.struct(
            F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"),
            F.col(f"c_{min(i, j)}_{max(i, j)}").alias("corr"),
        )
        for i in range(len(columns))
        for j in range(len(columns))
    ]
    return found.select(F.inline(F.array(*cells)))


def label_correlations(
    df: DataFrame, label: str, columns: Sequence[str] | None = None, min_abs: float | None = 0.01
) -> DataFrame:
    """Correlation of each numeric or boolean column with the label, strongest first."""
    ints = booleans_to_int(df)
    columns = list(columns or [c for c in numeric_columns(ints) if c != label])
    found = ints.agg(*[pair_corr(F.col(c), F.col(label)).alias(c) for c in columns])
    out = found.select(rows_of({c: [F.col(c)] for c in columns}, ["feature", "corr"]))
    if min_abs is not None:
        out = out.filter(F.abs("corr") > min_abs)
    return out.orderBy(F.desc_nulls_last("corr"), "feature")


def top_correlation_matrix(df: DataFrame, label: str, n: int = 15) -> DataFrame:
    """Correlation matrix of the n columns most positively correlated with the label, label included."""
    ints = booleans_to_int(df)
    ranked = label_correlations(ints, label, numeric_columns(ints), None).limit(n)
    names = [r["feature"] for r in ranked.collect()]
    if label not in names:
        names.append(label)
    return correlation_matrix(ints, names)


def last_hour_correlations(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    unpacked = unpack_last_hour(df)
    return label_correlations(unpacked, label, [f"last_hour_{f}" for f in LAST_HOUR_FIELDS], None)


def histogram(
    df: DataFrame, value: str, bins: int, groups: Mapping[str, Column] | None = None
) -> DataFrame:
    """Equal-width bins over the whole range with the rows of each group; empty bins are kept."""
    groups = dict(groups or {"n": F.lit(True)})
    bounds = df.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    edge = F.col("_edge")
    v = F.col(value).cast("double")
    spread = edge["high"] - edge["low"]
    at = F.when(spread == 0, F.lit(1)).otherwise(
        F.least(F.floor(F.try_divide(bins * (v - edge["low"]), spread)) + 1, F.lit(bins))
    )
    counted = (
        with_row(df.filter(F.col(value).isNotNull()), bounds, "_edge")
        .groupBy(at.cast("int").alias("bin"))
        .agg(*[F.count_if(c).alias(g) for g, c in groups.items()])
    )
    spine = bounds.select("low", "high", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("high") - F.col("low")) / bins
    return spine.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (F.col("low") + (F.col("bin") - 1) * width).alias("bin_low"),
        (F.col("low") + F.col("bin") * width).alias("bin_high"),
        *[F.coalesce(F.col(g), F.lit(0)).alias(g) for g in groups],
    )


def box_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles per class, whiskers at the last values within 1.5 IQR, and the points beyond."""
    rows = df.filter(F.col(by).isNotNull() & F.col(value).isNotNull()).select(
        by, F.col(value).cast("double").alias("value")
    )
    boxes = quartiles(rows, [by])
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = (F.col("value") >= F.col("q25") - reach) & (F.col("value") <= F.col("q75") + reach)
    return (
        rows.join(F.broadcast(boxes), by)
        .groupBy(by)
        .agg(
            F.first("q25").alias("q25"),
            F.first("q50").alias("q50"),
            F.first("q75").alias("q75"),
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def fill_gaps(
    df: DataFrame,
    constants: Mapping[str, object] | None = None,
    medians: Sequence[str] = (),
    median_source: DataFrame | None = None,
) -> DataFrame:
    """Constants for some columns, exact medians (of `median_source` or of the table) for others."""
    out = df.fillna(dict(constants)) if constants else df
    if medians:
        source = median_source if median_source is not None else df
        middle = quantile_columns(source, {c: (c, 0.5) for c in medians})
        out = with_row(out, middle, "_middle").withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.col(f"_middle.{c}")) for c in medians}
        ).drop("_middle")
    return out


def columns_by_kind(
    df: DataFrame, booleans_are_categories: bool = False, exclude: Sequence[str] = ()
) -> tuple[list[str], list[str]]:
    """Numeric and categorical column names by type."""
    numeric = [c for c in numeric_columns(df) if c not in exclude]
    kinds = (T.StringType, T.BooleanType) if booleans_are_categories else (T.StringType,)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in exclude]
    return numeric, text
