"""Expressions with the null, NaN and bucket rules the operators share.

Spark differs from data frames in memory in three ways that change results: `NULL OR false` is
NULL, division by zero raises under ANSI mode, and NaN sorts above every number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def is_true(predicate: Column) -> Column:
    """A rule that cannot be evaluated does not fire."""
    return F.coalesce(predicate, F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division giving NULL for a zero or missing denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def flag(column: Column | str) -> Column:
    """Boolean as 0/1 so that it can be summed and averaged."""
    return (F.col(column) if isinstance(column, str) else column).cast("int")


def rate(column: Column | str) -> Column:
    return F.avg(flag(column))


def zero_as_one(column: Column) -> Column:
    """Divisor guard: a zero divisor becomes 1, a missing one stays missing."""
    return F.when(column == 0, F.lit(1.0)).otherwise(column)


def cut(column: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed buckets `(edge[i], edge[i+1]]`; values outside every bucket give NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    if list(edges) != sorted(set(edges)):
        raise ValueError("edges must increase")
    out = None
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        inside = (column > F.lit(float(low))) & (column <= F.lit(float(high)))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def cut_at(column: Column, edges: Sequence[Column], labels: Sequence[str]) -> Column:
    """Quantile buckets: like `cut` with computed edges, lowest edge included."""
    out = None
    for i, label in enumerate(labels):
        above = column >= edges[0] if i == 0 else column > edges[i]
        inside = above & (column <= edges[i + 1])
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def ordinal(column: Column, labels: Sequence[str]) -> Column:
    """Position of an ordered label."""
    out = None
    for i, label in enumerate(labels):
        out = F.when(column == label, i) if out is None else out.when(column == label, i)
    return out


def pair_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both sides are present; NULL for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a = F.when(both, x.cast("double"))
    b = F.when(both, y.cast("double"))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (*NUMERIC, T.DecimalType))]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def booleans_to_int(df: DataFrame, suffix: str = "") -> DataFrame:
    """Booleans as 0/1, in place or beside the original with a suffix."""
    return df.withColumns({f"{n}{suffix}": flag(n) for n in boolean_columns(df)})


def with_row(df: DataFrame, row: DataFrame, name: str = "_row") -> DataFrame:
    """Attach the only row of a one-row table to every row, as a struct column.

    It becomes one scalar subquery, evaluated once before the main stage.
    """
    whole = row.select(F.struct(*[F.col(c) for c in row.columns])).scalar()
    return df.withColumn(name, whole)


def rows_of(columns: dict[str, Sequence[Column]], names: Sequence[str]) -> Column:
    """Generator turning one wide row into rows: {key: values} with the given field names."""
    entries = [
        F.struct(F.lit(key).alias(names[0]), *[v.alias(n) for v, n in zip(values, names[1:])])
        for key, values in columns.items()
    ]
    return F.inline(F.array(*entries))


def literal_rows(spark, rows: Sequence[Sequence], names: Sequence[str]) -> DataFrame:
    """A small constant table built inside the plan, without a Python data source."""
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))
