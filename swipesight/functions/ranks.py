"""Order statistics that stay distributed.

An unpartitioned ordered window, and a `percentile` aggregate, each bring all distinct values of
a group to one task. Here a value-count table (one row per distinct value, so repeated values
cost nothing) is cut into value ranges; running totals are made within each range and shifted by
the totals of the ranges below. Results are exact wherever the cuts lie; ranges grow in number with the shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipesight.session import settle


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), **sums: str) -> DataFrame:
    """Rows per distinct value: `n`, and any further sums asked for, given as SQL expressions."""
    keyed = df.where(f"{value} IS NOT NULL AND NOT isnan(CAST({value} AS DOUBLE))")
    extra = [F.expr(f"sum({text})").alias(name) for name, text in sums.items()]
    return keyed.groupBy(*by, value).agg(F.expr("count(1)").alias("n"), *extra)


def running_totals(
    counts: DataFrame,
    order: str,
    totals: Sequence[str],
    by: Sequence[str] = (),
    ranges: int | None = None,
    keep_range: str | None = None,
) -> DataFrame:
    """Add `<c>_through` (sum of c up to and with this row) and `<c>_all` for each c in `totals`.

    `counts` holds one row per (by, order). It is dealt out by range, into as many parts as the session shuffles to (or
    `ranges`), and settled, so that a part is the same rows whenever it is read. Parts hold distinct values, so none is
    hot. The table of offsets has at most a row per part and group of `by`; Spark picks its join by its size.
    `keep_range` drops whole ranges before their rows are shuffled; it may use `_<c>_below`, `_<c>`
    (the total of the range) and `<c>_all`.
    """
    keys = [f"`{b}`" for b in by]
    dealt = (ranges,) if ranges else ()
    placed = settle(counts.repartitionByRange(*dealt, *by, order).withColumn("_range", F.spark_partition_id()))
    per_range = placed.groupBy(*by, "_range").agg(*[F.expr(f"sum({t})").alias(f"_{t}") for t in totals])
    group = f"PARTITION BY {', '.join(keys)}" if by else ""
    before = f"{group} ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = per_range.selectExpr(
        "*",
        *[f"coalesce(sum(_{t}) OVER ({before}), 0) AS _{t}_below" for t in totals],
        *[f"sum(_{t}) OVER ({group}) AS {t}_all" for t in totals],
    )
    if keep_range is not None:
        offsets = offsets.where(keep_range)
    offsets = offsets.drop(*[f"_{t}" for t in totals])
    inside = (
        f"PARTITION BY {', '.join([*keys, '_range'])} ORDER BY {order} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    )
    return placed.join(offsets, [*by, "_range"]).selectExpr(
        *[f"`{c}`" for c in counts.columns],
        *[f"sum({t}) OVER ({inside}) + _{t}_below AS {t}_through" for t in totals],
        *[f"{t}_all" for t in totals],
    )


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles with linear interpolation: rows (by..., p, q)."""
    names = [f"`{b}`" for b in by]
    counts = value_counts(df.selectExpr(*names, f"CAST(`{value}` AS DOUBLE) AS _v"), "_v", by)
    wanted = f"array({', '.join(f'{float(p)}D' for p in probabilities)})"

    def hits(first: str, last: str) -> str:
        """Quantiles whose neighbouring sorted positions (from 0) touch first..last."""
        place = "p * (n_all - 1)"
        return f"filter({wanted}, p -> ceil({place}) >= {first} AND floor({place}) <= {last})"

    touched = f"size({hits('_n_below', '_n_below + _n - 1')}) > 0"
    ranked = running_totals(counts, "_v", ["n"], by, keep_range=touched)
    rows = ranked.selectExpr(
        *names, "_v", "n_through - n AS _first", "n_through - 1 AS _last", "n_all",
        f"explode({hits('n_through - n', 'n_through - 1')}) AS p",
    ).selectExpr("*", "p * (n_all - 1) AS _at")
    ends = rows.groupBy(*by, "p").agg(
        F.expr("max(CASE WHEN floor(_at) BETWEEN _first AND _last THEN _v END)").alias("_low"),
        F.expr("max(CASE WHEN ceil(_at) BETWEEN _first AND _last THEN _v END)").alias("_high"),
        F.expr("max(_at)").alias("_at"),
    )
    return ends.selectExpr(*names, "p", "_low + (_high - _low) * (_at - floor(_at)) AS q")


def quantile_columns(
    df: DataFrame, wanted: dict[str, tuple[str, float]], by: Sequence[str] = ()
) -> DataFrame:
    """Several quantiles of several columns as one row (per `by`): {name: (column, p)}."""
    by = list(by)
    columns = sorted({c for c, _ in wanted.values()})
    long = stack(df, columns, by)
    found = quantiles(long, "value", sorted({p for _, p in wanted.values()}), [*by, "column"])
    picks = [
        F.expr(f"max(CASE WHEN column = '{c}' AND p = {float(p)}D THEN q END)").alias(name)
        for name, (c, p) in wanted.items()
    ]
    return found.groupBy(*by).agg(*picks)


def stack(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns to long form: (keep..., column, value)."""
    typed = df.selectExpr(
        *[f"`{k}`" for k in keep], *[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in columns]
    )
    return typed.unpivot(list(keep), list(columns), "column", "value")
