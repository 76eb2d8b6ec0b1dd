"""Ordered per-key windows that survive a key holding a large share of all rows.

A window partitioned by a key runs each key in one task. Keys above a row limit are cut into
chunks along the order columns; each chunk is handed the few rows before it, so that a frame
reaching a bounded number of rows back sees exactly what it would see in the whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEY_ROWS = 2_000_000


def _position(cuts: Column, row: Column) -> Column:
    """Number of sorted cuts at or before `row`, by halving (24 steps reach 16 million cuts)."""
    start = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        after = F.get(cuts, middle) <= row
        return (
            F.when(at["low"] >= at["high"], at)
            .when(after, F.struct((middle + 1).alias("low"), at["high"].alias("high")))
            .otherwise(F.struct(at["low"].alias("low"), middle.alias("high")))
        )

    steps = F.length(F.bin(F.size(cuts)))  # bits of the number of cuts
    return F.aggregate(F.sequence(F.lit(1), steps), start, halve)["low"]


def hot_keys(df: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """Keys with more than `hot_rows` rows; at most rows / `hot_rows` of them exist."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(f"_n > {hot_rows}").select(key)


def hot_cuts(df: DataFrame, key: str, order: Sequence[str], hot_rows: int) -> DataFrame:
    """(key, sorted cut rows) of keys above `hot_rows`.

    Cuts are rows picked by hash at one in `hot_rows`, so the table holds about rows / `hot_rows`
    cuts in all: 250,000 for 5e11 rows at the default. That bound is why it may be broadcast.
    """
    picked = df.filter(F.pmod(F.xxhash64(*order), F.lit(hot_rows)) == 0)
    hot = hot_keys(df, key, hot_rows)
    # a hot key without any picked row keeps a single chunk
    return (
        picked.join(F.broadcast(hot), key, "left_semi")
        .groupBy(key)
        .agg(F.sort_array(F.collect_set(F.struct(*order))).alias("_cuts"))
    )


def chunked(df: DataFrame, key: str, order: Sequence[str], hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Add `_chunk`: NULL for ordinary keys, the position along `order` for hot ones.

    Rows without a key form no group; they are only spread over tasks.
    """
    cuts = hot_cuts(df.select(key, *order), key, order, hot_rows)
    joined = df.join(F.broadcast(cuts), key, "left")
    at = (
        F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*order), F.lit(4096)).cast("int"))
        .when(F.col("_cuts").isNotNull(), _position(F.col("_cuts"), F.struct(*order)))
    )
    return joined.select(*df.columns, at.alias("_chunk"))


def ordered_windows(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    reach: int,
    build: Callable[[Window], dict[str, Column]],
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Add the columns `build(window)` makes from frames reaching at most `reach` rows back.

    `order` must be unique within a key. Rows with a NULL key get the columns as NULL, as grouping
    by key leaves them out.
    """
    order = list(order)
    names = list(build(Window.partitionBy(key).orderBy(*order)))
    blank = {name: F.when(F.col(key).isNotNull(), F.col(name)) for name in names}
    # one column is counted, once, to know whether any key needs cutting at all
    if hot_keys(df.select(key), key, hot_rows).isEmpty():
        return df.withColumns(build(Window.partitionBy(key).orderBy(*order))).withColumns(blank)

    placed = chunked(df, key, order, hot_rows)
    tagged = placed.withColumn("_lead_in", F.lit(False))

    in_chunk = Window.partitionBy(key, "_chunk")
    hot = placed.filter(F.col("_chunk").isNotNull() & F.col(key).isNotNull())
    last_rows = (
        hot.withColumn("_back", F.row_number().over(in_chunk.orderBy(*[F.desc(c) for c in order])))
        .filter(F.col("_back") <= reach)
        .drop("_back")
    )
    # at most `reach` rows per chunk from here on, so a window over a key's chunks is small
    by_key = Window.partitionBy(key).orderBy("_chunk", *order)
    numbered = last_rows.withColumn("_at", F.row_number().over(by_key))
    ends = (
        numbered.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_before",
            F.sum("_rows").over(
                Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select(F.col(key), F.col("_chunk").alias("_to"), "_before")
        .filter(F.col("_before").isNotNull())
    )
    # every chunk after the first holds its own cut row, so `reach` chunks ahead is far enough
    ahead = F.sequence(F.col("_chunk") + 1, F.col("_chunk") + reach)
    lead_in = (
        numbered.withColumn("_to", F.explode(ahead))
        .join(ends, [key, "_to"])
        .filter(F.col("_before") - F.col("_at") < reach)
        .withColumn("_chunk", F.col("_to"))
        .drop("_at", "_to", "_before")
        .withColumn("_lead_in", F.lit(True))
    )
    return (
        tagged.unionByName(lead_in)
        .withColumns(build(in_chunk.orderBy(*order)))
        .filter(~F.col("_lead_in"))
        .withColumns(blank)
        .drop("_chunk", "_lead_in")
    )
