"""A registered query: the Spark side, the DuckDB side and a common output form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DIGITS = 6
# Keeps an exact half in the last digit from falling either way by the order of summation.
NUDGE = 2e-9


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    digits: int = DIGITS

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return tidy(self.run(spark, sf_dir), self.digits)


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded (sums differ in their last bits by order), integers long, times as text."""
    out = []
    for field in df.schema.fields:
        name, kind = f"`{field.name}`", field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            text = f"round(CAST({name} AS DOUBLE) + {NUDGE}D, {digits}) + 0.0D"
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            text = f"CAST({name} AS BIGINT)"
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            text = f"date_format({name}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        elif isinstance(kind, T.DateType):
            text = f"date_format({name}, 'yyyy-MM-dd')"
        else:
            text = name
        out.append(f"{text} AS {name}")
    return df.selectExpr(*out)


def form(sql: str, columns: str, digits: int = DIGITS) -> str:
    """Wrap DuckDB SQL in the same output form.

    `columns`: names with a mark, `~` double, `#` integer, `@` time, `!` date, none as it is.
    """
    out = []
    for mark_name in columns.split():
        mark, name = mark_name[0], mark_name.lstrip("~#@!")
        if mark == "~":
            out.append(
                f'CASE WHEN isnan(CAST("{name}" AS DOUBLE)) THEN NULL '
                f'ELSE round(CAST("{name}" AS DOUBLE) + CAST({NUDGE} AS DOUBLE), {digits}) + 0.0 END AS "{name}"'
            )
        elif mark == "#":
            out.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        elif mark == "@":
            out.append(f"strftime(\"{name}\", '%Y-%m-%d %H:%M:%S.%f') AS \"{name}\"")
        elif mark == "!":
            out.append(f"strftime(\"{name}\", '%Y-%m-%d') AS \"{name}\"")
        else:
            out.append(f'"{name}"')
    return f"SELECT {', '.join(out)} FROM (\n{sql}\n) AS result"
